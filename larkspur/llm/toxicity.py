"""Toxicity by a support vector machine over a string kernel of sentences, with Nystroem landmarks.

A text is cut into sentences, and a sentence into overlapping windows of whole words of at most WINDOW characters, each
with the blanks around it. The kernel of two windows is the gap-weighted count of their common subsequences of four
characters: one that spans s characters weighs DECAY ** s, up to SPAN characters, blanks and marks included, so that gaps and
inserted characters weaken a match and do not end it. It is divided by the norms that windows of those lengths have if no
subsequence repeats.

The labels are the documents': every sentence of a clean document is labelled 0, and of a toxic one at least one
sentence is toxic, which is not told. The machine starts from the windows of each toxic document that stand out most from clean ones,
by the kernel's mean over both, and then trains round by round on each toxic document's highest windows, on these with
a character inserted, on what else stands out in them, and on the clean windows that score highest. It is trained in the space that landmark windows span (Nystroem). As its decision is linear in
the kernel's features, the landmarks fold into one weight for each of the 2^20 subsequences over 32 character classes;
all windows of a text are scored by table look-ups and running sums. A document scores as its highest window, by a
logistic curve fitted on the sampled documents.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import byte_values, checkpointed, held_out, slices, table
from larkspur.llm.labelled import score_schema, training_rows

#: Bounds of the fit: labelled documents, sentences of clean and of toxic ones, windows in a round,
#: windows of a document not yet explained, windows that landmarks are picked from, landmarks, rounds.
SAMPLE, CLEAN_SENTENCES, TOXIC_SENTENCES, UNITS, OPEN, SPANNING, LANDMARKS, ROUNDS = 8000, 30_000, 40_000, 3000, 3, 900, 300, 4
DECAY, SPAN, WINDOW = 0.65, 7, 22
EIGEN, COST = 0.02, 4.0
THRESHOLD = 0.7
#: A window from this value on explains its document.
CLEAR = 0.2
#: Bytes of normalised text worked on at a time; longer sentences reach the fit in parts of PART bytes.
CHUNK, PART = 1 << 18, 240
#: Pairs of equal features that are held at a time.
PAIRS = 1 << 19
#: Character classes: 0 between sentences, a to z, then blank, digits, other marks, and the first and later bytes of letters beyond ASCII.
BLANK, DIGIT, MARK, FIRST, LATER = 27, 28, 29, 30, 31
_CLASS = np.full(256, MARK, np.uint32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58], _CLASS[128:192], _CLASS[192:], _CLASS[32], _CLASS[0] = DIGIT, LATER, FIRST, BLANK, 0
_ENDS = re.compile(rb"[.!?]*\s*\n\s*|[.!?]+\s+|[.!?]+\Z")
_STEPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
_NORMS = np.sqrt(np.array([max(sum(DECAY ** (2 * (c + 1)) * max(0, n - c) for *_, c in _STEPS), 1e-9) for n in range(2 * WINDOW)]))
TABLE = 1 << 20


def normal(text: bytes) -> bytes:
    """A text with single blanks and a zero byte between sentences, blanks around it."""
    return b" " + b" ".join(_ENDS.sub(b" \0 ", text.replace(b"\0", b" ")).split()) + b" "


def codes(x: np.ndarray, last: int):
    """The subsequences from each start whose fourth character is `last` places on, as table slots."""
    n = len(x) - last
    for a, b, c in _STEPS:
        if c == last:
            yield ((x[:n] << np.uint32(15)) | (x[a : a + n] << np.uint32(10))) | ((x[b : b + n] << np.uint32(5)) | x[c : c + n])


def windows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every window of class values: from each word's start, as many whole words of its sentence as fit.

    Words longer than WINDOW also have windows that start within them, every half WINDOW.
    """
    word = (x != BLANK) & (x != 0)
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(starts):
        return starts, ends
    breaks = np.append(np.flatnonzero(x == 0), len(x))
    half, size = WINDOW // 2, ends - starts
    long = np.flatnonzero(size > WINDOW)
    inner = [np.arange(s + half, e - half, half) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    first = np.sort(np.concatenate((starts, *inner)))
    last = ends[np.maximum(np.searchsorted(ends, first + WINDOW, "right") - 1, 0)]
    last = np.where(last > first, last, first + WINDOW)
    last = np.minimum(last, breaks[np.searchsorted(breaks, first)])
    begin = np.maximum(first - (x[np.maximum(first - 1, 0)] == BLANK), 0)
    return begin, last + (x[np.minimum(last, len(x) - 1)] == BLANK) * (last < len(x))


class Units:
    """Windows of many texts, laid end to end: class values, starts, ends and the text that each is of."""

    def __init__(self, texts: list[bytes]):
        self.x = _CLASS[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        self.start, self.end = windows(self.x)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.of = np.searchsorted(bounds, self.start, "right")

    def __len__(self) -> int:
        return len(self.start)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each window's inner product of features, divided by its norm, with weights."""
        out = np.zeros(len(self.start))
        for last in range(3, SPAN):
            if len(self.x) <= last:
                break
            here = np.zeros(len(self.x) - last, np.float32)
            for code in codes(self.x, last):
                here += weights.take(code)
            upto = np.concatenate(([0.0], np.cumsum(here, dtype=np.float64)))
            stop = np.maximum(self.end - last, self.start)
            out += DECAY ** (last + 1) * (upto[np.minimum(stop, len(here))] - upto[np.minimum(self.start, len(here))])
        return out / _NORMS[self.end - self.start]

    def features(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in `which`, table slot, weight) of the features of some windows."""
        rows, slots, values = [], [], []
        start, size = self.start[which], self.end[which] - self.start[which]
        for last in range(3, SPAN):
            n = np.maximum(size - last, 0)
            row = np.repeat(np.arange(len(which)), n)
            at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = [self.x[at + k] for k in range(last + 1)]
            for a, b, c in _STEPS:
                if c == last:
                    rows.append(row)
                    slots.append((near[0] << np.uint32(15)) | (near[a] << np.uint32(10)) | (near[b] << np.uint32(5)) | near[c])
                    values.append(np.full(len(row), DECAY ** (last + 1)))
        row, slot, value = (np.concatenate(v) for v in (rows, slots, values))
        return row, slot, value / _NORMS[size[row]]

    def frequencies(self, which: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """The mean of the features of some windows, by table slot."""
        weight = np.ones(len(which)) if weight is None else weight
        out = np.zeros(TABLE)
        for s in range(0, len(which), 2048):
            row, slot, value = self.features(which[s : s + 2048])
            out += np.bincount(slot, value * weight[s : s + 2048][row], TABLE)
        return (out / max(weight.sum(), 1e-9)).astype(np.float32)

    def text(self, k: int) -> bytes:
        return bytes(_SHOWN[self.x[self.start[k] : self.end[k]]])


_SHOWN = np.zeros(32, np.uint8)
_SHOWN[1:27], _SHOWN[[BLANK, DIGIT, MARK, FIRST, LATER]] = np.arange(97, 123), [32, 48, 45, 195, 169]


def fold(units: Units, which: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The weight of each subsequence in a combination of landmark windows."""
    row, slot, value = units.features(which)
    return np.bincount(slot, beta[row] * value, TABLE).astype(np.float32)


def kernel(units: Units, which: np.ndarray, landmarks: Units) -> np.ndarray:
    """Kernel of some windows (rows) with all landmark windows (columns)."""
    column, slot, value = landmarks.features(np.arange(len(landmarks)))
    order = np.argsort(slot, kind="stable")
    column, value = column[order], value[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=TABLE))))
    out = np.zeros((len(which), len(landmarks)), np.float32)
    for s in range(0, len(which), 128):
        part = which[s : s + 128]
        row, code, weight = units.features(part)
        n = first[code + 1] - first[code]
        hit = np.flatnonzero(n)
        row, code, weight, n = row[hit] * len(landmarks), code[hit], weight[hit], n[hit]
        sums, meets = np.zeros(len(part) * len(landmarks)), np.cumsum(n)
        at = 0
        while at < len(n):  # so many features that a bounded number of pairs is held
            to = max(at + 1, int(np.searchsorted(meets, meets[at] + PAIRS)))
            m = n[at:to]
            pair = np.repeat(first[code[at:to]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            sums += np.bincount(np.repeat(row[at:to], m) + column[pair], np.repeat(weight[at:to], m) * value[pair], len(sums))
            at = to
        out[s : s + len(part)] = sums.reshape(len(part), -1)
    return out


def whole(texts: list[bytes]) -> Units:
    """Each text as one window, whatever stands in it."""
    out = Units(texts)
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    out.start, out.end, out.of = bounds[:-1], np.minimum(bounds[1:] - 1, bounds[:-1] + len(_NORMS) - 1), np.arange(len(texts))
    return out


def pick_landmarks(texts: list[bytes], n: int) -> list[bytes]:
    """Up to n of the window texts that span the others best: pivoted Cholesky, largest residual first."""
    texts = list(dict.fromkeys(texts))
    units = whole(texts)
    k = kernel(units, np.arange(len(texts)), units).astype(np.float64)
    residual, rows, out = k.diagonal().copy(), np.zeros((0, len(texts))), []
    while len(out) < min(n, len(texts)):
        at = int(residual.argmax())
        if residual[at] < 0.05:
            break
        row = (k[at] - rows[:, at] @ rows) / np.sqrt(residual[at])
        rows, residual = np.vstack([rows, row]), np.maximum(residual - row**2, 0)
        residual[at] = 0
        out.append(texts[at])
    return out


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last coefficient is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        active = y * (z @ w) < 1
        za, ca = z[active], cost[active][:, None]
        new = np.linalg.solve(ridge + za.T @ (za * ca), za.T @ (ca[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


_LETTERS = re.compile(rb"[a-z]{4,}")


def inserted(text: bytes, rng: np.random.Generator) -> bytes:
    """The window with a character inserted within one of its words, or, one time in four, between all letters of it."""
    found = list(_LETTERS.finditer(text))
    if not found:
        return text
    m = found[int(rng.integers(len(found)))]
    put = (b"x", b".", b"*", b"-", b"q", b"_", b" ")[int(rng.integers(7))]
    if rng.integers(4) == 0:
        return text[: m.start()] + put.join(m.group()[k : k + 1] for k in range(len(m.group()))) + text[m.end() :]
    at = m.start() + 1 + int(rng.integers(len(m.group()) - 1))
    return text[:at] + put + text[at:]


class Half:
    """The sentences of half of the sampled documents, and what is known of their windows."""

    def __init__(self, toxic: list[tuple[str, bytes]], clean: list[tuple[str, bytes]], rng: np.random.Generator):
        self.pos, self.neg = Units([s for _, s in toxic]), Units([s for _, s in clean])
        self.bag, self.other = (np.unique([d for d, _ in part], return_inverse=True)[1][u.of] for part, u in ((toxic, self.pos), (clean, self.neg)))
        self.size = np.bincount(self.bag)
        some = np.sort(rng.choice(len(self.neg), min(len(self.neg), 2 * UNITS), replace=False))
        self.usual = self.neg.frequencies(some)
        self.hard, self.clear = np.sort(rng.permutation(some)[: UNITS // 2]), np.zeros(0, np.int64)
        self.here, self.there = np.full(len(self.pos), -np.inf), np.full(len(self.neg), -np.inf)

    def outstanding(self) -> np.ndarray:
        """Of each document, among the windows that touch no clear one, those that stand out most from clean windows."""
        pos, covered = self.pos, np.zeros(len(self.pos.x) + 1, np.int32)
        clear = self.here >= CLEAR
        np.add.at(covered, pos.start[clear], 1)
        np.add.at(covered, pos.end[clear], -1)
        taken = np.concatenate(([0], np.cumsum(covered.cumsum() > 0)))
        out = np.flatnonzero(taken[pos.end] - taken[pos.start] <= 2)  # blanks may be shared
        if not len(out):
            return out
        often = pos.frequencies(out, 1 / self.size[self.bag[out]])
        apart = pos.sums((often - self.usual) / np.sqrt(often + self.usual + 3 / len(out)))[out]
        order = np.lexsort((out, -apart, self.bag[out]))
        first = np.searchsorted(self.bag[out][order], self.bag[out][order])
        top = order[np.arange(len(order)) - first < OPEN]
        return out[top[np.argsort(-apart[top], kind="stable")]][: UNITS // 2]

    def judge(self, weights: np.ndarray, bias: float, rng: np.random.Generator) -> None:
        """Take over the values of a machine that has not seen these documents: what is peculiar to one stays low."""
        self.here, self.there = self.pos.sums(weights) + bias, self.neg.sums(weights) + bias
        best = np.full(len(self.size), -np.inf)
        np.maximum.at(best, self.bag, self.here)
        clear = np.flatnonzero((self.here >= best[self.bag] - 1e-9) & (self.here >= CLEAR) | (self.here >= 0.5))
        self.clear = np.sort(rng.permutation(clear)[: UNITS // 2])
        worst = np.argsort(-self.there, kind="stable")[: UNITS // 6]
        self.hard = np.concatenate((np.setdiff1d(self.hard, worst)[-UNITS // 2 :], worst[::-1]))


def machine(halves: list[Half], opened: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(weights, bias) of the machine trained on clear, outstanding and clean windows in the landmarks' space."""
    clear = [h.pos.text(k) for h in halves for k in h.clear]
    open_ = [h.pos.text(k) for h, some in zip(halves, opened, strict=True) for k in some]
    hard = [h.neg.text(k) for h in halves for k in h.hard]
    if not hard or not (clear or open_):
        return np.zeros(TABLE, np.float32), -1.0
    varied = [inserted(t, rng) for t in clear]
    spans = [t for k in rng.permutation(len(clear))[: SPANNING * 2 // 3] for t in (clear[k], varied[k])[: 1 + k % 2]] + open_[: max(SPANNING // 3, SPANNING - len(clear))]
    last = [h.neg.text(k) for h in halves for k in h.hard[-SPANNING // 2 // len(halves) :]]
    landmarks = whole(pick_landmarks(spans, 3 * LANDMARKS // 4) + pick_landmarks(last, LANDMARKS // 4))
    units = whole(clear + open_ + varied + hard)
    y = np.repeat([1.0, -1.0], [len(units) - len(hard), len(hard)])
    cost = np.repeat([1.0, 1 / OPEN, 0.5, 1.0], [len(clear), len(open_), len(clear), len(hard)])
    cost[y > 0] *= len(hard) / cost[y > 0].sum()
    every = np.arange(len(landmarks))
    inner = kernel(landmarks, every, landmarks)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    root = vector / np.sqrt(np.maximum(value, EIGEN)) @ vector.T
    w = svm(kernel(units, np.arange(len(units)), landmarks) @ root, y, COST * cost)
    return fold(landmarks, every, root @ w[:-1]), float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels y over values x: Newton steps, halved until they help."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(v):
        z = v[0] * x + v[1]
        return np.logaddexp(0, z).sum() - (t * z).sum() + 5e-4 * v[0] ** 2

    v = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v[0] * x + v[1], -60, 60)))
        g, r = np.array([((p - t) * x).sum() + 1e-3 * v[0], (p - t).sum()]), p * (1 - p)
        step = np.linalg.solve([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-6]], g)
        while np.abs(step).max() > 1e-9 and loss(v - step) > loss(v):
            step /= 2
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return float(v[0]), float(v[1])


class ToxicityModel:
    """Folded weights, bias, and the logistic curve of a document's highest window."""

    #: The value of a document without windows, and the least that counts.
    LOW = -2.0

    def __init__(self, toxic: list[tuple[str, bytes]], clean: list[tuple[str, bytes]]):
        """Trained on (document, sentence) pairs of toxic and of clean documents."""
        self.weights, self.bias, self.slope, self.shift = np.zeros(TABLE, np.float32), -1.0, 1.0, -3.0
        parts = [[[(d, s) for d, s in part if xxhash.xxh64_intdigest(d) % 2 == half] for part in (toxic, clean)] for half in (0, 1)]
        if not all(part for half in parts for part in half):
            parts = [[toxic, clean]] * 2  # too few to be held apart
        if toxic and clean:
            self._train(parts)

    def _train(self, parts) -> None:
        rng = np.random.default_rng(11)
        halves = [Half(*part, rng) for part in parts]
        if not all(len(h.pos) and len(h.neg) for h in halves):
            return
        for turn in range(ROUNDS + 1):
            opened = [h.outstanding() if turn < ROUNDS else h.clear[:0] for h in halves]
            made = [machine([h], [some], rng) for h, some in zip(halves, opened, strict=True)]
            for h, (weights, bias) in zip(halves, made[::-1], strict=True):
                h.judge(weights, bias, rng)
        if not any(len(h.clear) for h in halves):
            return
        # the mean of three machines, of both halves and of all, errs less than any; decisions are linear, so it is one machine
        made += [machine(halves, [h.clear[:0] for h in halves], rng)] * 2
        self.weights, self.bias = np.mean([w for w, _ in made], axis=0, dtype=np.float32), float(np.mean([b for _, b in made]))
        # a document counts midway between the machine that has not seen it and the final one
        seen = [[units.sums(self.weights) + self.bias for units in (h.pos, h.neg)] for h in halves]
        best = []
        for values, owners in (([h.here + v[0] for h, v in zip(halves, seen, strict=True)], [h.bag for h in halves]), ([h.there + v[1] for h, v in zip(halves, seen, strict=True)], [h.other for h in halves])):
            for value, owner in zip(values, owners, strict=True):
                highest = np.full(owner.max() + 1, self.LOW)
                np.maximum.at(highest, owner, value / 2)
                best.append(highest)
        x, y = np.concatenate(best), np.repeat([1.0, 0.0], [len(best[0]) + len(best[1]), len(best[2]) + len(best[3])])
        slope, shift = logistic(x, y)
        if slope > 0:
            self.slope, self.shift = slope, shift

    def decisions(self, texts: list[bytes | None]) -> np.ndarray:
        """The decision value of each text's highest window; LOW at least."""
        out = np.full(len(texts), self.LOW)
        held, of, size = [], [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            for part in parts(normal(t), CHUNK):
                held.append(part)
                of.append(k)
                size += len(part)
                if size >= CHUNK:
                    self._highest(held, of, out)
                    held, of, size = [], [], 0
        if held:
            self._highest(held, of, out)
        return out

    def _highest(self, held, of, out) -> None:
        units = Units(held)
        if len(units):
            np.maximum.at(out, np.array(of)[units.of], units.sums(self.weights) + self.bias)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.shift, -60, 60)))


def parts(text: bytes, limit: int):
    """A normalised text in parts of about limit bytes that together have its windows: a part begins again at a sentence.

    Where no sentence ends, it begins again at a word, so early that no window is lost; within a long word, where one of
    the word's inner windows begins.
    """
    at, half = 0, WINDOW // 2
    while len(text) - at > limit + 2 * WINDOW:
        cut = text.rfind(b" \0 ", at + limit // 2, at + limit)
        if cut >= 0:
            yield text[at : cut + 1]
            at = cut + 2
            continue
        cut = text.rfind(b" ", at + limit // 2, at + limit)
        again = text.rfind(b" ", at + 1, cut - WINDOW) if cut >= 0 else -1
        if again < 0:
            last = at + limit - 2 * WINDOW
            word = max(text.rfind(b" ", at, last) + 1, at)
            again = word + (last - word) // half * half
            cut = again + 2 * WINDOW
        yield text[at : cut + 1]
        at = again
    yield text[at:]


def sentences(text: bytes) -> list[bytes]:
    """The different sentences of a text, blanks around each; long ones in overlapping parts."""
    out = {}
    for s in normal(text).split(b"\0"):
        if s.strip():
            for p in parts(s, PART):
                out[p] = None
    return list(out)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> ToxicityModel:
    """Trained on sentences of at most `bound` labelled documents outside the held-out fold.

    Whole texts are cut into sentences on the executors. Sentences of toxic documents that clean ones have too are
    clean. Of what remains at most TOXIC_SENTENCES, documents in hashed order, and CLEAN_SENTENCES reach the driver.
    """
    import pyarrow as pa

    def run(batches):
        for b in slices(batches, 200):
            found = [sentences(t or b"") for t in byte_values(b.column(1))]
            of = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array([s for f in found for s in f], pa.binary())], ["doc_id", "label", "sentence"])

    rows = training_rows(docs, labels, "toxic", 3, 1, bound).select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("text")).alias("doc_id"), "text", (F.col("label") > 0).cast("int").alias("label"))
    found = checkpointed(rows.mapInArrow(run, "doc_id string, label int, sentence binary"))
    clean = found.where("label = 0").groupBy("sentence").agg(F.min("doc_id").alias("doc_id"))
    toxic = found.where("label = 1").join(clean.select("sentence"), "sentence", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id", "sentence").limit(TOXIC_SENTENCES)
    some = clean.orderBy(F.xxhash64("sentence"), "sentence").limit(CLEAN_SENTENCES)
    pairs = [part.select("doc_id", "sentence").toArrow() for part in (toxic, some)]
    return ToxicityModel(*[sorted(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)) for t in pairs])


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs with score double (or another `name`), the probability of label 1; all other columns as they are.

    A column of docs that has this name is replaced.

    Whole texts count. Null, empty and wordless texts score as documents without windows; so does every
    text if there are no labels of both kinds. Repeated rows score alike.
    """
    import pyarrow as pa

    docs = docs.drop(name)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(byte_values(b.column(at))))], [*b.schema.names, name])

    return docs.mapInArrow(run, score_schema(docs, name))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
