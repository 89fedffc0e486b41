"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts over the whole text's bytes and words. The trees are grown here on binned features,
level by level from gradient histograms, and flattened into arrays (feature, threshold, children, value); a
batch of documents walks all trees by array indexing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import byte_chunks, byte_values, held_out, segments, slices, table
from larkspur.llm.labelled import score_schema, training_rows

#: Most labelled rows that the trees are fitted on.
SAMPLE = 8000
TREES, DEPTH, RATE, EDGES, LEAST_ROWS, LAMBDA = 80, 4, 0.15, 63, 8, 1.0
THRESHOLD, CHUNK = 0.7, 1 << 19
KINDS = 11
_KIND = np.full(256, 8, np.uint8)  # 8: other marks
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:192], _KIND[192:] = 0, 1, 2, 9, 10
for _k, _chars in ((3, b" \t\x0b\x0c\r"), (4, b"\n"), (5, b".,;:?'\""), (6, b"!"), (7, b"#$%&*@^~+=|<>_\\/")):
    _KIND[list(_chars)] = _k
_MIX = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
NAMES = [
    "log_words", "log_bytes", "word_length", "word_length_spread", "long_words", "single_letters", "upper_share", "digit_share", "high_share",
    "breaks_per_word", "stops_per_word", "bangs_per_word", "symbols_per_word", "marks_per_word", "distinct_words", "adjacent_repeats",
    "commonest_word", "distinct_triples", "bangs_at_ends", "symbols_at_ends", "bare_symbols",
]


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes of each owner, and how often its commonest occurs."""
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(first, len(key))))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of len(NAMES) statistics for each text; all zero for a null or empty one."""
    return np.concatenate([_statistics([t or b"" for t in texts[s:e]]) for s, e in byte_chunks(texts, CHUNK)]) if texts else np.zeros((0, len(NAMES)))


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Counts of each text's kinds of bytes; owner, length, hash and last kind of byte of each word."""
    n = len(texts)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # a blank ends every text
    kind = _KIND[data]
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) + 1 for t in texts])
    count = np.bincount(doc * np.int32(KINDS) + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    count[:, 3] -= 1
    blank = (kind == 3) | (kind == 4)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return count, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), kind[:0]
    lead = np.zeros(len(data), np.int64)
    lead[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _MIX[(np.arange(len(data)) - lead) & 63])
    hashes = np.add.reduceat(value, starts)
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return count, doc[starts].astype(np.int64), ends - starts, hashes, kind[ends - 1]


def _statistics(texts: list[bytes]) -> np.ndarray:
    n, sizes = len(texts), np.array([len(t) for t in texts], np.int64)
    if n == 1 and len(texts[0]) > 2 * CHUNK:  # a long text's words are gathered part by part
        parts = [_words([part]) for part in segments(texts[0], CHUNK)]
        count = sum(p[0] for p in parts)
        owner, length, hashes, tail = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
    else:
        count, owner, length, hashes, tail = _words(texts)
    words = np.bincount(owner, minlength=n).astype(float)
    per = np.maximum(words, 1)
    distinct, most = _distinct(owner, hashes, n)
    same = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    repeats = np.bincount(owner[1:][same], minlength=n)
    triple = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    joint = (hashes[triple] * np.uint64(3)) ^ (hashes[triple + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((hashes[triple + 2] << np.uint64(7)) | (hashes[triple + 2] >> np.uint64(57)))
    joint = (joint ^ (joint >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    triples, _ = _distinct(owner[triple], joint, n)
    of_triples = np.bincount(owner[triple], minlength=n)
    mean = np.bincount(owner, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / per - mean**2, 0))
    share = lambda hit: np.bincount(owner[hit], minlength=n) / per
    letters = np.maximum(count[:, 0] + count[:, 1] + count[:, 10], 1)
    size = np.maximum(sizes, 1)
    columns = [
        np.log1p(words), np.log1p(sizes), mean, spread, share(length > 14), share(length == 1), count[:, 1] / letters, count[:, 2] / size, count[:, 10] / size,
        count[:, 4] / per, count[:, 5] / per, count[:, 6] / per, count[:, 7] / per, count[:, 8] / per, distinct / per, repeats / per,
        most / per, np.where(of_triples > 0, triples / np.maximum(of_triples, 1), 1.0) * (words > 0), share(tail == 6), share(tail == 7), share((tail == 7) & (length == 1)),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


class BoostedTrees:
    """Boosted regression trees on the logistic loss, kept as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = float(y.mean()) if len(y) else 0.5
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.feature, self.limit, self.child, self.value, self.roots = [], [], [], [], []
        if len(y) and 0 < y.mean() < 1:
            self._grow(x, y.astype(float))
        self.feature, self.limit = np.array(self.feature, np.int32), np.array(self.limit, float)
        self.child, self.value = np.array(self.child, np.int32).reshape(-1, 2), np.array(self.value, float)

    def _grow(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, EDGES + 2)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        width = EDGES + 1
        flat = bins + np.arange(x.shape[1]) * width
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            raw += self._tree(flat, bins, edges, width, grad, hess)

    def _tree(self, flat, bins, edges, width, grad, hess) -> np.ndarray:
        at = np.full(len(grad), self._node())
        self.roots.append(int(at[0]))
        level = [int(at[0])]
        for depth in range(DEPTH + 1):
            following = []
            for node in level:
                rows = np.flatnonzero(at == node)
                g, h = grad[rows].sum(), hess[rows].sum()
                self.value[node] = -RATE * g / (h + LAMBDA)
                if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
                    continue
                part, total = flat[rows].ravel(), bins.shape[1] * width
                wide = np.repeat(np.arange(len(rows)), bins.shape[1])
                hg, hh, hn = (np.bincount(part, w, total).reshape(-1, width).cumsum(1)[:, :-1] for w in (grad[rows][wide], hess[rows][wide], None))
                gain = hg**2 / (hh + LAMBDA) + (g - hg) ** 2 / (h - hh + LAMBDA) - g**2 / (h + LAMBDA)
                gain[(hn < LEAST_ROWS) | (len(rows) - hn < LEAST_ROWS)] = -1
                f, cut = divmod(int(gain.argmax()), width - 1)
                if gain[f, cut] <= 1e-6 or cut >= len(edges[f]):
                    continue
                low, high = self._node(), self._node()
                self.feature[node], self.limit[node], self.child[node] = f, float(edges[f][cut]), [low, high]
                at[rows] = np.where(bins[rows, f] > cut, high, low)
                following += [low, high]
            level = following
        return np.array(self.value)[at]

    def _node(self) -> int:
        self.feature.append(0)
        self.limit.append(np.inf)  # a leaf: all go left, to itself
        self.child.append([len(self.value)] * 2)
        self.value.append(0.0)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = self.child[at, (x[rows, self.feature[at]] > self.limit[at]).astype(np.int8)]
            raw += self.value[at]
        return 1 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> BoostedTrees:
    """Trees fitted on the whole texts of at most `bound` labelled documents outside the held-out fold."""
    import pyarrow as pa

    rows = training_rows(docs, labels, "quality", 4, 2, bound)

    def run(batches):
        for b in slices(batches):
            x = statistics(byte_values(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label").mapInArrow(run, "doc_id string, label int, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    return BoostedTrees(np.array([r["x"] for r in found]).reshape(-1, len(NAMES)), np.array([r["label"] for r in found], float))


def score(docs: DataFrame, model: BoostedTrees, name: str = "score") -> DataFrame:
    """docs with score double (or another `name`), the probability of label 1; all other columns as they are.

    A column of docs that has this name is replaced.

    Null and empty texts have zero statistics and are scored like any other; repeated rows score alike.
    Without labels, or with one label only, every score is the share of label 1 (0.5 without any).
    """
    import pyarrow as pa

    docs = docs.drop(name)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            p = shared.value.predict(statistics(byte_values(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, name])

    return docs.mapInArrow(run, score_schema(docs, name))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE: dict[str, str] = {}
