"""Language identification by prediction by partial matching (PPM).

One byte context tree for each language, orders 3 to 0, is counted over the whole texts of a bounded sample of labelled
documents and then frozen. A byte costs -log2 of its PPM-C probability: in the longest known context, or, after
an escape, in the next shorter one, with the bytes seen in longer contexts excluded, down to a uniform
distribution over what is left of the 256 bytes. As the statistics are frozen, the cost is a function of the context node
and the byte, so all costs are computed once; bytes that no language has shown cost the same everywhere and share a
column. A text is scored by three table look-ups a byte and language.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import byte_chunks, byte_values, held_out, slices, table

ORDER = 3
#: The fit's bounds: texts for each language, languages (the commonest ones); uses that a context of the tree needs.
SAMPLE_DOCS, MOST_LANGUAGES, LEAST_USES = 300, 256, 8
CHUNK = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def folded(buffer: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals made small."""
    out = buffer.copy()
    out[(out >= 65) & (out <= 90)] += 32
    accented = np.flatnonzero(buffer[:-1] == 0xC3) + 1
    wide = accented[(out[accented] >= 0x80) & (out[accented] <= 0x9E) & (out[accented] != 0x97)]
    out[wide] += 0x20
    return out


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of each byte of the texts with the ORDER bytes before it, line breaks before a text's start."""
    found, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pad = b"\n" * ORDER
    for s, e in byte_chunks(texts, 1 << 22):
        data = folded(np.frombuffer(pad + pad.join(texts[s:e]), np.uint8)).astype(np.uint32)
        code = data[3:] | (data[2:-1] << np.uint32(8)) | (data[1:-2] << np.uint32(16)) | (data[:-3] << np.uint32(24))
        ends = np.cumsum([len(t) + ORDER for t in texts[s:e]])[:-1] - ORDER
        code = np.delete(code, (ends[:, None] + np.arange(ORDER)).ravel())  # the breaks between texts are no bytes of theirs
        more, n = np.unique(code, return_counts=True)
        found, at = np.unique(np.concatenate((found, more)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n)), len(found)).astype(np.int64)
    return found, counts


class Tree:
    """A language's frozen context tree: for every context the deepest known node, for every node all bytes' costs."""

    def __init__(self, code: np.ndarray, uses: np.ndarray, classes: np.ndarray, size: int):
        sym, near, mid, far = (classes[(code >> np.uint32(8 * k)) & np.uint32(255)].astype(np.int64) for k in range(4))
        context = [np.zeros_like(near), near, mid * size + near, (far * size + mid) * size + near]
        nodes, parents, counts = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.bincount(sym, uses, size)[None, :]]
        first = [0, 1]
        for order in range(1, ORDER + 1):
            known, at = np.unique(context[order], return_inverse=True)
            enough = np.bincount(at, uses) >= LEAST_USES
            # a context is known only if its suffix is
            suffix = known % size ** (order - 1)
            place = np.searchsorted(nodes[-1], suffix)
            enough &= nodes[-1][np.minimum(place, len(nodes[-1]) - 1)] == suffix
            number = np.cumsum(enough) - 1
            inside = enough[at]
            counts.append(np.bincount(number[at[inside]] * size + sym[inside], uses[inside], enough.sum() * size).reshape(-1, size))
            nodes.append(known[enough])
            parents.append(first[order - 1] + place[enough])
            first.append(first[-1] + int(enough.sum()))
            if not enough.any():
                break
        parent = np.concatenate(parents)
        self.costs = code_lengths(np.concatenate(counts), parent, len(nodes) - 1).astype(np.float32).ravel()
        # the two nearest bytes give a row, the third a place in it
        one, two, three = (nodes[k] if k < len(nodes) else np.zeros(0, np.int64) for k in (1, 2, 3))
        base = np.zeros(size, np.int32)
        base[one] = 1 + np.arange(len(one))
        self.rows = np.tile(np.arange(size, dtype=np.int32), size)
        self.rows[two] = size + np.arange(len(two))
        deepest = np.concatenate((base, 1 + len(one) + np.arange(len(two), dtype=np.int32)))
        self.nodes = np.repeat(deepest[:, None], size, axis=1).astype(np.int32)
        self.nodes[self.rows[three % (size * size)], three // (size * size)] = 1 + len(one) + len(two) + np.arange(len(three))
        self.nodes = self.nodes.ravel()


def code_lengths(counts: np.ndarray, parent: np.ndarray, depth: int) -> np.ndarray:
    """PPM-C code lengths in bits of every symbol in every node, with exclusion.

    Symbol 0 stands for each of the bytes without a symbol of its own.
    """
    n, a = counts.shape
    others = 257 - a
    at, live = np.arange(n), np.ones((n, a), bool)
    left, prob, done = np.ones((n, 1)), np.zeros((n, a)), np.zeros(n, bool)
    for _ in range(depth + 1):
        c = np.where(live, counts[at], 0.0) * ~done[:, None]
        seen = c > 0
        uses, kinds = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        known = uses > 0
        scale = np.divide(left, uses + kinds, out=np.zeros_like(left), where=known)
        prob += scale * c
        left = np.where(known, scale * kinds, left)
        live &= ~seen
        done |= at == 0
        at = parent[at]
    rest = live[:, 1:].sum(1, keepdims=True) + others
    prob += np.where(live, left / np.maximum(rest, 1), 0.0)
    if not others:
        prob[:, 0] = prob[:, 1:].min(1)
    whole = prob[:, 1:].sum(1, keepdims=True) + others * prob[:, :1]
    return -np.log2(np.maximum(prob / whole, 1e-30))


class PpmModel:
    """Frozen context trees of several languages over a common alphabet."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counted: for each language the codes and counts that grams() gives."""
        self.langs = sorted(counted)
        shown = np.zeros(256, bool)
        for code, _ in counted.values():
            for k in range(4):
                shown[np.unique((code >> np.uint32(8 * k)) & np.uint32(255))] = True
        self.size = int(shown.sum()) + 1
        self.classes = np.where(shown, np.cumsum(shown), 0).astype(np.int32)
        self.trees = [Tree(*counted[k], self.classes, self.size) for k in self.langs]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text under each language, in bits."""
        pad = b"\n" * ORDER
        out = np.zeros((len(texts), len(self.langs)))
        for s, e in byte_chunks(texts, CHUNK):
            if e - s == 1 and len(texts[s]) > CHUNK:
                data = pad + texts[s]
                # one byte more to the left, so that capitals of two bytes are not cut
                for at in range(0, len(data) - ORDER, CHUNK):
                    lead = min(at, 1)
                    for k, cost in enumerate(self._costs(data[at - lead : at + CHUNK + ORDER])):
                        out[s, k] += cost[lead:].sum(dtype=np.float64)
                continue
            ends = np.cumsum([len(t) for t in texts[s:e]]) + ORDER * np.arange(e - s)
            starts = ends - [len(t) for t in texts[s:e]]
            for k, cost in enumerate(self._costs(pad + pad.join(texts[s:e]))):
                sums = np.concatenate(([0.0], np.cumsum(cost, dtype=np.float64)))
                out[s:e, k] = sums[ends] - sums[starts]
        return out

    def _costs(self, data: bytes):
        """For each language the cost of every byte after the first ORDER."""
        c = self.classes[folded(np.frombuffer(data, np.uint8))]
        size = np.int32(self.size)
        pair, far, sym = c[1:-2] * size + c[2:-1], c[:-3], c[3:]
        for tree in self.trees:
            node = tree.nodes.take(tree.rows.take(pair) * size + far)
            yield tree.costs.take(node.astype(np.int64) * size + sym)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its posterior probability, and bits a byte under it; `und`, 0, 0 without letters."""
        worded = [i for i, t in enumerate(texts) if t and has_letter(t)]
        langs, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if worded and self.langs:
            bits = self.bits([texts[i] for i in worded])
            best = bits.argmin(1)
            post = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            for i, b, p, n in zip(worded, best.tolist(), post.tolist(), bits.min(1).tolist(), strict=True):
                langs[i], score[i], rate[i] = self.langs[b], p, n / len(texts[i])
        return langs, score, rate


_ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(_LETTER.search(text.decode("utf-8", "replace")))


def sample_by_language(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text binary): at most per_lang labelled training rows of each of the commonest languages, by a hash of id and text.

    The draw leaves some three times per_lang rows of a language before they are ranked, so no task ranks a language's rows.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    rows = usable.select("lang", "doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("__row"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    # rows equal in all must not be drawn together: their place in the file counts too
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", "__row"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(counts), "lang").where(draw < 3 * per_lang / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), "text"), "doc_id", "__row")
    return drawn.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_lang).select("lang", "text")


def fit(docs: DataFrame) -> PpmModel:
    """Trees counted on the executors over the sample's whole texts; the driver gets each language's counts."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches, 200):
            held: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
            for lang, texts in held.items():
                code, n = grams(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counted = sample_by_language(docs).mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = np.array(counted.column(0).to_pylist(), object), counted.column(1).to_numpy().astype(np.uint32), counted.column(2).to_numpy()
    order = np.argsort(code, kind="stable")
    lang, code, n = lang[order], code[order], n[order]
    return PpmModel({k: (code[lang == k], n[lang == k]) for k in dict.fromkeys(lang.tolist())})


def identify(docs: DataFrame, model: PpmModel, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred string and score double (or other `names`, a third one for bits a byte); every other column as it is.

    Columns of docs that have these names are replaced.

    A null text, or one without a letter (Unicode category L), is `und` with score 0; so is every text if nothing
    was learned, as from an empty table. Repeated rows are scored alike.
    """
    import pyarrow as pa

    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            langs, score, rate = shared.value.predict(byte_values(b.column(at)))
            made = [pa.array(langs, pa.string()), pa.array(score), pa.array(rate)][: len(names)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *names])

    kinds = [(n, k) for n, k in zip(names, ("string", "double", "double"), strict=False)]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, *kinds])
    return docs.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE: dict[str, str] = {}
