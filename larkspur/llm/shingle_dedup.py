"""SimHash near-duplicates carried to a Jaccard bound: groups of texts whose five-word shingles have similarity 0.8 or more.

A text's set is the XXH64 of every run of five words (a shorter text is one shingle). Texts with equal sets are one
node. Candidates come from the vantage-point trees over the nodes' SimHash fingerprints first: each node's nearest ones within
the trees' radius. Two sets at similarity 0.8 differ in some 10 of 64 bits, more than any exact search of the trees can reach, so
what the fingerprints leave apart is proposed by MinHash: 200 values in 40 bands of five, of which two nodes at similarity 0.8
share none with probability (1 - 0.8^5)^40 = 1.3e-7. A pair belongs to the first band that it shares. Within a band's bucket the pairs
of different groups whose signatures may reach the bound are candidates; the nodes that have one meet there again with
their whole sets, where candidates are verified, the most alike first, and those that are one group by then are
passed over. So what leaves a task is a spanning forest of its verified links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import byte_values, checkpointed, components, grouped_batches, segments, slices, split_hot_cells
from larkspur.llm.simhash import BITS, RADIUS, SEED, nearest_pairs, search_tasks, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND = 40, 5
#: Signature values of 200 that must agree for a pair to be verified: five deviations below what 0.8 shows.
LEAST_AGREEING = 130
#: Nearest fingerprints of a node in a shard.
NEAREST = 3
#: A bucket with more rows is cut into blocks.
BUCKET_ROWS = 2048

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, BANDS * BAND, np.uint64)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, BAND), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text in order; empty without words."""
    found, carried = [np.empty(0, np.uint64)], []
    for part in segments(text):
        words = carried + part.lower().split()
        if len(words) < SHINGLE:
            carried = words
            continue
        found.append(np.unique(shingle_hashes(words, SHINGLE)))
        carried = words[len(words) - SHINGLE + 1 :]
    if len(found) == 1 and carried:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64))
    return np.unique(np.concatenate(found))


def least_values(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    out = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[at : at + 1024, None] ^ _XOR) * _TIMES).min(0), out=out)
    return out


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes; 0 for an empty one."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 15):
        ones += np.unpackbits(shingles[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0])


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, size, fp, signature, marks, buckets) of every row; a null text is an empty one.

    marks has 32 bits of each bucket, which tell the bands that two nodes share.
    """
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            node, size, fp, signature, marks, buckets = [], [], [], [], [], []
            for t in byte_values(b.column(2)):
                s = shingle_set(t or b"")
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                size.append(len(s))
                fp.append(fingerprint(s))
                if len(s):
                    m = least_values(s)
                    signature.append((m >> np.uint64(40)).astype(np.uint8).tobytes())
                    folded = (m.reshape(BANDS, BAND) * _FOLD).sum(1, dtype=np.uint64)
                    marks.append((folded >> np.uint64(32)).astype(np.uint32).tobytes())
                    buckets.append(folded.view(np.int64))
                else:
                    signature.append(b"")
                    marks.append(b"")
                    buckets.append(np.empty(0, np.int64))
            cols = [b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(signature, pa.binary()), pa.array(marks, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "node", "size", "fp", "signature", "marks", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, node long, size long, fp long, signature binary, marks binary, buckets array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles array<long>) of the rows (node, text)."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches, 200):
            sets = [shingle_set(t or b"").view(np.int64) for t in byte_values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _candidates(group):
    """(left row, right row, agreeing values) of a task's pairs that belong to its band, tile by tile; each pair once."""
    node, size, of, role, band = (group.column(c).to_numpy() for c in ("node", "size", "of", "role", "band"))
    left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(left) or not len(right) or (of == of[0]).all():
        return
    signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(node), -1)
    marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint32).reshape(len(node), -1)[:, : band[0]]
    step = max(1, (1 << 23) // (len(right) * BANDS * BAND))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        agree = (signature[i][:, None, :] == signature[right][None, :, :]).sum(2, dtype=np.int16)
        least, most = np.minimum(size[i][:, None], size[right]), np.maximum(size[i][:, None], size[right])
        agree[(of[i][:, None] == of[right]) | (5 * least < 4 * most) | (node[i][:, None] >= node[right])] = 0
        x, y = np.nonzero(agree >= LEAST_AGREEING)
        value, x, y = agree[x, y], i[x], right[y]
        first = np.concatenate([~(marks[x[k : k + 4096]] == marks[y[k : k + 4096]]).any(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, bool)
        yield x[first], y[first], value[first]


_TASK = ["cell", "a", "b"]


def with_candidates(tasks: DataFrame) -> DataFrame:
    """(cell, a, b, role, band, node): the rows of each task that have a candidate in it."""
    import pyarrow as pa

    def run(batches):
        for group in grouped_batches(batches, _TASK):
            if group.num_rows < 2:
                continue
            rows = np.unique(np.concatenate([np.zeros(0, np.int64), *[part for x, y, _ in _candidates(group) for part in (x, y)]]))
            if len(rows):
                yield from group.select([*_TASK, "role", "band", "node"]).take(pa.array(rows)).combine_chunks().to_batches()

    shards = tasks.repartition(*_TASK).sortWithinPartitions(*_TASK)
    return shards.mapInArrow(run, "cell long, a int, b int, role int, band int, node long")


def task_links(tasks: DataFrame) -> DataFrame:
    """(src, dst): a spanning forest of each task's verified links; tasks has the nodes' shingles too."""
    import pyarrow as pa

    def run(batches):
        for group in grouped_batches(batches, _TASK):
            found = list(_candidates(group))
            if not found:
                continue
            x, y, value = (np.concatenate([f[k] for f in found]) for k in range(3))
            node, shingles = group.column("node").to_numpy(), group.column("shingles").combine_chunks()
            flat, at = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shingles.offsets.to_numpy()
            at = at - at[0]
            # rows of one group, and the two rows that a node may have here, are together from the start
            label = np.unique(group.column("of").to_numpy(), return_inverse=True)[1].tolist()
            up = list(range(max(label) + 1))

            def root(k, up=up):
                while up[k] != k:
                    up[k] = k = up[up[k]]
                return k

            src, dst = [], []
            for k in np.argsort(-value, kind="stable").tolist():
                i, j = int(x[k]), int(y[k])
                p, q = root(label[i]), root(label[j])
                if p == q:
                    continue
                one, two = flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]]
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 5 * common >= 4 * (len(one) + len(two) - common):
                    up[max(p, q)] = min(p, q)
                    src.append(node[i])
                    dst.append(node[j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    shards = tasks.repartition(*_TASK).sortWithinPartitions(*_TASK)
    return shards.mapInArrow(run, "src long, dst long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst): the pairs whose sets have at least the similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(common * 5 >= 4 * (F.size("set_a") + F.size("set_b") - common)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, group) of every row: rows of one group are linked by pairs of similarity 0.8 or more.

    key is text_key() of the row; rows without a doc_id are rows like any other. Texts without a word are one group.
    """
    rows = checkpointed(signatures(docs))
    held = ("size", "fp", "signature", "marks", "buckets")
    nodes = rows.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in held], F.min("key").alias("key"))
    dealt = nodes.select("node", F.posexplode("buckets").alias("band", "cell"))
    shared = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    met = checkpointed(dealt.join(shared, "cell"))
    known = checkpointed(nodes.drop("buckets").join(met.select("node").distinct(), "node", "left_semi"))
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).join(known.select("key", "node"), "key")
    sets = checkpointed(shingle_sets(texts.groupBy("node").agg(F.first("text").alias("text"))))
    near = nearest_pairs(search_tasks(known.select("fp", "node")), RADIUS, NEAREST)
    links = checkpointed(verified(near.toDF("a", "b"), sets))
    roots = checkpointed(components(links))
    labelled = checkpointed(known.join(roots, "node", "left").select("node", "size", "signature", "marks", F.coalesce("root", "node").alias("of")))
    groups = met.join(labelled.select("node", "of"), "node")
    apart = groups.groupBy("cell").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select("cell")
    here = met.join(apart, "cell").join(labelled, "node").withColumns({"home": F.lit(True), "salt": F.xxhash64("node")})
    open_ = checkpointed(with_candidates(split_hot_cells(here, BUCKET_ROWS)))
    more = checkpointed(task_links(open_.join(labelled, "node").join(sets, "node")))
    roots = components(links.union(more))
    return rows.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("group"))
