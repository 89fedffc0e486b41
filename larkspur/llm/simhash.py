"""SimHash near-duplicates, found exactly with a forest of vantage-point trees over Hamming distance.

Fingerprints that differ in at most 4 of 64 bits differ in at most one bit within one of a family of masks: three disjoint
masks of 21 bits, or, for more fingerprints, a few overlapping ones of 25 to 40 bits. There is one tree for each mask,
searched with radius 1 by the distance within the mask. Every node has a vantage point of its own, a sampled
fingerprint, and a part of the mask that no other node on its path uses; its branches are the rings of distances from
the vantage point within that part. By the triangle inequality two fingerprints' rings differ by no more than their
distance within the part, so with one bit to spend on the whole path a neighbour is in the same ring at every node but
at most one, and there in the next ring; all other branches are pruned. A fingerprint is dealt to its own shard (leaf)
and to the shards that its ball overlaps on the outer side; every shard compares what it owns with all that reached it,
by the full distance. Nothing within the bound is lost and nothing beyond it is linked.

Trees have as many levels as leave some SHARD_TARGET fingerprints in a shard, whatever their number: the comparisons of
a fingerprint do not grow with the table. Nodes are not stored: a node is the hash of its path, which picks its
vantage point from the sample, so the depth is not bounded by the sample.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, combinations_with_replacement
from math import log2

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import LocalForest, byte_values, checkpointed, components, grouped_batches, segments, slices, split_hot_cells, table

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Bounded sample of fingerprints from which vantage points are taken.
VANTAGE_SAMPLE = 4096
#: Fingerprints wanted in a shard; a shard with more than SHARD_ROWS rows is cut into blocks.
SHARD_TARGET, SHARD_ROWS = 64, 16384
#: Mask families, by (equal blocks of the 64 bits, blocks in a mask).
FAMILIES = [(3, 1), (5, 2), (6, 3), (7, 4), (8, 5)]
#: Bits in a node's part of the mask and what a level of such nodes tells, in bits.
PARTS = {3: 1.811, 2: 1.5, 1: 1.0}


@cache
def mask_family(radius: int, blocks: int, chosen: int) -> tuple[int, ...] | None:
    """Masks of `chosen` blocks such that `radius` differing bits leave at most one in some mask; None if there are none.

    Greedy cover of all ways to spread the bits over the blocks.
    """
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    open_ = {tuple(spread.count(b) for b in range(blocks)) for spread in combinations_with_replacement(range(blocks), radius)}
    covers = {s: {e for e in open_ if sum(e[b] for b in s) <= 1} for s in combinations(range(blocks), chosen)}
    out = []
    while open_:
        best = max(covers, key=lambda s: len(covers[s] & open_))
        if not covers[best] & open_:
            return None
        open_ -= covers[best]
        out.append(sum(1 << bit for b in best for bit in range(edges[b], edges[b + 1])))
    return tuple(out)


def forest(n: int, sample: np.ndarray, radius: int = RADIUS) -> list[list[np.uint64]]:
    """For each tree the parts of its mask by level, for about n distinct fingerprints.

    The family with the fewest trees that can tell n / SHARD_TARGET shards apart is taken, with the widest parts
    that do. Bits that split the sample most evenly come first.
    """
    need, plan = max(0.0, log2(max(1, n) / SHARD_TARGET)), None
    for blocks, chosen in FAMILIES:
        masks = mask_family(radius, blocks, chosen)
        if masks is None:
            continue
        least = min(m.bit_count() for m in masks)
        plan = masks, 1, least
        fits = [(w, -int(-need // told)) for w, told in PARTS.items() if -int(-need // told) * w <= least]
        if fits:
            plan = masks, *fits[0]
            break
    if plan is None:
        raise ValueError("the masks find distances up to 5")
    masks, width, levels = plan
    spread = np.abs(np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(0) - 0.5) if len(sample) else np.zeros(BITS)
    out = []
    for m in masks:
        bits = sorted((b for b in range(BITS) if m >> b & 1), key=lambda b: (spread[b], b))
        out.append([np.uint64(sum(1 << b for b in bits[k * width : (k + 1) * width])) for k in range(levels)])
    return out


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of `shingle` words, space-joined."""
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = len(words) - shingle + 1
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 without words. Long texts are hashed part by part."""
    ones, n, carried = np.zeros(BITS, np.int64), 0, []
    for part in segments(text):
        words = carried + part.lower().split()
        if len(words) < shingle:
            carried = words
            continue
        hashes = shingle_hashes(words, shingle)
        carried, n = words[len(words) - shingle + 1 :], n + len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every row; a null text is an empty one."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t or b"", shingle) for t in byte_values(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _hashed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paths(u: np.ndarray, tree: int, parts: list[np.uint64], vantage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row): the shard of every fingerprint, first, and then the shards that its ball overlaps on the outer side."""

    def rings(node, who):
        return np.bitwise_count((u[who] ^ vantage[(node % np.uint64(len(vantage))).astype(np.int64)]) & part).astype(np.uint64)

    def child(node, ring):
        return _hashed(node + (ring + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    everyone = np.arange(len(u))
    home = np.full(len(u), _hashed(np.array([tree + 1], np.uint64))[0])
    node, who = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in parts:
        node = child(node, rings(node, who))  # a path that left its ring once has no bit to spend
        ring = rings(home, everyone)
        inner = np.flatnonzero(ring < np.uint64(int(part).bit_count()))
        node = np.concatenate((node, child(home[inner], ring[inner] + np.uint64(1))))
        who = np.concatenate((who, inner))
        home = child(home, ring)
    return np.concatenate((home, node)).view(np.int64), np.concatenate((everyone, who))


def deal(fps: DataFrame, trees: list[list[np.uint64]], sample: np.ndarray) -> DataFrame:
    """Rows (cell long, fp, node, home, salt) for each fingerprint's own shards and the ones it overlaps; fps has fp and node."""
    import pyarrow as pa

    vantage = sample.view(np.uint64) if len(sample) else np.zeros(1, np.uint64)

    def run(batches):
        for b in slices(batches, 1 << 13):
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for t, parts in enumerate(trees):
                cell, who = paths(fp.view(np.uint64), t, parts, vantage)
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0).take(rows), b.column(1).take(rows), pa.array(np.arange(len(who)) < len(fp))], ["cell", "fp", "node", "home"])

    out = fps.select("fp", "node").mapInArrow(run, "cell long, fp long, node long, home boolean")
    return out.withColumn("salt", F.xxhash64("node"))


def search_tasks(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The comparisons that find every pair of fps (fp, node) within radius: rows (cell, fp, node, a, b, role)."""
    n = fps.count()
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(VANTAGE_SAMPLE).collect()], np.int64)
    return split_hot_cells(deal(fps, forest(n, sample, radius), sample), SHARD_ROWS)


def _near(tasks: DataFrame, radius: int, found, schema: str) -> DataFrame:
    """What found(node, left, right, tiles) makes of each task; a tile is (rows of left, distances to right)."""

    def run(batches):
        for group in grouped_batches(batches, ["cell", "a", "b"]):
            if group.num_rows < 2:
                continue
            node, fp, role = (group.column(c).to_numpy() for c in ("node", "fp", "role"))
            order = np.argsort(node, kind="stable")
            node, fp, role = node[order], fp[order].view(np.uint64), role[order]
            left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            if len(left) and len(right):
                step = max(1, (1 << 21) // len(right))
                tiles = ((left[at : at + step], np.bitwise_count(fp[left[at : at + step]][:, None] ^ fp[right][None, :])) for at in range(0, len(left), step))
                yield from found(node, right, tiles)

    shards = tasks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return shards.mapInArrow(lambda batches: _gathered(run(batches)), schema)


def _gathered(pairs):
    import pyarrow as pa

    src, dst, held = [], [], 0
    for s, d in pairs:
        src.append(s)
        dst.append(d)
        held += len(s)
        if held > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])
            src, dst, held = [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])


def shard_links(tasks: DataFrame, radius: int) -> DataFrame:
    """(src, dst): for every task a spanning forest of its links, never all pairs."""

    def found(node, right, tiles):
        sets = LocalForest(len(node))
        for i, distance in tiles:
            x, y = np.nonzero(distance <= radius)
            sets.link(i[x], right[y])
        # a row may stand in a task twice, compared from and compared with
        same = np.flatnonzero(node[1:] == node[:-1])
        sets.link(same, same + 1)
        child = np.flatnonzero(node[sets.parent] != node)
        yield node[child], node[sets.parent[child]]

    return _near(tasks, radius, found, "src long, dst long")


def nearest_pairs(tasks: DataFrame, radius: int, best: int) -> DataFrame:
    """(src, dst) with src < dst: in every task, each node's `best` nearest others within radius."""

    def found(node, right, tiles):
        for i, distance in tiles:
            distance[node[i][:, None] == node[right][None, :]] = 255
            at = np.arange(len(i))
            for _ in range(min(best, len(right))):
                y = distance.argmin(1)
                near = np.flatnonzero(distance[at, y] <= radius)
                a, b = node[i[near]], node[right[y[near]]]
                yield np.minimum(a, b), np.maximum(a, b)
                distance[at, y] = 255

    return _near(tasks, radius, found, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs (doc_id, text, ...).

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows each keep
    their row; two texts under one doc_id are tied only by their fingerprints. Rows without a doc_id are
    searched like any other: they tie the groups they link, and component_id is the smallest doc_id that is not
    null, or null in a group of such rows only. radius may be 0 to 5: the masks bound the search to that. An
    empty table gives an empty result.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    reps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(shard_links(search_tasks(reps.select("fp", F.col("fp").alias("node")), radius), radius))
    rooted = checkpointed(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(named, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE: dict[str, str] = {}
