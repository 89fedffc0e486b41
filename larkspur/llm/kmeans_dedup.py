"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Centroids are fitted on a sample; their number grows with the square root of the number of distinct vectors n, so that
cells do too, and the work of all cells together grows as n ** 1.5. Each distinct vector belongs to the cell of its
nearest centroid and visits the cells of the next nearest ones, a fixed number of them: a linked pair is found where
either vector's own cell is visited by the other. Every pair found is verified in double precision. With exact=True a
vector visits instead every later cell that its neighbourhood reaches: a unit vector within cosine t lies at most
sqrt(2 - 2t) away, so it can be nearest to centroid j only if this one is that close to the bisector of its own
centroid and j. That bound loses no pair, but prunes little where vectors spread evenly over many dimensions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import LocalForest, checkpointed, components, grouped_batches, split_hot_cells, table

THRESHOLD = 0.9
#: Nearest cells that a vector is compared in, its own included.
PROBES = 6
#: Sampled vectors for each centroid, rounds of the fit, rows of a cell that one task compares.
SAMPLE, ROUNDS, CELL_ROWS = 8, 8, 16384
TILE = 1 << 21


def cell_count(vectors: int) -> int:
    return max(1, -(-int(vectors**0.5) // 2))


def _keys(x: Column) -> list[Column]:
    """128 bits that tell vectors apart."""
    return [F.xxhash64(x).alias("k1"), F.xxhash64(F.lit("second"), x).alias("k2")]


def directions(vectors: DataFrame) -> DataFrame:
    """(k1, k2, x array<double>, rep, copies) for each distinct vector that can link with anything."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("x", lambda v: v != 0)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = x.where(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True))).where(some).select("vec_id", "x", *_keys(F.col("x")))
    return good.groupBy("k1", "k2").agg(F.first("x").alias("x"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from a seeded start; an empty cell keeps its centroid."""
    points = unit(sample)
    start = np.random.default_rng(7).choice(len(points), min(k, len(points)), replace=False)
    centres = points[np.sort(start)]
    for _ in range(rounds):
        own = np.concatenate([(points[s : s + 4096] @ centres.T).argmax(1) for s in range(0, len(points), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def visited(x: np.ndarray, centres: np.ndarray, threshold: float, probes: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own cell of each unit vector, row, cell): the other cells that a row visits; by the exact bound if probes is None."""
    near = x @ centres.T
    own = near.argmax(1)
    at = np.arange(len(x))
    if probes is not None:
        most = min(probes, len(centres))
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        row, cell = np.repeat(at, most), best.ravel()
        other = cell != own[row]
        return own, row[other], cell[other]
    gap = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-18))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    over = ((near[at, own][:, None] - near) / gap[own] <= reach) & (np.arange(len(centres))[None, :] > own[:, None])
    row, cell = np.nonzero(over)
    return own, row, cell


def deal(vecs: DataFrame, centres: dict[int, np.ndarray], threshold: float, probes: int | None) -> DataFrame:
    """Rows (cell, x, rep, copies, own, seen, home, salt): a vector in its own cell and in those it visits.

    cell holds the vector's length in its upper half; a length without centroids is one cell. `seen`
    lists all cells that the vector visits.
    """
    import pyarrow as pa

    shared = vecs.sparkSession.sparkContext.broadcast(centres)

    def parts(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                yield b.slice(at, 2048)

    def run(batches):
        for b in parts(batches):
            x = b.column(0)
            flat, starts = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            starts = starts - starts[0]
            dims = np.diff(starts)
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                c = shared.value.get(d)
                own, r, j = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if c is not None:
                    own, r, j = visited(unit(flat[starts[rows][:, None] + np.arange(d)]), c, threshold, probes)
                upper = np.int64(d) << np.int64(32)
                order = np.argsort(r, kind="stable")
                r, j = r[order], j[order]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(rows)))))
                seen = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(j + upper))
                which = np.concatenate((np.arange(len(rows)), r))
                who, home = pa.array(rows[which]), np.arange(len(which)) < len(rows)
                cols = [np.concatenate((own, j)) + upper, *(col.take(who) for col in b.columns), own[which] + upper, seen.take(pa.array(which)), home]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["cell", "x", "rep", "copies", "own", "seen", "home"])

    out = vecs.select("x", "rep", "copies").mapInArrow(run, "cell long, x array<double>, rep long, copies long, own long, seen array<long>, home boolean")
    return out.withColumn("salt", F.xxhash64("rep"))


def cell_links(tasks: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, links): in each task, the rows linked to each row and the root of its local set."""
    import pyarrow as pa

    def run(batches):
        for g in grouped_batches(batches, ["cell", "a", "b"]):
            if g.num_rows < 2:
                continue
            g = g.take(np.argsort(g.column("rep").to_numpy(), kind="stable")).combine_chunks()
            rep, copies, role, own, cell = (g.column(c).to_numpy() for c in ("rep", "copies", "role", "own", "cell"))
            x = g.column("x").combine_chunks()
            x = unit(x.flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1))
            left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            if not len(left) or not len(right):
                continue
            # cells by their number in this task: row and cell make one key
            seen = g.column("seen").combine_chunks()
            named, number = np.unique(np.concatenate((own, seen.flatten().to_numpy(zero_copy_only=False))), return_inverse=True)
            lists = np.diff(seen.offsets.to_numpy())
            visits = np.sort(np.repeat(np.arange(len(rep)), lists) * len(named) + number[len(rep) :])
            own_number, here = number[: len(rep)], int(cell[0])
            links, forest = np.zeros(len(rep), np.int64), LocalForest(len(rep))
            narrow = x[right].astype(np.float32).T.copy()
            step = max(1, TILE // len(right))
            for at in range(0, len(left), step):
                i = left[at : at + step]
                p, q = np.nonzero(x[i].astype(np.float32) @ narrow >= threshold - 1e-4)
                p, q = i[p], right[q]
                keep = rep[p] != rep[q]
                p, q = p[keep], q[keep]
                if not len(p):
                    continue
                sure = np.concatenate([np.einsum("ij,ij->i", x[p[s : s + TILE // 64]], x[q[s : s + TILE // 64]]) >= threshold for s in range(0, len(p), TILE // 64)])
                p, q = p[sure], q[sure]
                forest.link(p, q)
                # a visitor's pair is counted for both here, unless it is met again where the visitor is at home
                visitor = own[q] != here
                key = p * len(named) + own_number[q]
                again = visitor & (visits[np.minimum(np.searchsorted(visits, key), len(visits) - 1)] == key) if len(visits) else visitor & False
                count = ~again | (own[q] > here)
                np.add.at(links, p[count], copies[q[count]])
                both = count & visitor
                np.add.at(links, q[both], copies[p[both]])
            same = np.flatnonzero(rep[1:] == rep[:-1])
            forest.link(same, same + 1)
            some = np.flatnonzero((links > 0) | (rep[forest.parent] != rep))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[forest.parent[some]]), pa.array(links[some])], ["rep", "root", "links"])

    shards = tasks.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return shards.mapInArrow(run, "rep long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ...).

    Cosine in double precision; links at threshold or more, copies included. Links between equal vectors are
    always found, others where one vector's cell is among the `probes` nearest of the other; exact=True finds
    all. Vectors that are null, zero, empty or hold null or non-finite components, and vectors of different
    lengths, link with nothing; such a row is its own component. Repeated rows stay rows; distinct vectors
    under one vec_id, and null vec_ids, do not break the run: a null vec_id belongs to its vector's component
    and names none. An empty table gives an empty result.
    """
    if probes < 1:
        raise ValueError("a vector is compared in its own cell at least")
    vecs = checkpointed(directions(vectors).where("rep is not null"))
    k = cell_count(vecs.count())
    sample: dict[int, list] = {}
    for r in vecs.select("x").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE * k).collect():
        sample.setdefault(len(r.x), []).append(r.x)
    centres = {d: fit_centroids(np.array(v), k) for d, v in sample.items()}
    tasks = split_hot_cells(deal(vecs, centres, threshold, None if exact else probes), CELL_ROWS)
    found = checkpointed(cell_links(tasks, threshold))
    roots = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = (
        vecs.select("k1", "k2", "rep", "copies").join(roots, "rep", "left").join(links, "rep", "left")
        .select("k1", "k2", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *_keys(F.col("embedding").cast("array<double>")))
    out = rows.join(of, ["k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_embedding_near_dedup": op7_embedding_near_dedup}
ORACLE: dict[str, str] = {}
