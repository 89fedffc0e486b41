"""Exact top-k search by distributed histogram selection.

Vectors and queries are dealt into a grid of cells, a block of queries against a block of candidates, so that
every score is computed and no task holds more than two blocks. Each round histograms the scores that lie in
a query's open interval; the blocks' counts add up to a global histogram, which locates the bin of the query's
k-th score and narrows the interval to it, until it is one score wide. A block needs to report only its upper
bins up to its own k-th score: everything below them is below the global k-th too. At last the scores above
the k-th value, and the smallest vec_ids among those equal to it, are gathered and ranked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import checkpointed, grouped_batches, table

K, BINS = 20, 4096
#: Rows in a block of queries and of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 32768
#: Scores held at a time.
TILE = 1 << 21


def usable(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x array<long>, row): floor(scale * component) of the vectors without null or non-finite components.

    row numbers the rows; it holds only for a table written once.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("embedding").isNotNull() & ~bad)
        .select("vec_id", F.transform("embedding", lambda v: F.floor(v * scale).cast("long")).alias("x"), F.monotonically_increasing_id().alias("row"))
    )


def _grid(queries: DataFrame, candidates: DataFrame, bounds: DataFrame, qblocks: int, cblocks: int) -> DataFrame:
    """Both sides dealt to every cell (i, j) that needs them, sorted by cell."""
    q = queries.join(bounds, "row").select(
        F.pmod(F.xxhash64("row"), qblocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cblocks - 1))).alias("j"),
        F.lit(True).alias("query"), "vec_id", "row", "x", "lo", "hi", "width", "need",
    )
    zero = F.lit(0).cast("long")
    c = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("i"), F.pmod(F.xxhash64("row"), cblocks).cast("int").alias("j"),
        F.lit(False).alias("query"), "vec_id", "row", "x", *[zero.alias(c) for c in ("lo", "hi", "width", "need")],
    )
    cells = q.unionByName(c)
    return cells.repartition(qblocks * cblocks, "i", "j").sortWithinPartitions("i", "j")


def _cells(batches):
    """Per cell, tile by tile: (query rows, the cell, ids, which are null, row numbers, candidates by id, scores, which are the query itself)."""
    for g in grouped_batches(batches, ["i", "j"]):
        is_query = g.column("query").to_numpy()
        ids = g.column("vec_id").to_pandas().astype("Int64")
        x = g.column("x").combine_chunks()
        flat, starts = x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy()
        starts = starts - starts[0]
        dims = np.diff(starts)
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(c):
            continue
        null = ids.isna().to_numpy()
        key, number = ids.fillna(0).to_numpy(np.int64), g.column("row").to_numpy()
        c = c[np.lexsort((key[c], null[c]))]  # a null vec_id comes last
        for d in np.unique(dims[q]):
            own, other = q[dims[q] == d], c[dims[c] == d]
            if not len(other):
                continue
            a = flat[starts[own][:, None] + np.arange(d)]
            b = flat[starts[other][:, None] + np.arange(d)]
            # doubles hold these sums exactly below 2^53, and are faster; beyond, 64-bit integers wrap
            exact = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(d, 1) < 2**53
            left, right = (a.astype(np.float64), b.astype(np.float64).T) if exact else (a, b.T)
            step = max(1, TILE // len(other))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                score = left[at : at + step] @ right
                score = score.astype(np.int64)
                itself = number[other][None, :] == number[rows][:, None]
                yield rows, g, key, null, number, other, score, itself


def _histograms(cells: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for rows, g, _, _, number, _, score, itself in _cells(batches):
            lo = g.column("lo").to_numpy()[rows]
            hi = g.column("hi").to_numpy()[rows]
            width = g.column("width").to_numpy()[rows]
            need = g.column("need").to_numpy()[rows]
            # the open interval is [lo, hi); what lies above is counted already
            bins = np.floor_divide(score - lo[:, None], width[:, None])
            bins[itself | (score < lo[:, None]) | (score >= hi[:, None])] = -1
            out_q, out_b, out_n = [], [], []
            for r in range(len(rows)):
                b = bins[r][bins[r] >= 0]
                if not len(b):
                    continue
                n = np.bincount(b, minlength=BINS)
                top = np.cumsum(n[::-1])[::-1]
                keep = np.flatnonzero((n > 0) & (top - n < need[r]))
                out_q.append(np.full(len(keep), number[rows[r]]))
                out_b.append(keep)
                out_n.append(n[keep])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (out_q, out_b, out_n)], ["row", "bin", "n"])

    return cells.mapInArrow(run, "row long, bin long, n long")


def _winners(cells: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for rows, g, key, null, number, other, score, itself in _cells(batches):
            kth, need = g.column("lo").to_numpy()[rows], g.column("need").to_numpy()[rows]
            score_ok = (score >= kth[:, None]) & ~itself
            tie = score_ok & (score == kth[:, None])
            # candidates stand in order of vec_id: of those equal to the k-th score the first few are enough
            score_ok &= ~tie | (np.cumsum(tie, axis=1) <= need[:, None])
            r, c = np.nonzero(score_ok)
            if len(r):
                ids = pa.array(key[other[c]], mask=null[other[c]])
                yield pa.RecordBatch.from_arrays([pa.array(number[rows[r]]), pa.array(key[rows[r]]), ids, pa.array(score[r, c])], ["row", "query_id", "vec_id", "score"])

    return cells.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, query_rows, k: int = K, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query.

    `query_rows` is a condition on vec_id. Score: inner product of floor(scale * component); ties go to
    the smaller vec_id, a null vec_id last. Vectors that are null or hold null or non-finite components
    take no part; vectors of different lengths have no score. Rows are what counts, not ids: every row that
    query_rows picks is a query of its own, and all other rows are its candidates, those with the same vec_id and
    vector too. Sums beyond 2^63 wrap. An empty table, and one without queries, give an empty result.
    """
    spark = vectors.sparkSession
    vecs = checkpointed(usable(vectors, scale))
    queries = vecs.where(query_rows & F.col("vec_id").isNotNull())
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    size = vecs.agg(F.count(F.lit(1)), F.count_if(query_rows), F.max(norm), F.max(F.when(query_rows, norm))).first()
    if not size[0] or not size[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cores = max(1, spark.sparkContext.defaultParallelism)
    qblocks = -(-size[1] // QUERY_BLOCK)
    cblocks = max(-(-size[0] // CANDIDATE_BLOCK), -(-2 * cores // qblocks))
    # no score exceeds the product of the norms; the norms are doubles, so a little is added
    reach = min(int((size[2] * size[3]) ** 0.5 * (1 + 1e-9)) + 2, 2**62)
    width = max(1, -(-(2 * reach + 1) // BINS))
    bounds = queries.select("row", F.lit(-reach).cast("long").alias("lo"), F.lit(reach + 1).cast("long").alias("hi"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need"))
    while True:
        counts = _histograms(_grid(queries, vecs, bounds, qblocks, cblocks)).groupBy("row", "bin").agg(F.sum("n").alias("n"))
        ranked = counts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("bins"))
        # of the upper bins, those before the one in which the count reaches what is needed
        start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("last"))
        step = lambda s, e: F.struct(
            F.when(s["bin"].isNull() & (s["above"] + e["n"] < F.col("need")), s["above"] + e["n"]).otherwise(s["above"]).alias("above"),
            F.coalesce(s["bin"], F.when(s["above"] + e["n"] >= F.col("need"), -e["b"])).alias("bin"), (-e["b"]).alias("last"),
        )
        found = bounds.join(ranked, "row", "left").withColumn("s", F.aggregate(F.coalesce("bins", F.array().cast("array<struct<b:bigint,n:bigint>>")), start, step))
        # fewer rows than needed: everything counts, from the interval's foot on
        next_width = max(1, -(-width // BINS))
        foot = F.col("lo") + F.coalesce(F.col("s.bin"), F.lit(0)) * F.col("width")
        top = F.when(F.col("s.bin").isNull(), F.col("hi")).otherwise(F.least("hi", foot + F.col("width")))
        bounds = checkpointed(
            found.select(
                "row", foot.alias("lo"), top.alias("hi"), F.lit(next_width).cast("long").alias("width"),
                (F.col("need") - F.when(F.col("s.bin").isNull(), 0).otherwise(F.col("s.above"))).alias("need"),
            )
        )
        if width == 1:
            break
        width = next_width
    best = _winners(_grid(queries, vecs, bounds, qblocks, cblocks))
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    ranks = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order)))
    return ranks.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_exact_top_k": op2_exact_top_k}
ORACLE = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
