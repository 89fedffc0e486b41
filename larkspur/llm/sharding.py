"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in hash buckets, the copies of a row by their numbers. How many rows of each bucket go to each shard is drawn on the driver: row by row of
the matrix, multivariate hypergeometric in what room the shards have left, so that every shard gets exactly its
size and every assignment is equally likely. Each bucket then permutes its rows, the matrix cuts the
permutation into shards, rows are exchanged, and each shard is permuted again, in ranges of a second hash, so
that no task holds a shard. Only the matrix (buckets x shards) is on the driver; no row is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import broadcast_if_small, bucket_count, checkpointed, crc_of, numbered_copies, table

SHARDS, SEED, BUCKET_ROWS = 24, 20240229, 50_000


def _log_factorial_change(n: int, by: int) -> float:
    """log((n + by)!) - log(n!), by Stirling's series about n; accurate where the factorials' logarithms are not."""
    m = n + by
    if min(n, m) < 64:
        return math.lgamma(m + 1) - math.lgamma(n + 1)
    series = lambda k: (1 / 12 - (1 / 360 - 1 / 1260 / k**2) / k**2) / k
    return (m + 0.5) * math.log1p(by / n) + by * (math.log(n) - 1) + series(m) - series(n)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good, for urns of any size: ratio of uniforms under the exact law.

    A value is kept with the probability that the ratio of its mass to the mode's gives it (Stadlober's HRUA), so the
    law is the hypergeometric one and not an approximation.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    mean = draws * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / max(total - 1, 1)) + 0.5)
    centre, width = mean + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = 1 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if not low <= x < high + 1:
            continue
        k = math.floor(x)
        d = k - mode
        mass = -sum(_log_factorial_change(n, by) for n, by in ((mode, d), (good - mode, -d), (draws - mode, -d), (bad - draws + mode, d)))
        if 2 * math.log(u) <= mass:
            return k


def hypergeometric(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of n draws without replacement fall to each colour of `room`; exact for any size."""
    if room.sum() < 10**9:  # numpy's sampler of the same law ends here
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out, left, draws = np.zeros_like(room), int(room.sum()), n
    for k, good in enumerate(room.tolist()):
        out[k] = large_hypergeometric(rng, good, left - good, draws)
        left, draws = left - good, draws - int(out[k])
    return out


def communication_matrix(rows_in: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Row counts from each bucket to each shard; shard sizes differ by one at most."""
    total = sum(rows_in)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng, out = np.random.default_rng(seed), np.zeros((len(rows_in), shards), np.int64)
    for k, n in enumerate(rows_in):
        out[k] = hypergeometric(rng, room, n)
        room -= out[k]
    return out


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard int and slot long (gapless from 0 in each shard); columns of rows with these names are replaced.

    `keys` are the columns that tell rows apart; rows equal in all keys are numbered, so that the copies of one row are
    dealt like any others. The shuffle is a function of keys, numbers, the seed and the bucket count alone, so reruns
    agree. Rows equal in all keys are interchangeable. Nulls are values. An empty table gives an empty result.
    """
    rows = rows.drop("shard", "slot")
    # the row travels as one column beside hashes of its keys, so that names cannot clash
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(*keys).alias("key"), F.xxhash64(*keys, F.lit(seed)).alias("other"))
    packed = numbered_copies(packed, ["key", "other"], "copy")
    mark = lambda what: F.xxhash64("key", "other", "copy", F.lit(seed), F.lit(what))
    dealt = checkpointed(packed.select("row", mark("bucket").alias("deal"), mark("local").alias("local"), F.shiftrightunsigned(mark("again"), 2).alias("h"), mark("tie").alias("tie")))
    total = dealt.count()
    buckets = bucket_count(total, BUCKET_ROWS, 64)
    dealt = dealt.withColumn("bucket", F.pmod("deal", buckets).cast("int"))
    counts = sorted((r["bucket"], r["n"]) for r in dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    cuts = rows.sparkSession.createDataFrame([(b, np.cumsum(m).tolist()) for (b, _), m in zip(counts, matrix, strict=True)], "bucket int, cuts array<long>")
    here = Window.partitionBy("bucket").orderBy("local", "tie")
    placed = dealt.withColumn("at", F.row_number().over(here) - 1).join(broadcast_if_small(cuts, len(counts)), "bucket")
    parts = bucket_count(total // shards, BUCKET_ROWS, 16)
    # the second permutation: ascending order of a fresh 62-bit hash, cut into ranges
    placed = checkpointed(placed.select("row", "h", "tie", F.size(F.filter("cuts", lambda c: c <= F.col("at"))).cast("int").alias("shard")))
    placed = placed.withColumn("part", F.least(F.floor(F.col("h") / F.lit(float(2**62)) * parts).cast("int"), F.lit(parts - 1)))
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("h", "tie")
    out = placed.withColumn("at", F.row_number().over(inside) - 1).join(sizes, ["shard", "part"])
    return out.select("row.*", "shard", (F.col("first") + F.col("at")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write whole rows in folders shard=0, 1, ...; within a shard's files rows stand in order of slot."""
    keyed = docs.withColumn("__crc", crc_of(F.col("text")))
    out = shuffle_into_shards(keyed, ["doc_id", "__crc"], shards, seed).drop("__crc")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc_of(F.col("text")).cast("long").alias("text_crc32")
    )
    out = shuffle_into_shards(checkpointed(rows), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_hypergeometric_sharding": op8_hypergeometric_sharding}
ORACLE: dict[str, str] = {}
