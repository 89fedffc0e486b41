"""What the corpus operators share: the shared folder, hashing, block cells and connected components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.lineage import cut


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    return cut(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(col: Column) -> Column:
    """CRC-32 of a value's text, unsigned; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def held_out(col: Column, modulus: int, remainder: int) -> Column:
    return crc_of(col) % modulus == remainder


def bucket_count(rows: int, per_bucket: int, least: int) -> int:
    """Enough buckets that each holds about per_bucket rows, at every size."""
    return max(least, -(-rows // per_bucket))


#: Rows that a broadcast side may have at most.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast where its known number of rows allows one; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_mark(rows: DataFrame) -> Column:
    """A hash of all columns of a row, whatever their order and types."""
    plain = lambda c, t: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`")
    return F.xxhash64(*[plain(c, t) for c, t in sorted(rows.dtypes)])


def numbered_copies(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a column `name`: 0, 1, ... for the rows equal in keys (nulls are values).

    Copies are counted for each partition of a written table first and then numbered within it, so the copies
    of one row are spread over as many tasks as it has partitions, and no task holds them all.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    placed = checkpointed(rows.select(F.struct(*columns).alias("r"), F.xxhash64(*keys).alias("k"), F.spark_partition_id().alias("at")))
    before = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("k", "at").agg(F.count(F.lit(1)).alias("n")).select("k", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    here = F.row_number().over(Window.partitionBy("k", "at").orderBy("k")) - 1
    return placed.withColumn("i", here).join(first, ["k", "at"]).select("r.*", (F.col("first") + F.col("i")).alias(name))


# --- texts as bytes -------------------------------------------------------------------------------


def byte_values(column) -> list[bytes | None]:
    """An Arrow string column's values as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if big else pa.binary()).to_pylist()


def slices(batches, rows: int = 1000):
    """The batches in parts of at most so many rows, which bounds what is copied at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_chunks(texts: list[bytes | None], limit: int):
    """Index ranges of texts holding about limit bytes each; one longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_GAP = re.compile(rb"[\x09-\x0d\x20]")
#: A longer text is worked on in parts.
SEGMENT = 4 << 20


def segments(text: bytes, limit: int | None = None):
    """A text in order, cut at white space into parts of about limit bytes; a longer word stays whole."""
    limit, at = limit or SEGMENT, 0
    while len(text) - at > limit:
        m = _GAP.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


# --- cells: groups of rows that are compared with each other --------------------------------------


def split_hot_cells(dealt: DataFrame, rows_per_block: int) -> DataFrame:
    """Give every row of `dealt` (cell, home boolean, hash column `salt` long, ...) its tasks.

    A cell of up to rows_per_block rows is one task. A larger one is cut into blocks, and every pair
    of blocks becomes a task, so that no comparison is lost and no task grows with the cell. `role`
    tells whether a row is compared from (1), compared with (2) or both (3). The table of large cells is
    broadcast only if its counted rows allow it.
    """
    hot = checkpointed(
        dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_block)
        .select("cell", F.ceil(F.col("n") / rows_per_block).cast("int").alias("blocks"))
    )
    here = dealt.join(broadcast_if_small(hot, hot.count()), "cell", "left")
    own = F.pmod("salt", F.col("blocks")).cast("int")
    across = F.sequence(F.lit(0), F.col("blocks") - 1)
    froms = F.when(F.col("home"), F.transform(across, lambda b: F.struct(own.alias("a"), b.alias("b"), F.lit(1).alias("role"))))
    withs = F.transform(across, lambda a: F.struct(a.alias("a"), own.alias("b"), F.lit(2).alias("role")))
    empty = F.array().cast("array<struct<a:int,b:int,role:int>>")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.when(F.col("home"), 3).otherwise(2).alias("role")))
    tasks = F.when(F.col("blocks").isNull(), whole).otherwise(F.concat(F.coalesce(froms, empty), withs))
    return here.withColumn("t", F.explode(tasks)).select(
        *[c for c in dealt.columns if c not in ("home", "salt")], F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.role").alias("role")
    )


def grouped_batches(batches, keys: list[str]):
    """From Arrow batches sorted by keys, yield one table for each group, holding a group at a time."""
    import pyarrow as pa

    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if rest and rest[0] != first:
            yield pa.Table.from_batches(rest[1])
            rest = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            piece = batch.slice(s, e - s)
            if s == 0 and rest:
                rest[1].append(piece)
            else:
                if rest:
                    yield pa.Table.from_batches(rest[1])
                rest = [tuple(c[s] for c in cols), [piece]]
    if rest:
        yield pa.Table.from_batches(rest[1])


class LocalForest:
    """Union-find over 0..n-1 by vectorised hooking; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = self.parent[i], self.parent[j]
            apart = ri != rj
            if not apart.any():
                return
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(self.parent, np.maximum(ri, rj), np.minimum(ri, rj))
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up


# --- connected components -------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (src long, dst long): root is the smallest reachable.

    Alternating large-star and small-star rounds. A round is two min-aggregations, which combine
    before they shuffle, and two equi-joins, which adaptive execution may split where a hub is hot.
    Lineage is cut each round in the shared folder; only a count and a checksum reach the driver.
    """
    edges = edges.where("src <> dst and src is not null and dst is not null")
    edges = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(small.union(root.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
