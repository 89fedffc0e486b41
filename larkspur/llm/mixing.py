"""Mixing sources to target weights with blocks, multinomial draws and index permutations.

Each source's documents, in a hashed order, are one stream of words cut into blocks of a fixed length. For every
output shard the driver draws how many of its slots each source fills, from a multinomial over what the
sources' targets still lack, so that the totals settle on the targets. A source's slots are numbered through
all shards; slot k of pass p is block perm(k) of a pseudorandom permutation of the source's block indices, a keyed
Feistel walk that belongs to that source and pass. Slots and blocks meet in an equi-join on (source, index), so nothing is sorted or
replicated by weight, and with at most two passes no document is taken more than twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import broadcast_if_small, bucket_count, checkpointed, numbered_copies, row_mark, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Words in a block, output shards, rows in a bucket of a source.
BLOCK, SHARDS, SEED, BUCKET_ROWS = 128, 64, 71, 50_000
_RUN = 1 << 15


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = PASSES) -> list[float]:
    """Targets of sources in order: weights repeat; what exceeds most * size is shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}, share * sum(sizes)
    while open_:
        unit = left / sum(w[i] for i in open_)
        full = {i for i in open_ if unit * w[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def draw_counts(wanted: list[float], room: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots of each shard (row) filled by each source (column): multinomial in what is still lacking.

    No source gets more than its room; the last shard takes what remains, rounded.
    """
    rng, wanted, room = np.random.default_rng(seed), np.array(wanted, float), np.array(room, np.int64)
    total = int(round(wanted.sum()))
    out = np.zeros((shards, len(wanted)), np.int64)
    for s in range(shards):
        used = out[:s].sum(0)
        slots = total // shards + (s < total % shards)
        lacking = np.clip(wanted - used, 0, None)
        if s == shards - 1:
            got = np.minimum(np.floor(lacking).astype(np.int64), room - used)
            for k in np.argsort(np.floor(lacking) - lacking, kind="stable"):
                if got.sum() >= slots:
                    break
                got[k] += used[k] + got[k] < room[k]
            out[s] = got
            continue
        while slots and (lacking > 0).any():
            got = rng.multinomial(slots, lacking / lacking.sum())
            got = np.minimum(got, room - used - out[s])
            out[s] += got
            slots -= int(got.sum())
            lacking = np.where(used + out[s] < room, lacking, 0)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 takes each index: a Feistel network on the next power of four, walked.

    Rows have their own n and key. A value beyond n is permuted again until it is within, which keeps the map one to one.
    """
    out, n = index.astype(np.uint64), n.astype(np.uint64)
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def source_key(col):
    """A text that sorts as the source by code point, null last, and is never null."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, mark, size, first): each row's first word in its source's stream.

    mark is a hash of the whole row; rows equal in all columns are numbered, so that their copies are spread.
    """
    rows = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("skey"), row_mark(docs).alias("mark"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = checkpointed(numbered_copies(rows, ["skey", "mark"], "copy"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("mark", "copy", F.lit(SEED)), bucket_count(rows.count(), BUCKET_ROWS, 64)).cast("int"))
    sums = rows.groupBy("skey", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("skey", "part").orderBy(F.xxhash64("mark", "copy", F.lit("order")), "mark", "copy").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(here)).join(sums, ["skey", "part"])
    return placed.select("doc_id", "source", "skey", "mark", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("first"))


def plan(rows: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(skey, source_size, target, blocks, draws): the mix of each source.

    One line of figures for each source is on the driver, `shards` numbers in it, never its documents.
    """
    sums = sorted((r["skey"], r["n"]) for r in rows.groupBy("skey").agg(F.sum("size").alias("n")).collect())
    sizes = [n for _, n in sums]
    goal = targets(sizes)
    blocks = [-(-n // block) for n in sizes]
    wanted = [t * b / n if n else 0.0 for t, b, n in zip(goal, blocks, sizes, strict=True)]
    counts = draw_counts(wanted, [PASSES * b for b in blocks], shards, seed)
    lines = []
    for k, (key, n) in enumerate(sums):
        starts = np.concatenate(([0], np.cumsum(counts[:, k]))).tolist()
        lines.append((key, n, goal[k], blocks[k], [(s, starts[s], starts[s + 1]) for s in range(shards) if starts[s + 1] > starts[s]]))
    schema = "skey string, source_size long, target double, blocks long, draws array<struct<shard:int,lo:long,hi:long>>"
    return rows.sparkSession.createDataFrame(lines, schema)


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(skey, shard, slot, pass, index): which block of its source each slot takes."""
    import pyarrow as pa

    runs = sources.select("skey", "blocks", F.explode("draws").alias("d")).select(
        "skey", "blocks", "d.*", F.explode(F.sequence("d.lo", F.col("d.hi") - 1, F.lit(_RUN).cast("long"))).alias("at")
    )
    runs = runs.repartition("skey", "at")
    each = runs.select("skey", "blocks", "shard", F.explode(F.sequence("at", F.least(F.col("at") + _RUN, "hi") - 1)).alias("slot"))
    each = each.select("skey", "shard", "slot", F.expr("cast(slot div blocks as int)").alias("pass"), "blocks")
    # each source and pass has a permutation of its own
    each = each.withColumn("key", F.xxhash64("skey", "pass", F.lit(seed)))

    def run(batches):
        for b in batches:
            slot, blocks, key = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5))
            index = permute(slot % blocks, blocks, key.view(np.uint64)) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(index, pa.int64())], ["skey", "shard", "slot", "pass", "index"])

    return each.mapInArrow(run, "skey string, shard int, slot long, pass int, index long")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document's parts of blocks: index, and the words [from, from + words) of the document."""
    last = F.expr(f"(first + size - 1) div {block}")
    parts = rows.where("size > 0").withColumn("index", F.explode(F.sequence(F.expr(f"first div {block}"), last)))
    start = F.greatest(F.col("index") * block, "first")
    end = F.least((F.col("index") + 1) * block, F.col("first") + F.col("size"))
    return parts.select("doc_id", "skey", "mark", "size", "first", "index", (start - F.col("first")).alias("from"), (end - start).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, mixed): documents in their streams, the plan, and the mixed pieces.

    A mixed piece is (shard, slot, pass, doc_id, skey, mark, size, first, from, words). Documents without
    words have no piece. Reruns agree: everything follows from the rows and the seed.
    """
    rows = checkpointed(positions(docs))
    sources = plan(rows, block, shards, seed)
    mixed = pieces(rows, block).join(slots(sources, seed).hint("merge"), ["skey", "index"])
    return rows, sources, mixed


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources, mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = mixed.groupBy("skey", "first", "size").agg(F.sum("words").alias("taken"))
    figures = sources.select("skey", "source_size", "target")
    out = rows.join(taken, ["skey", "first", "size"], "left").join(broadcast_if_small(figures, figures.count()), "skey")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass, the words of each document that the mix takes.

    A document taken whole in a pass keeps its text; else its taken blocks' words are joined by blanks in
    their order. So a document appears up to twice, and not at all if no block of it was drawn.
    """
    columns = docs.columns
    _, _, mixed = mix(docs)
    part = F.struct("from", "words")
    taken = mixed.groupBy("skey", "mark", "size", "first", "pass").agg(F.sum("words").alias("got"), F.sort_array(F.collect_list(part)).alias("parts"))
    # the document travels as one struct, so that its columns' names cannot clash; rows with one mark are equal
    whole = docs.select(source_key(F.col("source")).alias("__skey"), row_mark(docs).alias("__mark"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"))
    whole = whole.dropDuplicates(["__skey", "__mark"])
    taken = taken.select(F.col("skey").alias("__skey"), F.col("mark").alias("__mark"), F.col("size").alias("__size"), F.col("got").alias("__got"), F.col("parts").alias("__parts"))
    words = F.regexp_extract_all("__doc.text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["words"].cast("int")))), " ")
    text = F.when(F.col("__got") == F.col("__size"), F.col("__doc.text")).otherwise(cut)
    out = whole.join(taken, ["__skey", "__mark"]).withColumn("__text", text)
    fresh = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[fresh.get(c, F.col("__doc").getField(c)).alias(c) for c in columns])


QUERIES = {"op9_mixing": op9_mixing}
ORACLE: dict[str, str] = {}
