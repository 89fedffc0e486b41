"""Bounded, repeatable samples of labelled training documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import held_out


def training_ids(labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, label): at most `bound` labelled ids outside the held-out fold, by a hash of the id.

    Null ids and labels are left out; of several labels of one id the largest counts. The bound is what
    makes the result safe to broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), "doc_id").limit(bound)


#: Different texts of one id that a sample takes at most.
TEXTS_EACH = 4


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """(doc_id, text, label) of the sampled ids: each different text of an id once, TEXTS_EACH of them at most."""
    ids = training_ids(labels, label, modulus, remainder, bound)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id", "label", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    return one.withColumn("rank", rank).where(F.col("rank") <= TEXTS_EACH).select("doc_id", "text", "label")


def score_schema(docs: DataFrame, name: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in [*docs.dtypes, (name, "double")])
