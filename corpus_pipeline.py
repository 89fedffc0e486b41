"""From raw documents to token counts: language, quality, near-duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, langid, mixing, quality, shingle_dedup
from larkspur.llm.common import table
from larkspur.operators.lineage import shared_folder

#: A document goes if no learned language reaches this posterior, if the best one needs as many bits a byte as uniform
#: bytes do, which no learned language explains, or if its quality score is lower than this.
LEAST_POSTERIOR, MOST_BITS, LEAST_QUALITY = 0.5, 8.0, quality.THRESHOLD


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that one learned language explains; texts without a letter go."""
    scored = langid.identify(docs, langid.fit(docs), names=("__lang", "__posterior", "__bits"))
    explained = (F.col("__posterior") >= LEAST_POSTERIOR) & (F.col("__bits") < MOST_BITS)
    return scored.where((F.col("__lang") != langid.UNKNOWN) & explained).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose statistics look like those labelled 1."""
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), name="__quality")
    return scored.where(F.col("__quality") >= LEAST_QUALITY).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts with five-word Jaccard 0.8 or more.

    It is the one with the smallest doc_id, rows without one last, then by a hash of the text, then by all
    columns: unlike texts under one doc_id are different documents, and reruns keep the same rows.
    """
    groups = shingle_dedup.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")
    least = groups.groupBy("group").agg(first).select(F.col("m.doc_id").alias("__id"), F.col("m.key").alias("__key")).distinct()
    rows = docs.select(shingle_dedup.text_key().alias("key"), F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(least, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")))
    return kept.groupBy("key", "id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as the source weights take them, up to twice each."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every mixed document."""
    return bpe.token_digests(docs)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("mix", mixed),
    ("tokens", tokens),
]
#: No stage but the mix can be told in SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written in the shared folder and read again."""
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
