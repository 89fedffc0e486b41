"""Queries over ordered text streams: conversations are streams, turns are items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import streams
from larkspur.plans.fixture import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_WHOLE = "WITH c AS (SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1)"
_NUMBERED = "CAST(row_number() OVER (PARTITION BY stream_id ORDER BY k) - 1 AS BIGINT) AS seq"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.text_items(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_CUT = "string_split(t, chr(10))"


@query(
    f"{_WHOLE} SELECT stream_id, {_NUMBERED}, text FROM (SELECT stream_id, k, CASE WHEN k < n THEN p || chr(10) ELSE p END AS text FROM "
    f"(SELECT stream_id, unnest({_CUT}) AS p, generate_subscripts({_CUT}, 1) AS k, len({_CUT}) AS n FROM c)) WHERE text <> ''"
)
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.lines(items(spark, sf_dir)).select("stream_id", "seq", "text")


@query(
    f"{_WHOLE} SELECT stream_id, {_NUMBERED}, text FROM (SELECT stream_id, unnest(w) AS text, generate_subscripts(w, 1) AS k FROM "
    "(SELECT stream_id, regexp_extract_all(t, '[^ \\t\\n\\f\\r]+') AS w FROM c))"
)
def stream_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.words(items(spark, sf_dir)).select("stream_id", "seq", "text")


@query(f"{_WHOLE} SELECT stream_id, CAST(k AS BIGINT) AS seq, substr(t, k * 64 + 1, 64) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / 64) AS BIGINT))) AS k FROM c)")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.chunks(items(spark, sf_dir), 64).select("stream_id", "seq", "text")


@query(
    f"{_WHOLE} SELECT stream_id, {_NUMBERED}, text FROM (SELECT stream_id, k, CASE WHEN k < n THEN p || 'en' ELSE p END AS text FROM "
    "(SELECT stream_id, unnest(string_split(t, 'en')) AS p, generate_subscripts(string_split(t, 'en'), 1) AS k, len(string_split(t, 'en')) AS n FROM c)) WHERE text <> ''"
)
def stream_split_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut after each `en`, which may lie across two items."""
    return streams.split_after(items(spark, sf_dir), "en").select("stream_id", "seq", "text")


@query(f"{_WHOLE} SELECT stream_id, t AS text FROM c")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.joined(items(spark, sf_dir)).select("stream_id", "text")


@query("SELECT conv_id AS stream_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def stream_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.joined(items(spark, sf_dir), after="\n").select("stream_id", "text")


@query("SELECT conv_id AS stream_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def stream_join_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.joined(items(spark, sf_dir), between=" ").select("stream_id", "text")


_NTH = "row_number() OVER (PARTITION BY conv_id ORDER BY turn {d})"


@query(f"SELECT conv_id AS stream_id, turn AS seq, text FROM conversations QUALIFY {_NTH.format(d='')} <= 2")
def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.first(items(spark, sf_dir), 2).select("stream_id", "seq", "text")


@query(f"SELECT conv_id AS stream_id, turn AS seq, text FROM conversations QUALIFY {_NTH.format(d='DESC')} <= 2")
def stream_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last(items(spark, sf_dir), 2).select("stream_id", "seq", "text")


@query("SELECT conv_id AS stream_id, turn AS seq FROM conversations WHERE contains(text, 'the')")
def stream_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.containing(items(spark, sf_dir), "the").select("stream_id", "seq")


@query("SELECT conv_id AS stream_id, turn AS seq, role IS NOT DISTINCT FROM 'user' AS is_error FROM conversations WHERE text <> ''")
def stream_without_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    plain = items(spark, sf_dir).join(rows.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "role"), ["stream_id", "seq"])
    return streams.without_empty(plain.drop("role")).join(plain.select("stream_id", "seq", "role"), ["stream_id", "seq"]).select("stream_id", "seq", (F.col("role") == "user").alias("is_error"))


def _with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items where every fourth turn of an odd stream is an error."""
    return items(spark, sf_dir).withColumn("err", F.when((F.col("stream_id") % 2 == 1) & (F.col("seq") % 4 == 3), "failed"))


_ERR = "(conv_id % 2 = 1 AND turn % 4 = 3)"


@query(f"SELECT conv_id AS stream_id, turn AS seq FROM conversations WHERE NOT {_ERR}")
def stream_oks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.oks(_with_errors(spark, sf_dir)).select("stream_id", "seq")


@query(f"SELECT conv_id AS stream_id, turn AS seq, 'failed' AS err FROM conversations WHERE {_ERR}")
def stream_errs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.errs(_with_errors(spark, sf_dir)).select("stream_id", "seq", "err")


@query(f"SELECT conv_id AS stream_id, turn AS seq FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn <= c.turn AND e.conv_id % 2 = 1 AND e.turn % 4 = 3)")
def stream_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.fail_fast(_with_errors(spark, sf_dir)).select("stream_id", "seq")


# --- streams of bytes ---------------------------------------------------------------------------------------


def bytes_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as bytes, cut again in the middle of each, so that characters and segments lie across items."""
    data, half = F.encode("text", "UTF-8"), F.floor(F.octet_length("text") / 2).cast("int")
    parts = F.array(F.substring(data, 1, half), F.substring(data, half + 1, F.octet_length("text")))
    each = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("k", "part"))
    none = F.lit(None).cast("string")
    return each.select(F.col("conv_id").cast("long").alias("stream_id"), (F.col("turn") * 2 + F.col("k")).cast("long").alias("seq"), F.lit("bytes").alias("kind"), none.alias("text"), F.col("part").alias("bytes"), none.alias("err"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("stream_id", "seq", "kind", F.lower(F.hex("bytes")).alias("hex"))


def _hex_rows(sql: str) -> str:
    return f"SELECT stream_id, seq, 'bytes' AS kind, lower(hex(encode(text))) AS hex FROM ({sql})"


@query(_hex_rows(ORACLE["stream_lines"]))
def stream_byte_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(streams.lines(bytes_items(spark, sf_dir)))


@query(_hex_rows(ORACLE["stream_words"]))
def stream_byte_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(streams.words(bytes_items(spark, sf_dir)))


@query(_hex_rows(ORACLE["stream_split_after"]))
def stream_byte_split_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(streams.split_after(bytes_items(spark, sf_dir), "en"))


@query("SELECT conv_id AS stream_id, lower(hex(encode(string_agg(text || chr(10), '' ORDER BY turn)))) AS hex FROM conversations GROUP BY 1")
def stream_byte_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns as bytes, a line break after each."""
    none = F.lit(None).cast("string")
    whole = items(spark, sf_dir).select("stream_id", "seq", F.lit("bytes").alias("kind"), none.alias("text"), F.encode("text", "UTF-8").alias("bytes"), "err")
    return streams.joined(whole, after="\n").select("stream_id", F.lower(F.hex("bytes")).alias("hex"))


@query(f"{_WHOLE} SELECT stream_id, md5(bin(trim(regexp_replace(t, '[ \t\n\f\r]+', ' ', 'g')))) AS digits FROM c")
def stream_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command line over every conversation: its bytes as hex and back, joined, collapsed, as binary digits."""
    made = streams.pipeline(items(spark, sf_dir), ["to-hex | parse-hex | to-binary | parse-binary", "join"])
    text = made.withColumn("text", F.decode("bytes", "UTF-8")).withColumn("bytes", F.lit(None).cast("binary")).withColumn("kind", F.lit("text"))
    return streams.pipeline(text, ["collapse", "to-binary"]).select("stream_id", F.md5("text").alias("digits"))
