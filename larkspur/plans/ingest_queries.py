"""Queries over raw records, corpora, annotations and histories derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import bijections, codecs, text
from larkspur.operators import annotations, hierarchy, normalize
from larkspur.plans.fixture import read, sql_slug
from larkspur.sources import readers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(number: str) -> str:
    return " || ".join(f"substr('{_DIGITS}', CAST({number} // {36**k} % 36 AS BIGINT) + 1, 1)" for k in range(7, -1, -1))


# --- raw API records ------------------------------------------------------------------------------------------

_NAME = f"CASE WHEN c_custkey % 7 <> 0 THEN c_name WHEN c_custkey % 14 <> 0 THEN 'J ' || c_name ELSE 'Corrupt User ' || {_base36('c_custkey')} END"


@query(f"SELECT CASE WHEN c_custkey % 5 <> 0 THEN 978307200 + c_custkey * 60 END AS created, {sql_slug('name')} AS slug, name, c_custkey AS id FROM (SELECT *, {_NAME} AS name FROM customer)")
def normalized_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw users with international, Japanese or no names."""
    key = F.col("c_custkey")
    raw = read(spark, sf_dir, "customer").select(
        codecs.base36_encode(key).alias("id"),
        F.struct(F.when(key % 7 != 0, F.col("c_name")).alias("international"), F.when(key % 14 != 0, F.concat(F.lit("J "), "c_name")).alias("japanese")).alias("names"),
        F.when(key % 5 != 0, F.timestamp_seconds(F.lit(978307200) + key * 60)).alias("signup"),
    )
    return normalize.users(raw).withColumn("created", F.unix_timestamp("created"))


def _raw_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    named = lambda what, count: F.struct(
        F.transform(
            F.sequence(F.lit(1), F.lit(count)),
            lambda k: F.struct(codecs.base36_encode(key * 10 + k).alias("id"), F.concat(F.lit(what), k.cast("string")).alias("name"), F.when(k % 2 == 0, "no rules").alias("rules"), F.when(k % 2 == 0, "per-level").otherwise("per-game").alias("type")),
        ).alias("data")
    )
    timing = F.element_at(F.array(*[F.lit(t) for t in normalize.TIMING]), (key % 3 + 1).cast("int"))
    return read(spark, sf_dir, "nation").select(
        codecs.base36_encode(key).alias("id"), F.lower("n_name").alias("abbreviation"), F.struct(F.col("n_name").alias("international"), F.lit(None).cast("string").alias("japanese")).alias("names"),
        F.timestamp_seconds(F.lit(946684800) + key * 86400).alias("created"), F.struct(timing.alias("default-time")).alias("ruleset"), named("Any% / ", 3).alias("categories"), named("Level ", 2).alias("levels"),
    )


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 946684800 + CAST(n_nationkey AS BIGINT) * 86400 AS created, lower(n_name) AS slug, n_name AS name, ['IGT', 'RTA', 'RTA_NL'][n_nationkey % 3 + 1] AS primary_timing FROM nation")
def normalized_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.games(_raw_games(spark, sf_dir))[0].withColumn("created", F.unix_timestamp("created"))


def _listed(what: str, count: int) -> str:
    return f"SELECT CAST(n_nationkey AS BIGINT) AS game_id, CAST(n_nationkey * 10 + k AS BIGINT) AS id, {sql_slug(f'''('{what}' || k)''')} AS slug, '{what}' || k AS name, CASE WHEN k % 2 = 0 THEN 'no rules' ELSE '' END AS rules, k FROM nation, range(1, {count + 1}) t(k)"


@query(f"SELECT game_id, id, slug, name, rules, 'category' AS kind, CASE WHEN k % 2 = 0 THEN 'PerLevel' ELSE 'PerGame' END AS per FROM ({_listed('Any% / ', 3)}) UNION ALL SELECT game_id, id, slug, name, rules, 'level', NULL FROM ({_listed('Level ', 2)})")
def normalized_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and levels out of the games' records."""
    _, categories, levels = normalize.games(_raw_games(spark, sf_dir))
    return categories.withColumn("kind", F.lit("category")).unionByName(levels.withColumn("kind", F.lit("level")).withColumn("per", F.lit(None).cast("string")))


@query(
    "SELECT CAST(o_custkey % 25 AS BIGINT) AS game_id, CAST(o_custkey % 25 * 10 + 1 AS BIGINT) AS category_id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 25 * 10 + 2 AS BIGINT) END AS level_id, o_orderkey AS id, "
    "CAST(o_orderkey % 5000 * 3661007 AS BIGINT) AS igt, CASE WHEN o_orderkey % 6 = 0 THEN 'guest' || o_orderkey % 3 ELSE CAST(o_custkey AS VARCHAR) END AS players, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 'link' ELSE 'youtube' END AS video, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 11, 'a') END AS video_id FROM orders WHERE o_orderkey % 3 <> 0"
)
def normalized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw runs, a third of them not verified, with guests, users, links and video ids."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    game, ms, nothing = cust % 25, F.col("o_orderkey") % 5000 * 3661007, F.lit(None).cast("string")
    iso = F.format_string("PT%dH%dM%d.%03dS", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    code = codecs.base36_encode
    raw = read(spark, sf_dir, "orders").select(
        code(key).alias("id"), code(game).alias("game"), code(game * 10 + 1).alias("category"), F.when(key % 2 == 0, code(game * 10 + 2)).alias("level"),
        F.col("o_orderdate").cast("timestamp").alias("submitted"), F.to_date("o_orderdate").alias("date"), F.struct(F.when(key % 3 == 0, "new").otherwise("verified").alias("status")).alias("status"),
        F.struct(iso.alias("ingame"), nothing.alias("realtime"), nothing.alias("realtime_noloads")).alias("times"),
        F.array(F.when(key % 6 == 0, F.struct(F.lit("guest").alias("rel"), nothing.alias("id"), F.concat(F.lit("guest"), (key % 3).cast("string")).alias("name"))).otherwise(F.struct(F.lit("user").alias("rel"), code(cust).alias("id"), nothing.alias("name")))).alias("players"),
        F.array(F.struct(F.when(key % 4 == 0, "https://example.org/v").otherwise(F.concat(F.lit("https://youtu.be/"), F.lpad(key.cast("string"), 11, "a"))).alias("uri"))).alias("videos"),
    )
    player, video = F.get("players", F.lit(0)), F.get("videos", F.lit(0))
    return normalize.runs(raw).select(
        "game_id", "category_id", "level_id", "id", F.col("times_ms.igt").alias("igt"), F.coalesce(player["user_id"].cast("string"), player["guest_name"]).alias("players"), video["kind"].alias("video"), video["id"].alias("video_id")
    )


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'no name' WHEN c_custkey % 4 = 0 THEN 'no time' END AS problem FROM customer")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lack something, by the first thing missing, beside the good ones."""
    raw = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, "n").alias("name"), F.when(F.col("c_custkey") % 4 != 0, 1).alias("time"))
    good, bad = normalize.quarantined(raw, {"no name": F.col("name"), "no time": F.col("time")})
    return good.select("id", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("id", "problem"))


_CRAWLS = "SELECT o_orderkey AS id, 'old' AS state FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0"


@query(f"SELECT id, min(state) AS state FROM ({_CRAWLS}) GROUP BY id")
def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crawls by id: the later one's record wins."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return readers.latest([orders.where("id % 3 <> 0").withColumn("state", F.lit("old")), orders.where("id % 2 = 0").withColumn("state", F.lit("new"))])


# --- corpora and histories ----------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.encode("text", "UTF-8").alias("data"), "doc_id")


@query("SELECT type, sha1(data) AS id FROM (SELECT DISTINCT lang AS type, text AS data FROM documents) ORDER BY sha1(data), type LIMIT 1024")
def corpus_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct entries, of which a pack holds the first 1024 by digest."""
    return readers.packed_corpus(_entries(spark, sf_dir).select("type", "data")).select("type", F.sha1("data").alias("id"))


@query("SELECT DISTINCT lang AS type, sha1(text) AS id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 > 0 AND b.lang = a.lang AND b.text = a.text)")
def corpus_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the whole corpus that one without every third document no longer has."""
    whole = _entries(spark, sf_dir)
    return readers.archived(whole, whole.where("doc_id % 3 > 0")).select("type", F.sha1("data").alias("id"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events")
def event_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.numbered(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", F.col("seq").cast("long").alias("seq"))


_DELETED = "SELECT l_partkey AS blob, l_suppkey AS path, CAST(epoch(l_shipdate) AS BIGINT) AS seconds, l_orderkey * 10 + l_linenumber AS commit FROM lineitem"


@query(f"SELECT DISTINCT blob, path, seconds, commit FROM ({_DELETED}) QUALIFY row_number() OVER (PARTITION BY blob, path ORDER BY seconds, commit) = 1 OR row_number() OVER (PARTITION BY blob, path ORDER BY seconds DESC, commit DESC) = 1")
def deletion_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest and the newest deletion of each blob and path."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("blob"), F.col("l_suppkey").alias("path"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("seconds"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit")
    )
    return readers.deletions_ends(rows)


@query("SELECT DISTINCT l_partkey AS blob FROM lineitem WHERE l_partkey NOT IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_orderkey % 16 = 0))")
def deleted_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of a history that its last state does not hold."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("blob"), "l_orderkey")
    return readers.deleted_blobs(rows.select("blob"), rows.where("l_orderkey % 16 = 0").select("blob"))


@query("SELECT o_orderkey AS depth, 'a' || o_orderkey AS value FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 = 0")
def trailer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines with a prefix, of commits that touch one path."""
    key = F.col("o_orderkey")
    message = F.when(key % 3 > 0, F.concat(F.lit("subject\n\nSource:  a"), key.cast("string"), F.lit(" \nSource: later"))).otherwise("subject\nOther: a")
    commits = read(spark, sf_dir, "orders").select(key.alias("depth"), message.alias("message"), F.when(key % 5 == 0, F.array(F.lit("src/a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("paths"))
    return readers.trailers(commits, "Source:", path="src/a")


# --- annotations ------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: a definition, a fenced group that does not count, and a use beside a link."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("r"), (F.col("p_partkey") % 50).cast("string"), F.lit(".s"), (F.col("p_partkey") % 7).cast("string"))
    content = F.concat(F.lit("// [def "), name, F.lit(" +perf-test @children]\n```\n[impl fenced.id]\n```\nuse [impl "), name, F.lit("] and [a](b)\n"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), F.lpad(key, 8, "0")).alias("path"), content.alias("content"))


_FILES = "SELECT 'src/f' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS file, 'r' || p_partkey % 50 || '.s' || p_partkey % 7 AS id FROM part"


@query(
    f"SELECT 'def' AS kind, id, 'perf' AS added, 'test' AS removed, 'children' AS mode, file, CAST(1 AS INTEGER) AS line, CAST(4 AS INTEGER) AS col, 'def ' || id || ' +perf-test @children]' AS context FROM ({_FILES}) "
    f"UNION ALL SELECT 'impl', id, '', '', NULL, file, 5, 5, 'use [impl ' || id || '] and [a](b)' FROM ({_FILES})"
)
def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of all files with their context."""
    found = annotations.parse(_files(spark, sf_dir), with_context=True)
    last = F.element_at(F.split("context", "\n"), -1)
    return found.select("kind", "id", F.array_join("add_types", "+").alias("added"), F.array_join("remove_types", "+").alias("removed"), "mode", "file", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), last.alias("context"))


@query(f"SELECT id, file, row_number() OVER (PARTITION BY id ORDER BY file) = 1 AS first FROM ({_FILES})")
def definition_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that count, and those that another file's precedes."""
    found = annotations.parse(_files(spark, sf_dir))
    first = hierarchy.definitions(found).select("id", "file", F.lit(True).alias("first"))
    return first.unionByName(hierarchy.duplicate_definitions(found).select("id", "file", F.lit(False).alias("first")))


# --- small functions ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(floor(sqrt(o_orderkey * 104729)) AS BIGINT) AS root FROM orders")
def integer_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", bijections.isqrt(F.col("o_orderkey") * 104729).alias("root"))


@query(f"SELECT o_orderkey, {_base36('o_orderkey')} AS id, CAST(o_orderkey AS BIGINT) AS back, CASE WHEN o_orderkey % 2 = 0 THEN 'wrong length' ELSE 'invalid digit' END AS problem FROM orders")
def base36_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "orders").select("o_orderkey", codecs.base36_encode(F.col("o_orderkey")).alias("id"))
    broken = F.when(F.col("o_orderkey") % 2 == 0, F.concat("id", F.lit("0"))).otherwise(F.concat(F.substring("id", 1, 7), F.lit("Z")))
    return made.select("o_orderkey", "id", codecs.base36_decode(F.col("id"))["value"].alias("back"), codecs.base36_decode(broken)["error"].alias("problem"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def requirement_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a.b"), key)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a..b"), key)).otherwise(F.concat(F.lit(".a"), key))
    return read(spark, sf_dir, "part").select("p_partkey", text.valid_requirement_id(name).alias("valid"))
