"""Five related tables (games, categories, levels, users, runs) derived from the star-schema tables.

Nations are games, order priorities are categories, customers are users and orders are runs. The derivation is
arithmetic on keys, so that it reads the same in SQL; it plants ties, shared slugs, guests, teams, orphans and
nulls. SQL below is the same derivation for DuckDB, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import slugify


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    games = nation.select(
        key.alias("id"), F.when(key % 4 != 0, F.timestamp_seconds(F.lit(946684800) + key * 86400)).alias("created"),
        # two games share a slug where the key is 7 or 8
        slugify(F.when(key == 8, F.lit("NATION_7")).otherwise(F.col("n_name"))).alias("slug"), F.col("n_name").alias("name"),
        F.element_at(F.array(F.lit("IGT"), F.lit("RTA"), F.lit("RTA_NL")), (key % 3 + 1).cast("int")).alias("primary_timing"),
    )
    five = nation.select(key.alias("game_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("k"))
    categories = five.select(
        # game 24's categories point to a game that does not exist
        F.when(F.col("game_id") == 24, 99).otherwise(F.col("game_id")).cast("long").alias("game_id"),
        slugify(F.concat(F.lit("Any% "), F.when(F.col("k") == 5, 4).otherwise(F.col("k")))).alias("slug"),
        F.concat(F.lit("Any% "), F.col("k")).alias("name"), (F.col("game_id") * 10 + F.col("k")).alias("id"),
        F.when(F.col("k") % 2 == 0, "PerLevel").otherwise("PerGame").alias("per"), F.lit("").alias("rules"),
    )
    levels = five.where("k <= 3").select(
        "game_id", (F.col("game_id") * 10 + F.col("k")).alias("id"), slugify(F.concat(F.lit("Level / "), F.col("k"))).alias("slug"),
        F.concat(F.lit("Level / "), F.col("k")).alias("name"), F.lit("").alias("rules"),
    )
    users = read(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 5 != 0, F.timestamp_seconds(F.lit(978307200) + F.col("c_custkey") * 60)).alias("created"),
        slugify(F.concat(F.lit("u"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 50 == 1, 1).otherwise(0)).cast("string"))).alias("slug"),
        F.col("c_name").alias("name"), F.col("c_custkey").alias("id"),
    )
    return {"games": games, "categories": categories, "levels": levels, "users": users, "runs": _runs(spark, sf_dir)}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    game = (cust % 25).cast("long")
    base = (F.floor(F.col("o_totalprice") / 500) * 1000).cast("long")
    nobody = F.lit(None).cast("long")
    guest = F.struct(nobody.alias("user_id"), F.concat(F.lit("guest"), (key % 3).cast("string")).alias("guest_name"))
    known = F.struct((cust - F.when(key % 2 == 0, cust % 20).otherwise(0)).cast("long").alias("user_id"), F.lit(None).cast("string").alias("guest_name"))
    return o.select(
        game.alias("game_id"), (game * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("category_id"),
        F.when(F.substring("o_orderpriority", 1, 1).cast("int") % 2 == 0, game * 10 + key % 4).alias("level_id"), key.alias("id"),
        F.when(key % 7 != 0, F.timestamp_seconds(F.unix_timestamp("o_orderdate") + key % 1000)).alias("created"),
        F.when(key % 5 != 0, F.to_date("o_orderdate")).alias("date"),
        F.struct(
            F.when(key % 11 != 0, base).alias("igt"), F.when(key % 13 != 0, base + key % 2 * 1000).alias("rta"), F.when(key % 6 != 5, base + 500).alias("rta_nl")
        ).alias("times_ms"),
        F.when(key % 6 == 0, F.array(known, guest)).when(key % 6 == 1, F.array(guest)).otherwise(F.array(known)).alias("players"),
        F.array(
            F.struct(F.lit("youtube").alias("kind"), F.concat(F.lit("v"), key.cast("string")).alias("id"), F.when(key % 2 == 0, (key % 100).cast("int")).alias("start"), F.lit(None).cast("string").alias("url"))
        ).alias("videos"),
    )


def timed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with ms, the time by their game's timing method, where they have one. Games are few by nature."""
    from larkspur.operators.ranking import primary_time

    t = tables(spark, sf_dir)
    games = t["games"].select(F.col("id").alias("game_id"), "primary_timing")
    return t["runs"].join(games, "game_id").withColumn("ms", primary_time(F.col("primary_timing"), F.col("times_ms"))).where("ms is not null")


def players_text(players):
    """A player list as text, for results that are compared."""
    return F.array_join(F.transform(players, lambda p: F.coalesce(p["user_id"].cast("string"), p["guest_name"])), "+")


_SLUG = "CASE WHEN {s} = '' THEN '_' ELSE {s} END"


def sql_slug(text: str) -> str:
    out = r"[^A-Za-z0-9+\-/'']"
    s = f"regexp_replace(regexp_replace(regexp_replace({text}, '^{out}+|{out}+$', '', 'g'), '{out}+', '_', 'g'), '[/'']', '', 'g')"
    return _SLUG.format(s=s)


SQL = rf"""
games AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 4 <> 0 THEN 946684800 + CAST(n_nationkey AS BIGINT) * 86400 END AS created,
  {sql_slug("CASE WHEN n_nationkey = 8 THEN 'NATION_7' ELSE n_name END")} AS slug, n_name AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'IGT' WHEN 1 THEN 'RTA' ELSE 'RTA_NL' END AS primary_timing FROM nation),
five AS (SELECT CAST(n_nationkey AS BIGINT) AS game_id, k FROM nation, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS BIGINT) AS k)),
categories AS (SELECT CAST(CASE WHEN game_id = 24 THEN 99 ELSE game_id END AS BIGINT) AS game_id,
  {sql_slug("'Any% ' || CASE WHEN k = 5 THEN 4 ELSE k END")} AS slug, 'Any% ' || k AS name, game_id * 10 + k AS id,
  CASE WHEN k % 2 = 0 THEN 'PerLevel' ELSE 'PerGame' END AS per, '' AS rules FROM five),
levels AS (SELECT game_id, game_id * 10 + k AS id, {sql_slug("'Level / ' || k")} AS slug, 'Level / ' || k AS name, '' AS rules FROM five WHERE k <= 3),
users AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN 978307200 + c_custkey * 60 END AS created,
  {sql_slug("'u' || (c_custkey - CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END)")} AS slug, c_name AS name, c_custkey AS id FROM customer),
raw_runs AS (SELECT *, CAST(o_custkey % 25 AS BIGINT) AS game_id, CAST(o_orderpriority[1] AS BIGINT) AS k, CAST(floor(o_totalprice / 500) AS BIGINT) * 1000 AS base,
  CAST(o_custkey - CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 20 ELSE 0 END AS BIGINT) AS known FROM orders),
runs AS (SELECT game_id, game_id * 10 + k AS category_id, CASE WHEN k % 2 = 0 THEN game_id * 10 + o_orderkey % 4 END AS level_id, o_orderkey AS id,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 1000 END AS created,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
  CASE WHEN o_orderkey % 11 <> 0 THEN base END AS igt, CASE WHEN o_orderkey % 13 <> 0 THEN base + o_orderkey % 2 * 1000 END AS rta,
  CASE WHEN o_orderkey % 6 <> 5 THEN base + 500 END AS rta_nl,
  CASE o_orderkey % 6 WHEN 0 THEN known || '+guest' || (o_orderkey % 3) WHEN 1 THEN 'guest' || (o_orderkey % 3) ELSE CAST(known AS VARCHAR) END AS players,
  CASE WHEN o_orderkey % 6 <> 1 THEN known END AS user_id, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'guest' || (o_orderkey % 3) END AS guest_name FROM raw_runs),
timed AS (SELECT r.*, CASE g.primary_timing WHEN 'IGT' THEN igt WHEN 'RTA' THEN rta ELSE rta_nl END AS ms FROM runs r JOIN games g ON r.game_id = g.id),
timed_runs AS (SELECT * FROM timed WHERE ms IS NOT NULL)
"""
