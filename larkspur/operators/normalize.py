"""Raw API records (users, games, runs) to the relational tables; what does not fit goes to a quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.codecs import base36_decode
from larkspur.functions.text import duration_ms, slugify

TIMING = {"ingame": "IGT", "realtime": "RTA", "realtime_noloads": "RTA_NL"}
PER = {"per-game": "PerGame", "per-level": "PerLevel"}

USER = "id string, names struct<international:string,japanese:string>, signup timestamp"
NAMED = "struct<data:array<struct<id:string,name:string,rules:string,type:string>>>"
GAME = f"id string, abbreviation string, names struct<international:string,japanese:string>, created timestamp, ruleset struct<`default-time`:string>, categories {NAMED}, levels {NAMED}"
RUN = (
    "id string, game string, category string, level string, submitted timestamp, date date, status struct<status:string>, "
    "times struct<ingame:string,realtime:string,realtime_noloads:string>, players array<struct<rel:string,id:string,name:string>>, "
    "videos array<struct<uri:string>>"
)


def coded(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in names.items()])


def number(text: Column) -> Column:
    return base36_decode(text)["value"]


def users(raw: DataFrame) -> DataFrame:
    """One user for each record; without a name it is `Corrupt User <id>`."""
    name = F.coalesce("names.international", "names.japanese", F.concat(F.lit("Corrupt User "), "id"))
    return raw.select(F.col("signup").alias("created"), slugify(name).alias("slug"), name.alias("name"), number(F.col("id")).alias("id"))


def games(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, categories, levels), the latter two from the records' lists."""
    name = F.coalesce("names.international", "names.japanese")
    game = raw.select(
        number(F.col("id")).alias("id"), "created", F.col("abbreviation").alias("slug"), name.alias("name"),
        coded(F.col("ruleset").getField("default-time"), TIMING).alias("primary_timing"),
    )
    listed = lambda field: raw.select(number(F.col("id")).alias("game_id"), F.explode(f"{field}.data").alias("c")).select(
        "game_id", number(F.col("c.id")).alias("id"), slugify(F.col("c.name")).alias("slug"), F.col("c.name").alias("name"),
        F.coalesce("c.rules", F.lit("")).alias("rules"), coded(F.col("c.type"), PER).alias("per"),
    )
    return game, listed("categories"), listed("levels").drop("per")


def runs(raw: DataFrame) -> DataFrame:
    """Verified runs only; players by id, guests by name; durations in milliseconds."""
    player = lambda p: F.struct(F.when(p["rel"] == "user", number(p["id"])).alias("user_id"), F.when(p["rel"] == "guest", p["name"]).alias("guest_name"))
    youtube = r"(?:youtube\.com/watch\?v=|youtu\.be/)([A-Za-z0-9_-]{11})"
    video = lambda v: F.struct(
        F.when(v["uri"].rlike(youtube), "youtube").otherwise("link").alias("kind"), F.nullif(F.regexp_extract(v["uri"], youtube, 1), F.lit("")).alias("id"),
        F.nullif(F.regexp_extract(v["uri"], r"[?&]t=(\d+)", 1), F.lit("")).cast("int").alias("start"), F.when(~v["uri"].rlike(youtube), v["uri"]).alias("url"),
    )
    times = F.struct(*[duration_ms(F.col(f"times.{k}")).alias(v.lower()) for k, v in TIMING.items()])
    return raw.where(F.col("status.status") == "verified").select(
        number(F.col("game")).alias("game_id"), number(F.col("category")).alias("category_id"), number(F.col("level")).alias("level_id"), number(F.col("id")).alias("id"),
        F.col("submitted").alias("created"), "date", times.alias("times_ms"), F.transform("players", player).alias("players"), F.transform("videos", video).alias("videos"),
    )


def quarantined(raw: DataFrame, required: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows have `problem`, the name of the first required expression that is null."""
    problem = F.coalesce(*[F.when(c.isNull(), F.lit(n)) for n, c in required.items()])
    marked = raw.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")
