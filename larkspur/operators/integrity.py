"""Validation of the relational tables, and their cleaning to a fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import slugify
from larkspur.operators.lineage import cut

_TABLES = ("games", "categories", "levels", "runs", "users")


def _order(table: str) -> list[Column]:
    name = [F.octet_length("name"), F.col("name"), F.col("id")]
    if table == "games":
        return [F.asc_nulls_first("created"), F.octet_length("slug"), *name]
    return [F.asc_nulls_first("created"), *name] if table == "users" else name


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti")


def errors(t: dict[str, DataFrame]) -> DataFrame:
    """(table, row_id, rule, detail) for every violation.

    Rules: missing game, category, level or user; no time by the game's timing method; empty user name or
    slug; slugs that another row has, by users, by games, by categories of a game slug and kind, and by
    levels of a game slug.
    """
    say = lambda df, table, rule, detail: df.select(F.lit(table).alias("table"), F.col("id").alias("row_id"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    games = t["games"].select(F.col("id").alias("game_id"), F.col("slug").alias("game_slug"), "primary_timing")
    found = [say(orphans(t[c], "game_id", t["games"]), c, "missing game", F.col("game_id")) for c in ("categories", "levels", "runs")]
    found.append(say(orphans(t["runs"], "category_id", t["categories"]), "runs", "missing category", F.col("category_id")))
    found.append(say(orphans(t["runs"], "level_id", t["levels"]), "runs", "missing level", F.col("level_id")))
    players = t["runs"].select("id", F.explode("players").alias("p")).select("id", F.col("p.user_id").alias("user_id")).distinct()
    found.append(say(orphans(players, "user_id", t["users"]), "runs", "missing user", F.col("user_id")))
    timing = F.col("primary_timing")
    ms = F.when(timing == "IGT", F.col("times_ms.igt")).when(timing == "RTA", F.col("times_ms.rta")).otherwise(F.col("times_ms.rta_nl"))
    found.append(say(t["runs"].join(games, "game_id").where(ms.isNull()), "runs", "no primary time", timing))
    found.append(say(t["users"].where((F.col("name") == "") | (F.col("slug") == "")), "users", "empty name", F.col("name")))
    for table in slugs(t):
        found.append(say(duplicates(t, table), table, "slug is not unique", F.col("slug")))
    return reduce(DataFrame.unionByName, found)


def slugs(t: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, Column]]:
    """For each table with slugs: its rows, with the games' slug where the key needs it, and the unique key."""
    games = t["games"].select(F.col("id").alias("game_id"), F.col("slug").alias("game_slug"))
    return {
        "users": (t["users"], F.col("slug")),
        "games": (t["games"], F.col("slug")),
        "categories": (t["categories"].join(games, "game_id"), F.concat_ws("/", "game_slug", slugify(F.col("per")), "slug")),
        "levels": (t["levels"].join(games, "game_id"), F.concat_ws("/", "game_slug", "slug")),
    }


def duplicates(t: dict[str, DataFrame], table: str, losers_only: bool = False) -> DataFrame:
    """Rows whose slug key another row has, with the key as slug; only those that go, or all."""
    rows, key = slugs(t)[table]
    rows = rows.withColumn("__key", key)
    # keys that repeat are found by a count that combines before the shuffle; only their rows are ordered
    repeated = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2").select("__key")
    rows = rows.join(repeated, "__key", "left_semi")
    if losers_only:
        place = Window.partitionBy("__key").orderBy(*_order(table))
        rows = rows.withColumn("__at", F.row_number().over(place)).where("__at > 1").drop("__at")
    return rows.withColumn("slug", F.col("__key")).drop("__key")


def invalid(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each table the ids (id) of the rows that one pass removes."""
    wrong = errors({**t}).where("rule <> 'slug is not unique'")
    out = {c: wrong.where(F.col("table") == c).select(F.col("row_id").alias("id")) for c in _TABLES}
    for c in ("users", "games", "categories", "levels"):
        out[c] = out[c].union(duplicates(t, c, losers_only=True).select("id"))
    return {c: ids.distinct() for c, ids in out.items()}


def clean(t: dict[str, DataFrame], most_rounds: int = 100) -> tuple[dict[str, DataFrame], list[dict[str, tuple[int, int]]]]:
    """(tables, log): rows removed until none is invalid; the log has (invalid, percent) by table and round.

    A row that goes can orphan others, and two games of one slug make their categories collide, so passes
    repeat. Lineage is cut after each.
    """
    t, log = dict(t), []
    for _ in range(most_rounds):
        bad = {c: cut(ids) for c, ids in invalid(t).items()}
        counts = {c: ids.count() for c, ids in bad.items()}
        if not any(counts.values()):
            return t, log
        log.append({c: (n, n * 100 // max(t[c].count(), 1)) for c, n in counts.items()})
        t = {c: cut(df.join(bad[c], "id", "left_anti")) if counts[c] else df for c, df in t.items()}
    raise RuntimeError(f"tables are not clean after {most_rounds} rounds")
