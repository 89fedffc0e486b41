"""Ranked leaderboards and record progressions over run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that name a board; level_id is null for whole-game categories.
BOARD = ["game_id", "category_id", "level_id"]

#: Shares of a board that a progression is thinned in.
SHARES = 64


def primary_time(timing: Column, times: Column) -> Column:
    """The time by which a game ranks its runs."""
    return F.when(timing == "IGT", times["igt"]).when(timing == "RTA", times["rta"]).when(timing == "RTA_NL", times["rta_nl"])


def ranking_order() -> list[Column]:
    """Time, date, submission and id; unknown dates come first."""
    return [F.col("ms"), F.asc_nulls_first("date"), F.asc_nulls_first("created"), F.col("id")]


def best_of_each(runs: DataFrame, board: list[str] = BOARD) -> DataFrame:
    """The first run of each exact, ordered player list on each board.

    A minimum of structs: it combines before the shuffle, so a hot board sends one row for each player
    list and map task, where a window would send and sort all its runs.
    """
    # a struct's null fields sort first, as the order of dates wants
    order = F.struct("ms", "date", "created", "id")
    rest = [c for c in runs.columns if c not in (*board, "players")]
    best = runs.groupBy(*board, "players").agg(F.min_by(F.struct(*rest), order).alias("__best"))
    return best.select(*board, "players", "__best.*").select(*runs.columns)


def leaderboard(runs: DataFrame, board: list[str] = BOARD, rank_obsoletes: bool = False, limit: int | None = None) -> DataFrame:
    """Runs with rank, tied_rank and is_tied on their board.

    runs: (*board, id, players, ms, date, created, ...), ms without nulls. Only the first run of each player
    list ranks, unless rank_obsoletes. rank counts 1..n; runs of one time share tied_rank, the rank of the
    first of them. A limit below 0 counts as 0.
    """
    kept = runs.where("ms is not null") if rank_obsoletes else best_of_each(runs.where("ms is not null"), board)
    here = Window.partitionBy(*board)
    out = kept.withColumn("rank", F.row_number().over(here.orderBy(*ranking_order())).cast("long"))
    if limit is None:
        tied = Window.partitionBy(*board, "ms")
        out = out.withColumn("tied_rank", F.rank().over(here.orderBy("ms")).cast("long"))
        return out.withColumn("is_tied", F.count(F.lit(1)).over(tied) > 1)
    # one row more than asked for tells whether the last one is tied; all faster runs are among them
    out = out.where(F.col("rank") <= max(limit, 0) + 1)
    out = out.withColumn("tied_rank", F.rank().over(here.orderBy("ms")).cast("long"))
    out = out.withColumn("is_tied", F.count(F.lit(1)).over(Window.partitionBy(*board, "ms")) > 1)
    return out.where(F.col("rank") <= max(limit, 0))


def wide_leaderboard(runs: DataFrame, board: list[str] = BOARD, ranges: int = 128) -> DataFrame:
    """leaderboard() for boards too large for one task.

    Each board's times are cut into ranges at its own quantiles, so that a skewed board or a stray time leaves
    none with more than its share; ranks count inside a range and start after the rows of the ranges before it.
    Runs of one time lie in one range, so ties stay together.
    """
    kept = best_of_each(runs.where("ms is not null"), board)
    cuts = kept.groupBy(*board).agg(F.percentile_approx("ms", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("__cuts"))
    here = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in board])
    below = F.size(F.filter("r.__cuts", lambda c: c < F.col("l.ms")))
    kept = kept.alias("l").join(cuts.alias("r"), here).select("l.*", below.alias("__range"))
    sizes = kept.groupBy(*board, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*board).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*board, "__range")])
    joined = kept.alias("l").join(sizes.alias("r"), same).select("l.*", "r.__before")
    here = Window.partitionBy(*board, "__range")
    return (
        joined.withColumn("rank", F.col("__before") + F.row_number().over(here.orderBy(*ranking_order())))
        .withColumn("tied_rank", F.col("__before") + F.rank().over(here.orderBy("ms")))
        .withColumn("is_tied", F.count(F.lit(1)).over(Window.partitionBy(*board, "__range", "ms")) > 1)
        .drop("__range", "__before")
    )


def progression(runs: DataFrame, board: list[str] = BOARD) -> DataFrame:
    """Runs that set a record when they were made, with progress_ms, what they took off the record before.

    In order of date, submission and id, unknown ones first. The first run of a board has progress 0. A run that an
    earlier one of its share of the board beats is no record of the board: each board is thinned in SHARES shares
    first, so that only their records meet in one task.
    """
    when = lambda *keys: Window.partitionBy(*keys).orderBy(F.asc_nulls_first("date"), F.asc_nulls_first("created"), "id").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__best").isNull() | (F.col("ms") < F.col("__best"))
    shares = runs.where("ms is not null").withColumn("__share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int"))
    thinned = shares.withColumn("__best", F.min("ms").over(when(*board, "__share"))).where(ahead).drop("__share", "__best")
    records = thinned.withColumn("__best", F.min("ms").over(when(*board))).where(ahead)
    return records.withColumn("progress_ms", F.coalesce(F.col("__best") - F.col("ms"), F.lit(0))).drop("__best")


def progression_with_ranks(runs: DataFrame, board: list[str] = BOARD) -> DataFrame:
    """progression() with the run's place on today's leaderboard, null where it is obsolete."""
    ranks = leaderboard(runs, board).select("id", "rank", "tied_rank", "is_tied")
    return progression(runs, board).join(ranks, "id", "left")


def latest_first(records: DataFrame) -> DataFrame:
    """Progression rows for display: newest first, unknown dates last."""
    return records.orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("created"), F.asc_nulls_first("level_id"), "id")
