"""Queries over the run tables: boards, progressions, joins, aggregates, integrity, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import codecs, text
from larkspur.operators import integrity, ranking
from larkspur.plans.fixture import SQL, players_text, tables, timed_runs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_BOARD = "game_id, category_id, level_id"
_ORDER = "ms, date NULLS FIRST, created NULLS FIRST, id"


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that checks it; `WITH` and the fixture are put in front."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {SQL} {sql}"
        return f

    return put


_FIRST = f"first_runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BOARD}, players ORDER BY {_ORDER}) AS nth FROM timed_runs) WHERE nth = 1)"
_RANKED = (
    f"row_number() OVER (PARTITION BY {_BOARD} ORDER BY {_ORDER}) AS rank, rank() OVER (PARTITION BY {_BOARD} ORDER BY ms) AS tied_rank, "
    f"count(*) OVER (PARTITION BY {_BOARD}, ms) > 1 AS is_tied"
)
_BOARD_COLUMNS = ["game_id", "category_id", "level_id", "id", "ms", "players", "rank", "tied_rank", "is_tied"]


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("players", players_text(F.col("players"))).select(*columns)


@query(f", {_FIRST} SELECT {_BOARD}, id, ms, players, {_RANKED} FROM first_runs")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.leaderboard(timed_runs(spark, sf_dir)), *_BOARD_COLUMNS)


@query(f", {_FIRST} SELECT {_BOARD}, id, ms, players, {_RANKED} FROM first_runs")
def leaderboard_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.wide_leaderboard(timed_runs(spark, sf_dir)), *_BOARD_COLUMNS)


@query(f"SELECT {_BOARD}, id, ms, players, {_RANKED} FROM timed_runs")
def leaderboard_with_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.leaderboard(timed_runs(spark, sf_dir), rank_obsoletes=True), *_BOARD_COLUMNS)


@query(f", {_FIRST} SELECT * FROM (SELECT {_BOARD}, id, ms, players, {_RANKED} FROM first_runs) WHERE rank <= 3")
def leaderboard_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranking.leaderboard(timed_runs(spark, sf_dir), limit=3), *_BOARD_COLUMNS)


_WHEN = "date NULLS FIRST, created NULLS FIRST, id"
_RECORDS = (
    f"records AS (SELECT *, coalesce(best - ms, 0) AS progress_ms FROM (SELECT *, min(ms) OVER (PARTITION BY {_BOARD} ORDER BY {_WHEN} "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM timed_runs) WHERE best IS NULL OR ms < best)"
)


@query(f", {_RECORDS} SELECT {_BOARD}, id, ms, progress_ms FROM records")
def progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.progression(timed_runs(spark, sf_dir)).select("game_id", "category_id", "level_id", "id", "ms", "progress_ms")


@query(
    f", {_FIRST}, {_RECORDS}, ranked AS (SELECT id, {_RANKED} FROM first_runs) "
    f"SELECT r.game_id, r.category_id, r.level_id, r.id, r.ms, progress_ms, rank, tied_rank, is_tied FROM records r LEFT JOIN ranked USING (id)"
)
def progression_with_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.progression_with_ranks(timed_runs(spark, sf_dir))
    return found.select("game_id", "category_id", "level_id", "id", "ms", "progress_ms", "rank", "tied_rank", "is_tied")


@query(
    f", {_RECORDS} SELECT id, CAST(row_number() OVER (ORDER BY date DESC NULLS LAST, created DESC NULLS LAST, level_id NULLS FIRST, id) AS BIGINT) AS place "
    "FROM records WHERE game_id = 3 AND category_id = 31"
)
def progression_latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One category's records in display order; the place is counted over that category alone."""
    runs = timed_runs(spark, sf_dir).where("game_id = 3 and category_id = 31")
    order = [F.desc_nulls_last("date"), F.desc_nulls_last("created"), F.asc_nulls_first("level_id"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("game_id", "category_id").orderBy(*order)).cast("long")
    return ranking.progression(runs).select("id", place.alias("place"))


@query(
    f", {_RECORDS} SELECT id, CAST(row_number() OVER (PARTITION BY game_id, category_id ORDER BY date DESC NULLS LAST, created DESC NULLS LAST, level_id NULLS FIRST, id) AS BIGINT) AS place "
    "FROM records"
)
def progressions_latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every category in display order; places are counted in each (game, category)."""
    order = [F.desc_nulls_last("date"), F.desc_nulls_last("created"), F.asc_nulls_first("level_id"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("game_id", "category_id").orderBy(*order)).cast("long")
    return ranking.progression(timed_runs(spark, sf_dir)).select("id", place.alias("place"))


# --- joins ----------------------------------------------------------------------------------------------


@query(
    "SELECT r.id, g.slug AS game, c.slug AS category, l.slug AS level, t.ms, CAST(date_diff('day', DATE '1970-01-01', r.date) AS BIGINT) * 86400 + 43684 AS date_s "
    "FROM runs r JOIN games g ON r.game_id = g.id JOIN categories c ON r.category_id = c.id LEFT JOIN levels l ON r.level_id = l.id JOIN timed t ON t.id = r.id"
)
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run to game, category and level; its ranked time and its date in seconds."""
    t = tables(spark, sf_dir)
    games = t["games"].select(F.col("id").alias("game_id"), F.col("slug").alias("game"), "primary_timing")
    categories = t["categories"].select(F.col("id").alias("category_id"), F.col("slug").alias("category"))
    levels = t["levels"].select(F.col("id").alias("level_id"), F.col("slug").alias("level"))
    joined = t["runs"].join(games, "game_id").join(categories, "category_id").join(levels, "level_id", "left")
    ms = ranking.primary_time(F.col("primary_timing"), F.col("times_ms"))
    return joined.select("id", "game", "category", "level", ms.alias("ms"), text.epoch_at_noon(F.col("date")).alias("date_s"))


@query(
    "SELECT r.id, concat_ws('+', CASE WHEN r.user_id IS NOT NULL THEN coalesce(u.name, '?') END, r.guest_name) AS names FROM runs r LEFT JOIN users u ON r.user_id = u.id"
)
def run_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players in their order with the users' names; guests as they are, unknown users as `?`."""
    t = tables(spark, sf_dir)
    each = t["runs"].select("id", F.posexplode_outer("players").alias("at", "p"))
    users = t["users"].select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    named = each.select("id", "at", "p.*").join(users, "user_id", "left")
    name = F.when(F.col("user_id").isNull(), F.col("guest_name")).otherwise(F.coalesce("user_name", F.lit("?")))
    listed = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", name.alias("name")))).alias("names"))
    return listed.select("id", F.array_join("names.name", "+").alias("names"))


@query("SELECT g.slug, r.id AS run_id FROM games g JOIN runs r ON r.game_id = g.id")
def game_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return t["games"].select("slug", F.col("id").alias("game_id")).join(t["runs"].select("game_id", F.col("id").alias("run_id")), "game_id").select("slug", "run_id")


@query("SELECT g.slug AS game, l.slug AS level FROM games g JOIN levels l ON l.game_id = g.id")
def game_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    games = t["games"].select(F.col("slug").alias("game"), F.col("id").alias("game_id"))
    return games.join(t["levels"].select("game_id", F.col("slug").alias("level")), "game_id").select("game", "level")


@query(
    "SELECT g.slug AS game, c.per, c.name, CAST(row_number() OVER (PARTITION BY g.id, c.per ORDER BY c.name, c.id) AS BIGINT) AS place "
    "FROM games g JOIN categories c ON c.game_id = g.id"
)
def game_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-game and level categories of each game, each in order of name and id."""
    t = tables(spark, sf_dir)
    games = t["games"].select(F.col("slug").alias("game"), F.col("id").alias("game_id"))
    place = F.row_number().over(Window.partitionBy("game_id", "per").orderBy("name", "id")).cast("long")
    return games.join(t["categories"].drop("slug"), "game_id").withColumn("place", place).select("game", "per", "name", "place")


@query("SELECT c.id AS category_id, l.id AS level_id FROM categories c JOIN levels l ON l.game_id = c.game_id WHERE c.per = 'PerLevel'")
def category_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level of its game for each level category."""
    t = tables(spark, sf_dir)
    categories = t["categories"].where("per = 'PerLevel'").select("game_id", F.col("id").alias("category_id"))
    return categories.join(t["levels"].select("game_id", F.col("id").alias("level_id")), "game_id").select("category_id", "level_id")


@query("SELECT id, name FROM levels WHERE game_id = 3 AND slug = 'Level__2'")
def level_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["levels"].where("game_id = 3 and slug = 'Level__2'").select("id", "name")


@query("SELECT DISTINCT r.user_id FROM runs r WHERE r.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.id % 3 <> 0)")
def users_not_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that runs name but a partial user table (without each third) lacks."""
    t = tables(spark, sf_dir)
    named = t["runs"].select(F.explode("players").alias("p")).select("p.user_id").where("user_id is not null").distinct()
    return named.join(t["users"].where("id % 3 <> 0").select(F.col("id").alias("user_id")), "user_id", "left_anti")


# --- aggregates -------------------------------------------------------------------------------------------


@query("SELECT coalesce(max(created), 0) AS last_updated, count(*) AS runs, (SELECT count(*) FROM games) AS games FROM runs")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    runs = t["runs"].agg(F.coalesce(F.unix_timestamp(F.max("created")), F.lit(0)).alias("last_updated"), F.count(F.lit(1)).alias("runs"))
    return runs.crossJoin(t["games"].agg(F.count(F.lit(1)).alias("games")))  # two single rows


@query(f"SELECT {_BOARD}, count(*) AS runs FROM runs GROUP BY ALL")
def runs_by_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["runs"].groupBy("game_id", "category_id", "level_id").agg(F.count(F.lit(1)).alias("runs"))


@query("SELECT g.id, count(r.id) FILTER (r.id % 2 = 0) AS before, count(r.id) AS after FROM games g LEFT JOIN runs r ON r.game_id = g.id GROUP BY g.id")
def runs_before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each game in an earlier state (even ids) and now."""
    t = tables(spark, sf_dir)
    runs = t["runs"].groupBy("game_id").agg(F.count_if(F.col("id") % 2 == 0).alias("before"), F.count(F.lit(1)).alias("after"))
    joined = t["games"].select("id").join(runs.withColumnRenamed("game_id", "id"), "id", "left")
    return joined.select("id", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


# --- integrity ----------------------------------------------------------------------------------------------

_KEYS = """
keyed AS (
  SELECT 'users' AS tbl, id, slug AS key, created, octet_length(encode(slug)) AS slug_len, name, NULL AS game_id FROM users
  UNION ALL SELECT 'games', id, slug, created, octet_length(encode(slug)), name, NULL FROM games
  UNION ALL SELECT 'categories', c.id, g.slug || '/' || c.per || '/' || c.slug, NULL, 0, c.name, c.game_id FROM categories c JOIN games g ON c.game_id = g.id
  UNION ALL SELECT 'levels', l.id, g.slug || '/' || l.slug, NULL, 0, l.name, l.game_id FROM levels l JOIN games g ON l.game_id = g.id),
dup AS (SELECT *, count(*) OVER (PARTITION BY tbl, key) AS n, row_number() OVER (PARTITION BY tbl, key
  ORDER BY created NULLS FIRST, CASE WHEN tbl = 'games' THEN slug_len END, octet_length(encode(name)), name, id) AS nth FROM keyed)
"""
_ERRORS = """
found AS (
  SELECT 'categories' AS "table", id AS row_id, 'missing game' AS rule, CAST(game_id AS VARCHAR) AS detail FROM categories WHERE game_id NOT IN (SELECT id FROM games)
  UNION ALL SELECT 'levels', id, 'missing game', CAST(game_id AS VARCHAR) FROM levels WHERE game_id NOT IN (SELECT id FROM games)
  UNION ALL SELECT 'runs', id, 'missing game', CAST(game_id AS VARCHAR) FROM runs WHERE game_id NOT IN (SELECT id FROM games)
  UNION ALL SELECT 'runs', id, 'missing category', CAST(category_id AS VARCHAR) FROM runs WHERE category_id NOT IN (SELECT id FROM categories)
  UNION ALL SELECT 'runs', id, 'missing level', CAST(level_id AS VARCHAR) FROM runs WHERE level_id IS NOT NULL AND level_id NOT IN (SELECT id FROM levels)
  UNION ALL SELECT 'runs', id, 'missing user', CAST(user_id AS VARCHAR) FROM runs WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users)
  UNION ALL SELECT 'runs', t.id, 'no primary time', g.primary_timing FROM timed t JOIN games g ON t.game_id = g.id WHERE ms IS NULL
  UNION ALL SELECT tbl, id, 'slug is not unique', key FROM dup WHERE n > 1)
"""


@query(f', {_KEYS}, {_ERRORS} SELECT "table", row_id, rule, detail FROM found')
def integrity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.errors(tables(spark, sf_dir))


@query(f', {_KEYS} SELECT tbl AS "table", id FROM dup WHERE nth > 1')
def duplicate_slug_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that give way to another of their slug."""
    t = tables(spark, sf_dir)
    parts = [integrity.duplicates(t, c, losers_only=True).select(F.lit(c).alias("table"), "id") for c in ("users", "games", "categories", "levels")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_TABLES = ("users", "games", "categories", "levels", "runs")
_SIZES = "sizes AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in _TABLES) + ")"


@query(f', {_KEYS}, {_ERRORS}, {_SIZES}, bad AS (SELECT "table", count(DISTINCT row_id) AS invalid FROM found GROUP BY 1) SELECT "table", invalid, CAST(invalid * 100 // greatest(n, 1) AS BIGINT) AS percent FROM bad JOIN sizes ON tbl = "table"')
def invalid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid rows of each table, and how many in a hundred they are."""
    t = tables(spark, sf_dir)
    bad = integrity.errors(t).select("table", "row_id").distinct().groupBy("table").agg(F.count(F.lit(1)).alias("invalid"))
    sizes = None
    for name in _TABLES:
        one = t[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        sizes = one if sizes is None else sizes.union(one)
    return bad.join(sizes, "table").select("table", "invalid", F.floor(F.col("invalid") * 100 / F.greatest("n", F.lit(1))).cast("long").alias("percent"))


def _cleaning_round(k: int) -> str:
    """The five tables after round k of cleaning, from those after the round before."""
    keys, old = _KEYS, k - 1
    for t in ("users", "games", "categories", "levels"):
        keys = keys.replace(f"FROM {t} ", f"FROM {t}{old} ").replace(f"FROM {t}\n", f"FROM {t}{old}\n").replace(f"JOIN {t} ", f"JOIN {t}{old} ")
    keys = keys.replace("keyed", f"keyed{k}").replace("dup AS", f"dup{k} AS").replace("AS (", "AS MATERIALIZED (")
    stays = lambda t: f"id NOT IN (SELECT id FROM dup{k} WHERE tbl = '{t}' AND nth > 1)"
    of = lambda t: f"{t}{k} AS MATERIALIZED (SELECT * FROM {t}{old} WHERE {stays(t)}"
    time = "CASE g.primary_timing WHEN 'IGT' THEN igt WHEN 'RTA' THEN rta ELSE rta_nl END IS NOT NULL"
    return (
        f"{keys}, {of('users')} AND name <> '' AND slug <> ''), {of('games')}), {of('categories')} AND game_id IN (SELECT id FROM games{old})), {of('levels')} AND game_id IN (SELECT id FROM games{old})), "
        f"runs{k} AS MATERIALIZED (SELECT r.* FROM runs{old} r JOIN games{old} g ON r.game_id = g.id WHERE category_id IN (SELECT id FROM categories{old}) AND (level_id IS NULL OR level_id IN (SELECT id FROM levels{old})) "
        f"AND (user_id IS NULL OR user_id IN (SELECT id FROM users{old})) AND {time})"
    )


#: Rounds that the SQL unrolls; the tables are clean before, and further rounds change nothing.
_ROUNDS = 6
_START = ", ".join(f"{t}0 AS MATERIALIZED (SELECT * FROM {t})" for t in _TABLES)
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{what}' AS state, count(*) AS n FROM {t}{k}" for t in _TABLES for what, k in (("raw", 0), ("clean", _ROUNDS)))


@query(f", {_START}, {', '.join(map(_cleaning_round, range(1, _ROUNDS + 1)))} {_COUNTS}")
def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the five tables before and after cleaning to a fixpoint."""
    t = tables(spark, sf_dir)
    done, _ = integrity.clean(t)
    count = lambda df, name, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(what).alias("state"), "n")
    parts = [count(df, name, what) for what, side in (("raw", t), ("clean", done)) for name, df in sorted(side.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# --- lookups and projections --------------------------------------------------------------------------------


@query("SELECT id, name, primary_timing FROM games WHERE slug = 'NATION_7'")
def game_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["games"].where("slug = 'NATION_7'").select("id", "name", "primary_timing")


@query("SELECT id, slug, name FROM games")
def game_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["games"].select("id", "slug", "name")


@query("SELECT id, game_id FROM runs WHERE id = 45 UNION ALL SELECT id, game_id FROM runs WHERE FALSE")
def run_by_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of the base-36 id 00000019, and of a malformed id, which is none."""
    wanted = spark.range(1).select(F.explode(F.array(F.lit("00000019"), F.lit("no id"))).alias("text"))
    ids = wanted.select(codecs.base36_decode(F.col("text"))["value"].alias("id"))
    return tables(spark, sf_dir)["runs"].join(F.broadcast(ids), "id").select("id", "game_id")


@query(
    "SELECT 'game' AS kind, id, name FROM games WHERE id = 3 UNION ALL SELECT 'user', id, name FROM users WHERE id = 7 UNION ALL SELECT 'level', id, name FROM levels WHERE id = 32 "
    "UNION ALL SELECT 'category', id, name FROM categories WHERE id = 31 UNION ALL SELECT 'run', id, NULL FROM runs WHERE id = 45"
)
def node_by_global_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of any kind by their tagged global ids."""
    t = tables(spark, sf_dir)
    wanted = spark.range(1).select(F.explode(F.array(*[codecs.global_id(k, F.lit(n)) for k, n in (("game", 3), ("user", 7), ("level", 32), ("category", 31), ("run", 45))])).alias("node"))
    keys = wanted.select(codecs.parse_global_id(F.col("node")).alias("n")).select("n.*")
    kinds = {"game": "games", "user": "users", "level": "levels", "category": "categories", "run": "runs"}
    every = None
    for kind, name in kinds.items():
        shown = F.lit(None).cast("string").alias("name") if kind == "run" else F.col("name")
        part = t[name].select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), shown)
        every = part if every is None else every.unionByName(part)
    return every.join(F.broadcast(keys), ["kind", "id"])


_ID36 = (
    "lpad(lower(concat_ws('', " + ", ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(id // {36**k} % 36 AS INTEGER) + 1, 1)" for k in range(7, -1, -1)) + ")), 8, '0')"
)


@query(f"SELECT id, {_ID36} AS src_id FROM users")
def user_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)["users"].select("id", codecs.base36_encode(F.col("id")).alias("src_id"))


@query("SELECT r.id, 'https://www.youtube.com/watch?v=v' || r.id || CASE WHEN r.id % 2 = 0 THEN '&t=' || (r.id % 100) ELSE '' END AS url FROM runs r")
def video_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = tables(spark, sf_dir)["runs"]
    return runs.select("id", F.explode(F.transform("videos", text.video_url)).alias("url"))


@query(
    "SELECT slug, name FROM games WHERE lower(name) LIKE '%nation_1%' ORDER BY lower(slug) <> 'nation_1', NOT starts_with(lower(slug), 'nation_1'), length(slug), length(name), slug LIMIT 16"
)
def game_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 best matches of a name: equal, then with that beginning, then short."""
    low = F.lower("slug")
    hits = tables(spark, sf_dir)["games"].where(F.lower("name").contains("nation_1"))
    return hits.orderBy(low != "nation_1", ~low.startswith("nation_1"), F.length("slug"), F.length("name"), "slug").select("slug", "name").limit(16)


_NAMED = "SELECT id FROM games WHERE slug IN ('NATION_1', 'NATION_2')"


@query(f"SELECT 'run' AS kind, id FROM runs WHERE game_id IN ({_NAMED}) UNION ALL SELECT DISTINCT 'user', u.id FROM users u JOIN runs r ON r.user_id = u.id WHERE r.game_id IN ({_NAMED})")
def fixture_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a few named games, and the users that they name."""
    t = tables(spark, sf_dir)
    games = t["games"].where(F.col("slug").isin("NATION_1", "NATION_2")).select(F.col("id").alias("game_id"))
    runs = t["runs"].join(games, "game_id", "left_semi")
    named = runs.select(F.explode("players").alias("p")).select(F.col("p.user_id").alias("id"))
    users = t["users"].join(named, "id", "left_semi")
    return runs.select(F.lit("run").alias("kind"), "id").unionByName(users.select(F.lit("user").alias("kind"), "id"))


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'supplemental' ELSE 'main' END AS origin FROM runs WHERE id % 2 = 0")
def runs_with_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two run tables in one; a run in both comes from the second."""
    runs = tables(spark, sf_dir)["runs"].select("id")
    main = runs.where("id % 2 = 0").select("id", F.lit("main").alias("origin"), F.lit(0).alias("priority"))
    more = runs.where("id % 10 = 0").select("id", F.lit("supplemental").alias("origin"), F.lit(1).alias("priority"))
    return main.unionByName(more).groupBy("id").agg(F.max_by("origin", "priority").alias("origin"))




@query(
    f", {_FIRST}, ranked AS (SELECT *, {_RANKED} FROM first_runs), {_RECORDS}, news AS (SELECT {_BOARD}, count(*) AS records, max(progress_ms) AS largest FROM records GROUP BY ALL) "
    "SELECT g.slug AS game, c.slug AS category, c.id AS category_id, l.slug AS level, r.id AS run_id, r.ms AS best_ms, n.records, n.largest FROM ranked r JOIN games g ON g.id = r.game_id "
    "JOIN categories c ON c.id = r.category_id LEFT JOIN levels l ON l.id = r.level_id JOIN news n ON n.game_id = r.game_id AND n.category_id = r.category_id AND n.level_id IS NOT DISTINCT FROM r.level_id WHERE r.rank = 1"
)
def game_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every board at once: its game, category and level, the best run, and how its record moved."""
    t, runs = tables(spark, sf_dir), timed_runs(spark, sf_dir)
    best = ranking.leaderboard(runs, limit=1).select("game_id", "category_id", "level_id", F.col("id").alias("run_id"), F.col("ms").alias("best_ms"))
    news = ranking.progression(runs).groupBy("game_id", "category_id", "level_id").agg(F.count(F.lit(1)).alias("records"), F.max("progress_ms").alias("largest"))
    same = (F.col("b.game_id") == F.col("n.game_id")) & (F.col("b.category_id") == F.col("n.category_id")) & F.col("b.level_id").eqNullSafe(F.col("n.level_id"))
    joined = best.alias("b").join(news.alias("n"), same).select("b.*", "n.records", "n.largest")
    named = joined.join(t["games"].select(F.col("id").alias("game_id"), F.col("slug").alias("game")), "game_id")
    named = named.join(t["categories"].select(F.col("id").alias("category_id"), F.col("slug").alias("category")), "category_id")
    named = named.join(t["levels"].select(F.col("id").alias("level_id"), F.col("slug").alias("level")), "level_id", "left")
    return named.select("game", "category", "category_id", "level", "run_id", "best_ms", "records", "largest")
