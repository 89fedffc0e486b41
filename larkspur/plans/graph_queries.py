"""Queries over a graph and a requirement tree derived from the customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph, hierarchy
from larkspur.plans.fixture import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Customer n's first parent is n div 2, and every fifth also has n div 3; customer 0 is the root.
SQL = """WITH RECURSIVE edges AS (
  SELECT c_custkey AS child, c_custkey // 2 AS parent, 0 AS ordinal FROM customer WHERE c_custkey > 0
  UNION ALL SELECT c_custkey, c_custkey // 3, 1 FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0 AND c_custkey // 3 <> c_custkey // 2),
walk(start, node) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT w.start, e.parent FROM walk w JOIN edges e ON e.child = w.node),
chain(start, node, n) AS (SELECT c_custkey, c_custkey, 1 FROM customer UNION ALL SELECT c.start, e.parent, n + 1 FROM chain c JOIN edges e ON e.child = c.node AND ordinal = 0),
path(start, node, n) AS (SELECT c_custkey, c_custkey, 1 FROM customer UNION SELECT p.start, e.parent, n + 1 FROM path p JOIN edges e ON e.child = p.node)
"""


def query(sql: str | None = None, front: str = SQL):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = front + sql
        return f

    return put


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey").where("c_custkey > 0")
    first = c.selectExpr("c_custkey AS child", "c_custkey div 2 AS parent", "0 AS ordinal")
    second = c.where("c_custkey % 5 = 0 and c_custkey div 3 <> c_custkey div 2").selectExpr("c_custkey AS child", "c_custkey div 3 AS parent", "1 AS ordinal")
    return first.union(second)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))


@query("SELECT start, node FROM walk")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(edges(spark, sf_dir), nodes(spark, sf_dir)).select("start", "node")


@query("SELECT start AS node, count(*) AS commits FROM walk GROUP BY 1")
def commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.commit_index(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("SELECT start AS node, CAST(max(n) AS BIGINT) AS revision FROM chain GROUP BY 1")
def revision_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.revision_index(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("SELECT start AS node, CAST(max(n) AS BIGINT) AS generation FROM path GROUP BY 1")
def generation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.generation_index(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("SELECT DISTINCT node FROM walk WHERE start IN (SELECT s_suppkey * 7 FROM supplier)")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a ref reaches; suppliers name refs."""
    refs = read(spark, sf_dir, "supplier").select("s_name", (F.col("s_suppkey") * 7).alias("target")).join(nodes(spark, sf_dir).withColumnRenamed("node", "target"), "target", "left_semi")
    return graph.prune(nodes(spark, sf_dir), edges(spark, sf_dir), refs.select(F.col("s_name").alias("name"), "target"))


@query("SELECT start AS node, CAST(max(n) AS BIGINT) AS generation FROM path GROUP BY 1")
def topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological(nodes(spark, sf_dir), edges(spark, sf_dir), []).select("node", "generation")


@query("SELECT 'p' || start AS name, 'p' || node AS dependency FROM walk WHERE start <> node")
def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = edges(spark, sf_dir).select(F.concat(F.lit("p"), F.col("child").cast("string")).alias("name"), F.concat(F.lit("p"), F.col("parent").cast("string")).alias("d"))
    return graph.dependency_closure(named.groupBy("name").agg(F.collect_list("d").alias("dependencies")))


@query("SELECT e.child AS node, max(c.c_custkey * 31 % 1000) AS seconds FROM edges e JOIN customer c ON c.c_custkey = e.parent GROUP BY 1")
def latest_parent_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = nodes(spark, sf_dir).withColumn("seconds", F.col("node") * 31 % 1000)
    return graph.latest_parent_time(edges(spark, sf_dir), times)


_TREE = "WITH old AS (SELECT 'd' || (p_partkey % 7) || '/f' || p_partkey AS path, p_name AS content FROM part WHERE p_partkey % 11 <> 0), new AS (SELECT 'd' || (p_partkey % 7) || '/f' || p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS content FROM part WHERE p_partkey % 13 <> 0)"


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = read(spark, sf_dir, "part").withColumn("path", F.format_string("d%d/f%d", F.col("p_partkey") % 7, F.col("p_partkey")))
    old = p.where("p_partkey % 11 <> 0").select("path", F.col("p_name").alias("content"))
    return old, p.where("p_partkey % 13 <> 0").select("path", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("content"))


@query(" SELECT path, o.content AS before, n.content AS after FROM old o FULL JOIN new n USING (path) WHERE o.content IS DISTINCT FROM n.content", _TREE)
def tree_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_delta(*trees(spark, sf_dir))


@query(" SELECT path, content FROM new", _TREE)
def tree_delta_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    return graph.apply_delta(old, graph.tree_delta(old, new))


@query(" SELECT substr(path, 4) AS path, content FROM old WHERE path LIKE 'd3/%'", _TREE)
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subtree(trees(spark, sf_dir)[0], "d3")


@query(" SELECT path, content FROM old WHERE path NOT LIKE 'd3/%' UNION ALL SELECT 'd3/' || path, content FROM new WHERE path LIKE 'd4/%'", _TREE)
def subtree_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = trees(spark, sf_dir)
    return graph.replace_subtree(old, "d3", new.where(F.col("path").startswith("d4/")))


_PREFIX = "WITH ids AS (SELECT sha1(CAST(p_partkey AS VARCHAR)) AS id FROM part), t AS (SELECT n, (SELECT count(DISTINCT left(id, n)) = count(*) FROM ids) AS apart FROM (SELECT unnest(range(4, 41, 2)) AS n))"


@query(" SELECT CAST(least(40, min(n) + 2) AS BIGINT) AS digits FROM t WHERE apart", _PREFIX)
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that tell the parts' hashed ids apart."""
    n = graph.prefix_length(read(spark, sf_dir, "part").select(F.sha1(F.col("p_partkey").cast("string")).alias("id")))
    return spark.range(1).select(F.lit(n).cast("long").alias("digits"))


# --- requirements -----------------------------------------------------------------------------------------------


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and implementations of dotted ids, three levels deep, from the parts."""
    k = F.col("p_partkey")
    identifier = F.format_string("r%d.s%d.t%d", k % 5, F.floor(k / 5) % 7, F.floor(k / 35))
    defs = read(spark, sf_dir, "part").select(
        F.lit("def").alias("kind"), identifier.alias("id"), F.when(k % 9 == 0, F.array(F.lit("doc"))).otherwise(F.array().cast("array<string>")).alias("add_types"),
        F.when(k % 4 == 0, F.array(F.lit("test"))).otherwise(F.array().cast("array<string>")).alias("remove_types"), F.when(k % 6 == 0, "self").alias("mode"),
        F.concat(F.lit("f"), (k % 3).cast("string")).alias("file"), k.cast("int").alias("line"), F.lit(1).alias("col"),
    )
    none = F.array().cast("array<string>")
    impl = defs.select(F.explode(F.array(F.lit("impl"), F.lit("test"))).alias("kind"), "id", none.alias("add_types"), none.alias("remove_types"), F.lit(None).cast("string").alias("mode"), "file", "line", "col")
    return defs.unionByName(impl.where("line % 10 <> 3"))


_IDS = "WITH k AS (SELECT p_partkey AS k FROM part), d AS (SELECT 'r' || (k % 5) || '.s' || (k // 5 % 7) || '.t' || (k // 35) AS id, k FROM k), every AS (SELECT id FROM d UNION SELECT regexp_replace(id, '\\.[^.]*$', '') FROM d UNION SELECT split_part(id, '.', 1) FROM d)"


@query(" SELECT id, id NOT IN (SELECT id FROM d) AS implicit, CAST(len(string_split(id, '.')) - 1 AS INTEGER) AS depth FROM every", _IDS)
def requirement_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.requirements(annotations(spark, sf_dir)).select("id", "implicit", "depth")


_STATUS = (
    _IDS + ", leaf AS (SELECT id, regexp_replace(id, '\\.[^.]*$', '') AS up, list_sort(list_concat(list_filter(['impl', 'test'], lambda t: NOT (k % 4 = 0 AND t = 'test')), CASE WHEN k % 9 = 0 THEN ['doc'] ELSE [] END)) AS need, "
    "k % 10 <> 3 AND k % 9 <> 0 AS good FROM d), mid AS (SELECT up AS id, bool_or(list_contains(need, 'impl')) AND bool_or(list_contains(need, 'test')) AND bool_and(good) FILTER (list_contains(need, 'impl')) "
    "AND coalesce(bool_and(good) FILTER (list_contains(need, 'test')), TRUE) AS good, bool_and(good) AS below FROM leaf GROUP BY 1), top AS (SELECT split_part(id, '.', 1) AS id, bool_and(good) AS good, bool_and(good AND below) AS below FROM mid GROUP BY 1)"
)


@query(" SELECT id, good AS satisfied, good AS complete FROM leaf UNION ALL SELECT id, good, good AND below FROM mid UNION ALL SELECT id, good, good AND below FROM top", _STATUS)
def requirement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.satisfaction(hierarchy.requirements(annotations(spark, sf_dir))).select("id", "satisfied", "complete")


@query(", s AS (SELECT good FROM leaf UNION ALL SELECT good FROM mid UNION ALL SELECT good FROM top) SELECT count(*) AS total, count(*) FILTER (good) AS satisfied, count(*) FILTER (NOT good) AS unsatisfied FROM s", _STATUS)
def requirement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.totals(hierarchy.satisfaction(hierarchy.requirements(annotations(spark, sf_dir))))
