"""Requirement hierarchies: dotted ids, inherited types, and satisfaction rolled up from below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.lineage import cut

#: Types that a requirement needs unless it or an ancestor says otherwise.
DEFAULT_TYPES = ["impl", "test"]


def depth(identifier: Column) -> Column:
    return F.size(F.split(identifier, r"\.")) - 1


def parent_id(identifier: Column) -> Column:
    """The id without its last segment; null at the top."""
    return F.nullif(F.regexp_replace(identifier, r"(^|\.)[^.]*$", ""), F.lit(""))


def ancestors(identifier: Column) -> Column:
    """The id itself and every prefix of whole segments."""
    parts = F.split(identifier, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def definitions(annotations: DataFrame) -> DataFrame:
    """One definition for each id: of the smallest file, then line and column."""
    first = Window.partitionBy("id").orderBy("file", "line", "col")
    return annotations.where("kind = 'def'").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def duplicate_definitions(annotations: DataFrame) -> DataFrame:
    """Definitions that another one of their id precedes."""
    first = Window.partitionBy("id").orderBy("file", "line", "col")
    return annotations.where("kind = 'def'").withColumn("__n", F.row_number().over(first)).where("__n > 1").drop("__n")


def requirements(annotations: DataFrame, default_types: list[str] = DEFAULT_TYPES) -> DataFrame:
    """(id, parent, depth, implicit, mode, required, present) of every defined id and all its ancestors.

    Types are inherited from the parent, then a definition's own are added and removed (a type `def` is never
    required). One round for each level of the deepest id. `present` lists the types annotated directly.
    """
    defs = definitions(annotations)
    ids = defs.select(F.explode(ancestors(F.col("id"))).alias("id")).distinct()
    own = defs.select("id", F.lit(False).alias("__defined"), "mode", "add_types", "remove_types")
    empty = F.array().cast("array<string>")
    nodes = cut(
        ids.join(own, "id", "left").select(
            "id", parent_id(F.col("id")).alias("parent"), depth(F.col("id")).alias("depth"), F.coalesce("__defined", F.lit(True)).alias("implicit"),
            F.coalesce("mode", F.lit("either")).alias("mode"), F.array_remove(F.coalesce("add_types", empty), "def").alias("add"), F.coalesce("remove_types", empty).alias("remove"),
        )
    )
    deepest = nodes.agg(F.max("depth")).first()[0]
    start = F.array(*[F.lit(t) for t in default_types]).cast("array<string>")
    types = lambda base: F.array_sort(F.array_except(F.array_union(base, F.col("add")), F.col("remove")))
    done = level = cut(nodes.where("depth = 0").withColumn("required", types(start)))
    for k in range(1, (deepest or 0) + 1):
        above = level.select(F.col("id").alias("parent"), F.col("required").alias("__up"))
        level = cut(nodes.where(F.col("depth") == k).join(above, "parent").withColumn("required", types(F.col("__up"))).select(*done.columns))
        done = done.unionByName(level)
    have = annotations.where("kind <> 'def'").groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("present"))
    return done.drop("add", "remove").join(have, "id", "left").withColumn("present", F.coalesce("present", empty))


def satisfaction(tree: DataFrame) -> DataFrame:
    """tree with satisfied, complete, missing and satisfied_types, from the deepest level up.

    `self`: every required type is annotated. `children`: there are children, and for each required type
    some child requires it and all that do are satisfied. `either`: one of both. Complete: satisfied, and so
    is everything below.
    """
    tree = tree.withColumn("missing", F.array_except("required", "present")).withColumn("satisfied_types", F.array_intersect("required", "present"))
    deepest = tree.agg(F.max("depth")).first()[0]
    done, below = None, None
    for k in range(deepest if deepest is not None else 0, -1, -1):
        level = tree.where(F.col("depth") == k)
        if below is None:
            level = level.withColumn("__by_children", F.lit(False)).withColumn("__all_complete", F.lit(True))
        else:
            by_type = below.select("parent", F.explode("required").alias("type"), "satisfied").groupBy("parent", "type").agg(F.bool_and("satisfied").alias("good"))
            good = by_type.where("good").groupBy("parent").agg(F.collect_set("type").alias("__good"))
            some = below.groupBy("parent").agg(F.bool_and("complete").alias("__complete"))
            children = some.join(good, "parent", "left").withColumnRenamed("parent", "id")
            level = level.join(children, "id", "left")
            covered = F.size(F.array_except("required", F.coalesce("__good", F.array().cast("array<string>")))) == 0
            level = level.withColumn("__by_children", F.col("__complete").isNotNull() & covered).withColumn("__all_complete", F.coalesce("__complete", F.lit(True)))
            level = level.drop("__good", "__complete")
        own = F.size("missing") == 0
        satisfied = F.when(F.col("mode") == "self", own).when(F.col("mode") == "children", F.col("__by_children")).otherwise(own | F.col("__by_children"))
        level = level.withColumn("satisfied", satisfied).withColumn("complete", F.col("satisfied") & F.col("__all_complete")).drop("__by_children", "__all_complete")
        below = cut(level)
        done = below if done is None else done.unionByName(below)
    return done


def listing(status: DataFrame, prefixes: list[str] | None = None, every: bool = False, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Lines of an indented report in depth-first order: incomplete requirements, or every one."""
    shown = status if every else status.where(~F.col("complete"))
    if prefixes:
        within = F.lit(False)
        for p in prefixes:
            within = within | (F.col("id") == p) | F.col("id").startswith(p + ".")
        shown = shown.where(within)
    mark = F.when(F.col("complete"), "complete").when(F.col("satisfied"), "satisfied").otherwise(F.concat(F.lit("missing "), F.array_join("missing", ", ")))
    shown = shown.select("id", F.concat(F.expr("repeat('  ', depth)"), "id", F.lit(": "), mark).alias("line")).orderBy(F.split("id", r"\."))
    shown = shown.offset(skip) if skip else shown
    return shown if limit is None else shown.limit(limit)


def totals(status: DataFrame) -> DataFrame:
    return status.agg(F.count(F.lit(1)).alias("total"), F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("unsatisfied"))
