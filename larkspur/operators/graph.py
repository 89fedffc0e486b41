"""Commit-graph operators over edge tables (child, parent, ordinal), ordinal 0 being the first parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.lineage import cut


def reachable(edges: DataFrame, starts: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(start, node, depth): every node that a start reaches, itself at depth 0, at its least depth.

    Breadth first: each round joins only the newest nodes with the edges and drops what was seen.
    starts has a column `node`. With most_depth the walk stops there.
    """
    frontier = cut(starts.select(F.col("node").alias("start"), "node").distinct())
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = frontier.join(edges.select(F.col("child").alias("node"), "parent"), "node").select("start", F.col("parent").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))  # written rounds stay as they are
    return seen


def commit_index(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, commits): how many nodes each head reaches, itself included."""
    return reachable(edges, heads).groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("commits"))


def revision_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, revision): length of the first-parent chain to its end, plus one.

    Pointer doubling: a round doubles the length that each row spans, so rounds grow with the logarithm of
    the longest chain.
    """
    first = edges.where("ordinal = 0").select("child", "parent")
    hop = cut(nodes.select("node").join(first.withColumnRenamed("child", "node"), "node", "left").select("node", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("length")))
    while not hop.where("to is not null").isEmpty():
        ahead = hop.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("length").alias("more"))
        hop = cut(hop.join(ahead, "to", "left").select("node", F.col("next").alias("to"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
    return hop.select("node", (F.col("length") + 1).alias("revision"))


def generation_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, generation): length of the longest path to a root, plus one. The graph must have no cycle.

    Each round moves one edge away from the roots; a node's last round is its generation.
    """
    level = cut(nodes.select("node").join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti"))
    levels, depth, total = level.withColumn("generation", F.lit(1).cast("long")), 1, nodes.count()
    while True:
        level = cut(level.join(edges.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node")).distinct())
        if level.isEmpty():
            best = levels.groupBy("node").agg(F.max("generation").alias("generation"))  # written levels are read once
            if best.count() < total:
                raise ValueError("the graph has a cycle")
            return best
        depth += 1
        if depth > total:
            raise ValueError("the graph has a cycle")
        levels = levels.unionByName(level.withColumn("generation", F.lit(depth).cast("long")))


def origin(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, origin): four hex digits of the roots that a head reaches.

    One root gives the end of its id; several give the end of the SHA-1 of their ids in order. Ids are hex.
    """
    found = reachable(edges, heads)
    roots = found.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    listed = roots.groupBy("start").agg(F.sort_array(F.collect_list("node")).alias("roots"))
    one = F.lower(F.right(F.element_at("roots", 1), F.lit(4)))
    many = F.right(F.sha1(F.unhex(F.array_join("roots", ""))), F.lit(4))
    return listed.select(F.col("start").alias("node"), F.when(F.size("roots") == 1, one).otherwise(many).alias("origin"))


def prune(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes that some ref (name, target) reaches."""
    found = reachable(edges, refs.select(F.col("target").alias("node"))).select("node").distinct()
    return nodes.join(found, "node", "left_semi")


def topological(nodes: DataFrame, edges: DataFrame, keys: list[Column]) -> DataFrame:
    """nodes with generation, in an order that puts parents first: by generation, then keys, then node.

    A sort by (generation, keys) is a valid order and distributes. A depth-first order, which interleaves
    branches by their walk, needs one sequential pass; this operator does not promise that one.
    """
    ranked = nodes.join(generation_index(nodes, edges), "node")
    return ranked.orderBy("generation", *keys, "node")


def nearest_with_blob(edges: DataFrame, wanted: DataFrame, holders: DataFrame) -> DataFrame:
    """(node, blob, found, path): the nearest ancestor that holds a blob, and the path most like the wanted one.

    wanted: (node, blob, path); holders: (node, blob, path). At one depth the smaller node id wins; among its
    paths the longer shared end, then the smaller path.
    """
    from larkspur.functions.text import path_similarity

    up = reachable(edges, wanted.select("node").distinct()).where("depth > 0")
    have = holders.select(F.col("node").alias("found"), "blob", F.col("path").alias("at"))
    near = wanted.join(up.select(F.col("start").alias("node"), F.col("node").alias("found"), "depth"), "node").join(have, ["found", "blob"])
    best = F.struct("depth", "found", (-path_similarity(F.col("path"), F.col("at"))).alias("unlike"), "at")
    return near.groupBy("node", "blob", "path").agg(F.min(best).alias("b")).select("node", "blob", "path", F.col("b.found").alias("found"), F.col("b.at").alias("at"))


def latest_parent_time(edges: DataFrame, times: DataFrame) -> DataFrame:
    """(node, seconds): the latest time of each node's parents; times: (node, seconds)."""
    known = edges.select(F.col("child").alias("node"), "parent").join(times.select(F.col("node").alias("parent"), "seconds"), "parent")
    return known.groupBy("node").agg(F.max("seconds").alias("seconds"))


def tree_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, before, after) of paths whose content differs; null where there is none. Trees: (path, content)."""
    both = old.select("path", F.col("content").alias("before")).join(new.select("path", F.col("content").alias("after")), "path", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def apply_delta(tree: DataFrame, delta: DataFrame) -> DataFrame:
    """The tree with a delta's paths replaced, added or, where `after` is null, removed."""
    kept = tree.select("path", "content").join(delta.select("path"), "path", "left_anti")
    return kept.unionByName(delta.where("after is not null").select("path", F.col("after").alias("content")))


def subtree(tree: DataFrame, prefix: str) -> DataFrame:
    """Entries below a path, by their path within it; the empty prefix is the whole tree."""
    if not prefix:
        return tree
    inside = tree.where(F.col("path").startswith(prefix + "/"))
    return inside.withColumn("path", F.substring("path", len(prefix) + 2, 1 << 30))


def replace_subtree(tree: DataFrame, prefix: str, part: DataFrame) -> DataFrame:
    """The tree with everything below a path replaced by another tree."""
    outside = tree.where(~F.col("path").startswith(prefix + "/") & (F.col("path") != prefix)) if prefix else tree.limit(0)
    moved = part.withColumn("path", F.concat(F.lit(prefix + "/" if prefix else ""), "path"))
    return outside.unionByName(moved.select(*outside.columns))


def dependency_closure(packages: DataFrame) -> DataFrame:
    """(name, dependency): all direct and indirect dependencies of packages (name, dependencies array)."""
    edges = packages.select(F.col("name").alias("child"), F.explode("dependencies").alias("parent"))
    found = reachable(edges, packages.select(F.col("name").alias("node")))
    return found.where("depth > 0").select(F.col("start").alias("name"), F.col("node").alias("dependency"))


def prefix_length(ids: DataFrame) -> int:
    """Hex digits that tell ids apart: the least even number from 4 on, and 2 more, 40 at most; 4 for one id."""
    total, known = ids.select(F.count(F.lit(1)), F.count("id")).first()
    if total <= 1:
        return 4
    if known < total:
        return 40
    low, high = 4, 42  # apart at high, not below low; 42 stands for never
    while low < high:
        n = (low + high) // 4 * 2
        # dealt by prefix before they are counted, so that a task holds its share of the prefixes only
        prefixes = ids.select(F.left("id", F.lit(n)).alias("p")).repartition("p")
        if prefixes.groupBy("p").count().where("count > 1").isEmpty():
            high = n
        else:
            low = n + 2
    return min(40, high + 2)
