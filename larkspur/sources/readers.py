"""Sources: typed JSON lines, whole and chunked files, record logs, repository scans, corpora, lockfiles, crawls."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.streams import ITEM

CHUNK = 65536


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Typed JSON lines, plain or compressed; a missing path is an empty table.

    Lines that do not parse have their text in `_corrupt_record`, or fail the job if strict. A gzip file
    cannot be split, so it is dealt out again after reading.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not _exists(spark, path):
        return spark.createDataFrame([], fields)
    whole = fields if strict else T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(whole).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(field, lines) of top-level fields that the schema does not name."""
    known = T.StructType.fromDDL(schema).fieldNames()
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.where(~F.col("field").isin(known)).groupBy("field").agg(F.count(F.lit(1)).alias("lines"))


def latest(crawls: list[DataFrame], key: str = "id") -> DataFrame:
    """Records of several crawls by key; the last crawl that has one wins."""
    marked = [df.withColumn("__n", F.lit(n)) for n, df in enumerate(crawls)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    rest = [c for c in every.columns if c not in (key, "__n")]
    best = every.groupBy(key).agg(F.max_by(F.struct(*rest), "__n").alias("r"))
    return best.select(key, "r.*")


def tables(spark: SparkSession, folder: str, schemas: dict[str, str], supplement: str | None = None) -> dict[str, DataFrame]:
    """`<folder>/<name>.jsonl` for each schema; runs also take the supplemental file, whose rows win."""
    out = {name: json_lines(spark, f"{folder}/{name}.jsonl", s).drop("_corrupt_record") for name, s in schemas.items()}
    if supplement:
        out["runs"] = latest([out["runs"], json_lines(spark, supplement, schemas["runs"]).drop("_corrupt_record")])
    return out


def text_source(spark: SparkSession, texts: list[str]) -> DataFrame:
    """One stream of text items."""
    return spark.createDataFrame([(0, i, "text", t, None, None) for i, t in enumerate(texts)], ITEM)


def bytes_source(spark: SparkSession, parts: list[bytes]) -> DataFrame:
    return spark.createDataFrame([(0, i, "bytes", None, b, None) for i, b in enumerate(parts)], ITEM)


def file_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """Files as streams of byte chunks, one stream for each file by path; a missing path is one error item."""
    if not _exists(spark, path):
        return spark.createDataFrame([(0, 0, "bytes", None, None, f"cannot read {path}")], ITEM)
    files = spark.read.format("binaryFile").load(path)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / size).cast("int") - 1, F.lit(0)))
    each = files.select(F.abs(F.xxhash64("path")).alias("stream_id"), "content", F.explode(parts).alias("k"))
    none = F.lit(None).cast("string")
    return each.select("stream_id", F.col("k").cast("long").alias("seq"), F.lit("bytes").alias("kind"), none.alias("text"), F.substring("content", F.col("k") * size + 1, F.lit(size)).alias("bytes"), none.alias("err"))


def stdin_chunks(spark: SparkSession, stream, size: int = CHUNK) -> DataFrame:
    """A driver's binary stream, such as sys.stdin.buffer, as one stream of chunks; it is read on the driver."""
    return bytes_source(spark, list(iter(lambda: stream.read(size), b"")))


def repository_files(spark: SparkSession, root: str, pattern: str = r"\.md$|/src/") -> DataFrame:
    """(path, content) of UTF-8 files whose path below root matches, without hidden and build folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    inside = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\."), "")
    kept = inside.rlike(pattern) & ~inside.rlike(r"/(\.[^/]+|target|node_modules|__pycache__)/")
    return files.where(kept).select(inside.alias("path"), text.alias("content")).where("content is not null")


def records(spark: SparkSession, path: str, fields: list[str], record: str = "\x1e", field: str = "\x00") -> DataFrame:
    """A log of records that a byte ends, of fields that a byte parts."""
    rows = spark.read.text(path, lineSep=record).where("value <> ''")
    parts = F.split("value", field)
    return rows.select(*[F.get(parts, F.lit(k)).alias(name) for k, name in enumerate(fields)])


def trailers(commits: DataFrame, prefix: str, path: str | None = None) -> DataFrame:
    """(depth, value): the first line with a prefix in each message, nearest commit first. commits: (depth, message[, paths]).

    With a path, only of commits whose paths hold exactly that one.
    """
    if path is not None:
        commits = commits.where(F.array_contains("paths", path))
    line = F.get(F.filter(F.split("message", "\n"), lambda x: F.startswith(x, F.lit(prefix))), F.lit(0))
    found = commits.select("depth", line.alias("line")).where("line is not null")
    return found.select("depth", F.trim(F.substring("line", len(prefix) + 1, 1 << 30)).alias("value"))


def deleted_blobs(history: DataFrame, head: DataFrame) -> DataFrame:
    """(blob): what a history has held and its head no longer does."""
    return history.select("blob").distinct().join(head.select("blob"), "blob", "left_anti")


def index_where(df: DataFrame, key, condition) -> DataFrame:
    """(key, ids): the rows that meet a condition, by a new key; a row without the key is in no entry. df has id."""
    return df.where(condition).where(key.isNotNull()).groupBy(key.alias("key")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(type, data) of lines `type:escaped bytes`; comments and blank lines do not count."""
    from larkspur.functions.codecs import parse_escaped

    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    parts = rows.select(F.regexp_extract("value", "^([A-Za-z0-9_]+):", 1).alias("type"), F.regexp_replace("value", "^[A-Za-z0-9_]+:", "").alias("body"))
    return parts.select("type", parse_escaped(F.col("body")).alias("data"))


def packed_corpus(entries: DataFrame, most: int = 1024) -> DataFrame:
    """Distinct entries, at most so many, the first by the SHA-1 of their data."""
    return entries.distinct().orderBy(F.sha1("data"), "type").limit(most)


def archived(original: DataFrame, now: DataFrame) -> DataFrame:
    """Entries of an earlier corpus that are gone."""
    return original.select("type", "data").distinct().join(now.select("type", "data"), ["type", "data"], "left_anti")


def lockfile(spark: SparkSession, text: str) -> DataFrame:
    """(name, dependencies) of a TOML lockfile's packages."""
    packages = tomllib.loads(text).get("package", [])
    rows = [(p["name"], [d.split(" ")[0] for d in p.get("dependencies", [])]) for p in packages]
    return spark.createDataFrame(rows, "name string, dependencies array<string>")


def snapshot(spark: SparkSession, commits: list[dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commits, edges, tree entries) of a parsed snapshot document: a list of commits.

    A commit without `parents` follows the one before it; a tree is a map of paths, laid over the first
    parent's. Unknown parents and cycles are errors.
    """
    nodes, edges, trees, seen = [], [], {}, []
    for c in commits:
        parents = c.get("parents", seen[-1:])
        missing = [p for p in parents if p not in trees]
        if missing:
            raise ValueError(f"commit {c['id']} has parents that do not come before it: {missing}")
        if c["id"] in trees:
            raise ValueError(f"commit {c['id']} is there twice")
        tree = dict(trees[parents[0]]) if parents else {}
        for path, content in c.get("tree", {}).items():
            if content is None:
                tree.pop(path, None)
            else:
                tree[path] = content
        trees[c["id"]] = tree
        seen.append(c["id"])
        nodes.append((c["id"], c.get("message", ""), c.get("author", ""), c.get("seconds", 0)))
        edges += [(c["id"], p, k) for k, p in enumerate(parents)]
    entries = [(i, p, t) for i, tree in trees.items() for p, t in sorted(tree.items())]
    return (
        spark.createDataFrame(nodes, "id string, message string, author string, seconds long"),
        spark.createDataFrame(edges, "child string, parent string, ordinal int"),
        spark.createDataFrame(entries, "commit string, path string, content string"),
    )


def deletions_ends(deleted: DataFrame) -> DataFrame:
    """The oldest and the newest deletion of each (blob, path); deleted: (blob, path, seconds, commit)."""
    row = F.struct("seconds", "commit")
    ends = deleted.groupBy("blob", "path").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    each = ends.select("blob", "path", F.explode(F.array_distinct(F.array("a", "b"))).alias("e"))
    return each.select("blob", "path", "e.seconds", "e.commit")


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows in a random order that a seed fixes."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def first_parent_depths(edges: DataFrame, head: str) -> DataFrame:
    """(node, depth) along the first-parent chain from a head."""
    from larkspur.operators.graph import reachable

    spark = edges.sparkSession
    found = reachable(edges.where("ordinal = 0"), spark.createDataFrame([(head,)], "node string"))
    return found.select("node", "depth").orderBy("depth")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Rows with seq from 0 in an order, counted in ranges so that no task holds all rows."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    from larkspur.operators.lineage import cut

    spread = cut(spread)
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    here = Window.partitionBy("__part").orderBy(*order)
    return spread.join(F.broadcast(starts), "__part").withColumn("seq", F.col("__start") + F.row_number().over(here) - 1).drop("__part", "__start")
