"""Sinks: sorted JSON lines with an atomic swap, ordered text, corpora, YAML documents, versioned copies."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import codecs, text


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished folder in another's place.

    A folder cannot be renamed over another, so between two renames there is neither; a swap that ended there
    leaves the old folder as `<path>.old`, which current() reads and the next swap keeps until it is done.
    """
    jvm = spark.sparkContext._jvm
    new_path, old_path = jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(path)
    fs = old_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".old")
    if fs.exists(old_path):
        fs.delete(gone, True)
        fs.rename(old_path, gone)
    if not fs.rename(new_path, old_path):
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(gone, True)


def current(spark: SparkSession, path: str) -> str:
    """The folder to read a swapped table from: itself, or the old one where a swap was cut short."""
    jvm = spark.sparkContext._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    old = path.rstrip("/") + ".old"
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return old if not fs.exists(here) and fs.exists(jvm.org.apache.hadoop.fs.Path(old)) else path


def json_lines(df: DataFrame, path: str, key: str = "id", compression: str = "gzip") -> None:
    """JSON lines in order of a key, over as many files as the data need; their names keep the order."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", compression).json(path.rstrip("/") + ".new")
    _swap(df.sparkSession, path.rstrip("/") + ".new", path)


def table_dump(df: DataFrame, path: str) -> None:
    """Plain JSON lines ordered by all columns in their order."""
    ordered = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    df.repartitionByRange(*ordered).sortWithinPartitions(*ordered).write.mode("overwrite").json(path.rstrip("/") + ".new")
    _swap(df.sparkSession, path.rstrip("/") + ".new", path)


def backup(spark: SparkSession, path: str, stamp: str) -> str:
    """A copy of a folder's files under its name and a time stamp; returns its path."""
    jvm, target = spark.sparkContext._jvm, f"{path.rstrip('/')}.{stamp}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"cannot copy {path} to {target}")
    return target


def ordered_text(items: DataFrame, path: str) -> None:
    """Each stream's items in order, byte for byte, in a file `<path>/<stream_id>` of its own.

    Streams are written in parallel, one by a task, an item at a time; a task that runs again writes its files
    anew. `path` is a folder that all executors reach as a file system.
    """
    import os

    data = F.coalesce("bytes", F.encode("text", "UTF-8"))
    rows = items.where("err is null and kind <> 'value'").select("stream_id", "seq", data.alias("data"))

    def run(batches):
        import uuid

        import pyarrow as pa

        at, out, part = None, None, None

        def close():
            if out:
                out.close()
                os.replace(part, os.path.join(path, str(at)))

        for b in batches:
            for stream, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if stream != at or out is None:
                    close()
                    at, part = stream, os.path.join(path, f".{stream}-{uuid.uuid4().hex}")
                    out = open(part, "wb")
                out.write(piece or b"")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["stream_id"])

    os.makedirs(path, exist_ok=True)
    rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, "stream_id long").write.format("noop").mode("overwrite").save()


def to_driver(items: DataFrame) -> Iterator[bytes]:
    """Items' bytes in order, a partition at a time; a value item or an error raises ValueError."""
    for row in items.orderBy("stream_id", "seq").toLocalIterator():
        if row.err is not None or row.kind == "value":
            raise ValueError(row.err or "a value has no bytes")
        yield row.text.encode() if row.kind == "text" else bytes(row.bytes)


def corpus_lines(entries: DataFrame) -> DataFrame:
    """(value): `type:escaped bytes` for each entry (type, data)."""
    return entries.select(F.concat_ws(":", "type", codecs.escaped(F.col("data"))).alias("value"))


def yaml_documents(df: DataFrame) -> DataFrame:
    """(value): each row as a YAML document of its columns, strings quoted where they need it."""
    lines = []
    for name, kind in df.dtypes:
        scalar = text.yaml_scalar(F.col(name)) if kind == "string" else F.coalesce(F.col(name).cast("string"), F.lit("null"))
        lines.append(F.concat(F.lit(f"{name}: "), scalar))
    return df.select(F.concat(F.lit("---\n"), F.concat_ws("\n", *lines)).alias("value"))


def graph_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON, as a query's answer."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def snapshot(commits: DataFrame, edges: DataFrame, trees: DataFrame) -> list[dict]:
    """A graph as the document that readers.snapshot reads: parents first, trees as changes to the first parent's.

    A document is one file, so the graph comes to the driver; cut it with graph.prune before.
    """
    from larkspur.operators.graph import generation_index

    nodes = commits.select(F.col("id").alias("node"))
    order = generation_index(nodes, edges).withColumnRenamed("node", "id")
    parents: dict[str, list[str]] = {}
    for e in edges.orderBy("child", "ordinal").collect():
        parents.setdefault(e.child, []).append(e.parent)
    content: dict[str, dict[str, str]] = {}
    for t in trees.collect():
        content.setdefault(t.commit, {})[t.path] = t.content
    out: list[dict] = []
    for c in commits.join(order, "id").orderBy("generation", "seconds", "id").collect():
        above, own = parents.get(c.id, []), content.get(c.id, {})
        before = content.get(above[0], {}) if above else {}
        change = {p: own.get(p) for p in sorted(before.keys() | own.keys()) if own.get(p) != before.get(p)}
        made = {"id": c.id, "message": c.message, "author": c.author, "seconds": c.seconds, "tree": change}
        if above != [d["id"] for d in out[-1:]]:
            made["parents"] = above
        out.append(made)
    return out
