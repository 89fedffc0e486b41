import io
import json
import time

import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import byte_size
from larkspur.operators import graph, streams
from larkspur.sources import readers, writers
from larkspur.sources.paged import PagedSource
from larkspur.streaming import text as live


def test_json_lines_are_typed_and_tolerant(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\nnot json\n{"id": 2, "extra": true}\n')
    rows = readers.json_lines(spark, f"{tmp_path}/a.jsonl", "id long, name string").collect()
    assert sorted((r.id or 0, r.name, r._corrupt_record) for r in rows) == [(0, None, "not json"), (1, "x", None), (2, None, None)]
    assert readers.json_lines(spark, f"{tmp_path}/none.jsonl", "id long").count() == 0
    (tmp_path / "b.jsonl").write_text('{"id": 2, "extra": true}\n')
    assert [tuple(r) for r in readers.unknown_fields(spark, f"{tmp_path}/b.jsonl", "id long").collect()] == [("extra", 1)]


def test_sorted_dump_replaces_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/out"
    for rows in ([(3, "c"), (1, "a")], [(2, "b"), (1, "a")]):
        writers.json_lines(spark.createDataFrame(rows, "id long, v string"), path)
        back = [r.id for r in spark.read.json(path).collect()]
        assert sorted(back) == sorted(i for i, _ in rows)
    writers.table_dump(spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string"), path)
    assert sorted(tuple(r) for r in spark.read.json(path).collect()) == [(1, "a"), (2, "b")]
    assert spark.read.json(writers.backup(spark, path, "20240101")).count() == 2


def test_latest_crawl_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(tuple(r) for r in readers.latest([old, new]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_file_chunks(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(250)) * 2)
    rows = readers.file_chunks(spark, f"{tmp_path}/f.bin", 200).orderBy("seq").collect()
    assert [len(r.bytes) for r in rows] == [200, 200, 100] and b"".join(bytes(r.bytes) for r in rows) == bytes(range(250)) * 2
    assert readers.file_chunks(spark, f"{tmp_path}/none").collect()[0].err.startswith("cannot read")
    assert [bytes(r.bytes) for r in readers.stdin_chunks(spark, io.BytesIO(b"abcde"), 2).collect()] == [b"ab", b"cd", b"e"]
    assert b"".join(writers.to_driver(readers.text_source(spark, ["a", "é"]))) == "aé".encode()
    with pytest.raises(ValueError):
        list(writers.to_driver(readers.file_chunks(spark, f"{tmp_path}/none")))


def test_repository_scan_and_records(spark, tmp_path):
    for name, data in {"README.md": b"# hi", "src/a.rs": b"fn", "src/bad.rs": b"\xff\xfe", ".git/x.md": b"no", "notes.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert sorted(r.path for r in readers.repository_files(spark, str(tmp_path)).collect()) == ["/README.md", "/src/a.rs"]
    (tmp_path / "log").write_text("c1\0Fix\nPath: a\x1ec2\0Other\x1e")
    rows = readers.records(spark, f"{tmp_path}/log", ["id", "message"]).collect()
    assert [(r.id, r.message) for r in rows] == [("c1", "Fix\nPath: a"), ("c2", "Other")]
    commits = spark.createDataFrame([(0, "Fix\nPath: a"), (1, "x"), (2, "Path: b\nPath: c")], "depth int, message string")
    assert [tuple(r) for r in readers.trailers(commits, "Path:").orderBy("depth").collect()] == [(0, "a"), (2, "b")]


def test_corpora(spark, tmp_path):
    (tmp_path / "c").write_text("# comment\nu8:\\x00a\n\nu8:b\nu8:b\nstr:x:y\n")
    entries = readers.corpus(spark, f"{tmp_path}/c")
    got = sorted((r.type, bytes(r.data)) for r in readers.packed_corpus(entries).collect())
    assert got == [("str", b"x:y"), ("u8", b"\x00a"), ("u8", b"b")]
    assert readers.packed_corpus(entries, 2).count() == 2
    assert [r.type for r in readers.archived(entries, entries.where("type = 'u8'")).collect()] == ["str"]
    assert sorted(r.value for r in writers.corpus_lines(entries.distinct()).collect()) == ["str:x:y", "u8:\\x00a", "u8:b"]


def test_lockfile_closure(spark):
    lock = readers.lockfile(spark, '[[package]]\nname = "a"\ndependencies = ["b 1.0"]\n[[package]]\nname = "b"\ndependencies = ["c"]\n[[package]]\nname = "c"\n')
    assert sorted(tuple(r) for r in graph.dependency_closure(lock).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_snapshot(spark):
    commits, edges, trees = readers.snapshot(spark, [{"id": "a", "tree": {"x": "1"}}, {"id": "b", "tree": {"y": "2", "x": None}}, {"id": "c", "parents": ["a", "b"]}])
    assert sorted(tuple(r) for r in edges.collect()) == [("b", "a", 0), ("c", "a", 0), ("c", "b", 1)]
    assert sorted(tuple(r) for r in trees.collect()) == [("a", "x", "1"), ("b", "y", "2"), ("c", "x", "1")]
    assert commits.count() == 3
    assert [tuple(r) for r in readers.first_parent_depths(edges, "b").collect()] == [("b", 0), ("a", 1)]
    again = readers.snapshot(spark, writers.snapshot(commits, edges, trees))
    for old, new in zip((commits, edges, trees), again, strict=True):
        assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect()))
    with pytest.raises(ValueError):
        readers.snapshot(spark, [{"id": "a", "parents": ["z"]}])


def test_yaml_and_ends(spark):
    df = spark.createDataFrame([(1, "plain", "true"), (2, "a: b", None)], "n long, a string, b string")
    assert [r.value for r in writers.yaml_documents(df).collect()] == ['---\nn: 1\na: plain\nb: "true"', '---\nn: 2\na: "a: b"\nb: null']
    deleted = spark.createDataFrame([("b", "p", s, f"c{s}") for s in (3, 1, 2)], "blob string, path string, seconds long, commit string")
    assert sorted(r.commit for r in readers.deletions_ends(deleted).collect()) == ["c1", "c3"]
    assert [r.seq for r in readers.numbered(spark.range(50).withColumnRenamed("id", "k"), "k").orderBy("k").collect()] == list(range(50))
    assert readers.sample(spark.range(100), 7, 3).collect() == readers.sample(spark.range(100), 7, 3).collect()


def test_sizes_and_commands(spark):
    assert [byte_size(s) for s in ("80", "64K", "1MB", "2GiB", "1KK")] == [80, 65536, 1_000_000, 2 << 30, 1 << 20]
    with pytest.raises(ValueError):
        byte_size("K")
    items = readers.text_source(spark, ["one two\nthree", " four\nfive"])
    out = streams.pipeline(items, ["split-lines | find-t", "first-2"]).orderBy("seq").collect()
    assert [r.text for r in out] == ["one two\n", "three four\n"]
    whole = streams.pipeline(items, ["to-mixed85-lines"]).first().text
    assert whole.endswith("\n") and streams.commands(["to-mixed85-lines"]) == ["encode-mixed85", "split-80", "join-lines"]
    with pytest.raises(ValueError):
        streams.pipeline(items, ["no-such"])


def test_paged_source(spark, tmp_path):
    for p in range(3):
        (tmp_path / f"{p}.jsonl").write_text("".join(json.dumps({"id": p * 10 + k}) + "\n" for k in range(2)))
    spark.dataSource.register(PagedSource)
    batch = spark.read.format("paged").option("url", str(tmp_path)).option("to", 5).load()
    assert sorted(json.loads(r.record)["id"] for r in batch.collect()) == [0, 1, 10, 11, 20, 21]


def test_lines_of_a_live_stream(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema("stream_id long, seq long, text string").json(str(source))
    writer = live.split_lines(stream).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).outputMode("append")
    query = writer.option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        for k, (text, lines) in enumerate([("a\nb", 1), ("c\n", 2), ("d", 2)]):
            (source / f"{k}.json").write_text(json.dumps({"stream_id": 1, "seq": k, "text": text}) + "\n")
            until = time.time() + 40
            while len(out) < lines and time.time() < until:
                assert query.exception() is None
                time.sleep(0.2)
    finally:
        query.stop()
    assert sorted((r.seq, r.text) for r in out) == [(0, "a\n"), (1, "bc\n")]


def test_errors_go_to_their_own_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"text": "x"}\n{"text": "y", "err": "bad"}\n')
    good, bad = [], []
    stream = spark.readStream.schema("text string, err string").json(f"{tmp_path}/in")
    query = live.route(stream, lambda b, n: good.extend(b.collect()), lambda b, n: bad.extend(b.collect())).start()
    query.processAllAvailable()
    query.stop()
    assert [r.text for r in good] == ["x"] and [r.err for r in bad] == ["bad"]


def test_graph_origin(spark):
    edges = spark.createDataFrame([("cc", "aa11", 0), ("dd", "aa11", 0), ("dd", "bb22", 1)], "child string, parent string, ordinal int")
    heads = spark.createDataFrame([("cc",), ("dd",)], "node string")
    got = {r.node: r.origin for r in graph.origin(edges, heads).collect()}
    import hashlib

    assert got == {"cc": "aa11", "dd": hashlib.sha1(bytes.fromhex("aa11bb22")).hexdigest()[-4:]}
    assert F is not None


def test_ordered_text_writes_each_stream_as_it_is(spark, tmp_path):
    from larkspur.operators.streams import ITEM
    from larkspur.sources import writers as W

    rows = [(1, 1, "text", "c", None, None), (1, 0, "text", "ab", None, None), (2, 0, "bytes", None, b"\x00\xff", None), (2, 1, "text", "\u00e9\n", None, None), (3, 0, "text", "", None, None)]
    W.ordered_text(spark.createDataFrame(rows, ITEM), f"{tmp_path}/out")
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert files == {"1": b"abc", "2": b"\x00\xff\xc3\xa9\n", "3": b""}


def test_a_swap_cut_short_leaves_the_old_table(spark, tmp_path):
    from larkspur.sources import writers as W

    path = f"{tmp_path}/t"
    W.json_lines(spark.range(3), path, compression="none")
    assert W.current(spark, path) == path
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert spark.read.json(W.current(spark, path)).count() == 3
    W.json_lines(spark.range(5), path, compression="none")
    assert spark.read.json(W.current(spark, path)).count() == 5 and not (tmp_path / "t.old").exists()
