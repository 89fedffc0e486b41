import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text, values
from larkspur.operators import annotations, graph, hierarchy, integrity, normalize, ranking, streams

RUN = "game_id long, category_id long, level_id long, id long, players array<struct<user_id:long,guest_name:string>>, ms long, date date, created timestamp"


def random_runs(n=500, seed=1):
    rng = random.Random(seed)
    player = lambda: (rng.randint(1, 6), None) if rng.random() < 0.8 else (None, f"g{rng.randint(1, 3)}")
    rows = []
    for i in range(n):
        day = None if rng.random() < 0.2 else date(2020, 1, rng.randint(1, 28))
        made = None if rng.random() < 0.2 else datetime(2020, 2, rng.randint(1, 28), rng.randint(0, 23))
        level = rng.choice([None, 1, 2])
        rows.append((1, rng.randint(1, 3), level, i, [player() for _ in range(rng.randint(1, 2))], None if rng.random() < 0.05 else rng.randint(1, 30) * 1000, day, made))
    rng.shuffle(rows)
    return rows


def none_first(v):
    return (v is not None, v) if v is not None else (False, date.min)


def key(r):
    return (r[5], none_first(r[6]), (r[7] is not None, r[7] or datetime.min), r[3])


def boards(rows):
    out = {}
    for r in rows:
        if r[5] is not None:
            out.setdefault(r[:3], []).append(r)
    return out


def brute_leaderboard(rows, obsoletes=False):
    out = {}
    for board in boards(rows).values():
        ranked, seen = [], set()
        for r in sorted(board, key=key):
            if obsoletes or tuple(r[4]) not in seen:
                seen.add(tuple(r[4]))
                ranked.append(r)
        for n, r in enumerate(ranked):
            same = [k for k, q in enumerate(ranked) if q[5] == r[5]]
            out[r[3]] = (n + 1, same[0] + 1, len(same) > 1)
    return out


def brute_progression(rows):
    out = {}
    for board in boards(rows).values():
        best = None
        for r in sorted(board, key=lambda r: (none_first(r[6]), (r[7] is not None, r[7] or datetime.min), r[3])):
            if best is None or r[5] < best:
                out[r[3]] = 0 if best is None else best - r[5]
                best = r[5]
    return out


def test_leaderboards_and_progressions(spark):
    rows = random_runs()
    runs = spark.createDataFrame(rows, RUN)
    shown = lambda df: {r.id: (r["rank"], r.tied_rank, r.is_tied) for r in df.collect()}
    want = brute_leaderboard(rows)
    assert shown(ranking.leaderboard(runs)) == want
    assert shown(ranking.wide_leaderboard(runs, ranges=5)) == want
    assert shown(ranking.leaderboard(runs, rank_obsoletes=True)) == brute_leaderboard(rows, True)
    assert shown(ranking.leaderboard(runs, limit=3)) == {i: v for i, v in want.items() if v[0] <= 3}
    assert ranking.leaderboard(runs, limit=-1).count() == 0
    found = ranking.progression_with_ranks(runs).collect()
    assert {r.id: r.progress_ms for r in found} == brute_progression(rows)
    assert all((r["rank"], r.tied_rank, r.is_tied) == want.get(r.id, (None, None, None)) for r in found)
    assert ranking.leaderboard(runs.limit(0)).count() == 0 and ranking.wide_leaderboard(runs.limit(0)).count() == 0


def test_cleaning_reaches_a_fixpoint(spark):
    """Two games share a slug, so their categories collide in the first pass and the survivor's may go too."""
    games = spark.createDataFrame([(1, None, "g", "G", "RTA"), (2, datetime(2020, 1, 1), "g", "G2", "RTA"), (3, None, "h", "H", "IGT")], "id long, created timestamp, slug string, name string, primary_timing string")
    categories = spark.createDataFrame(
        [(1, "any", "Any percent", 10, "PerGame", ""), (2, "any", "Any", 20, "PerGame", ""), (3, "x", "X", 30, "PerGame", ""), (9, "y", "Y", 40, "PerGame", "")],
        "game_id long, slug string, name string, id long, per string, rules string",
    )
    levels = spark.createDataFrame([(1, 5, "l", "L", ""), (2, 6, "l", "L", "")], "game_id long, id long, slug string, name string, rules string")
    users = spark.createDataFrame([(None, "u", "U", 1), (datetime(2020, 1, 1), "u", "U", 2)], "created timestamp, slug string, name string, id long")
    run = lambda i, g, c, u, rta=5: (g, c, None, i, None, None, (None, rta, None), [(u, None)], [])
    schema = "game_id long, category_id long, level_id long, id long, created timestamp, date date, times_ms struct<igt:long,rta:long,rta_nl:long>, players array<struct<user_id:long,guest_name:string>>, videos array<string>"
    runs = spark.createDataFrame([run(100, 1, 10, 1), run(101, 2, 20, 1), run(102, 1, 10, 2), run(103, 3, 30, 1), run(104, 1, 10, 1, None)], schema)
    tables = {"games": games, "categories": categories, "levels": levels, "users": users, "runs": runs}
    done, log = integrity.clean(tables)
    ids = {c: sorted(r.id for r in df.select("id").collect()) for c, df in done.items()}
    # game 1 (unknown date first) stays, but its category lost to the shorter name, and so its run goes in round two
    assert ids == {"games": [1, 3], "categories": [30], "levels": [5], "users": [1], "runs": []}
    assert len(log) >= 2 and log[0]["categories"][0] == 2
    assert not integrity.errors(done).count()


def test_normalizing_records(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"id":"0000000a","names":{"international":"Zoë A"}}\n{"id":"0000000b","names":{"japanese":"jp"}}\n{"id":"0000000c","names":{}}\n')
    users = {r.id: (r.name, r.slug) for r in normalize.users(spark.read.schema(normalize.USER).json(f"{tmp_path}/u.json")).collect()}
    assert users == {10: ("Zoë A", "Zo_A"), 11: ("jp", "jp"), 12: ("Corrupt User 0000000c", "Corrupt_User_0000000c")}
    (tmp_path / "g.json").write_text(
        '{"id":"00000001","abbreviation":"g","names":{"international":"G"},"ruleset":{"default-time":"realtime_noloads"},'
        '"categories":{"data":[{"id":"00000002","name":"Any%","type":"per-level"}]},"levels":{"data":[{"id":"00000003","name":"L 1"}]}}\n'
    )
    game, categories, levels = normalize.games(spark.read.schema(normalize.GAME).json(f"{tmp_path}/g.json"))
    assert [(r.id, r.slug, r.primary_timing) for r in game.collect()] == [(1, "g", "RTA_NL")]
    assert [(r.id, r.slug, r.per, r.rules) for r in categories.collect()] == [(2, "Any", "PerLevel", "")]
    assert [(r.game_id, r.id, r.slug) for r in levels.collect()] == [(1, 3, "L_1")]
    run = '{"id":"0000000%s","game":"00000001","category":"00000002","status":{"status":"%s"},"times":{"realtime":"PT1H2M3.004S"},"players":[{"rel":"user","id":"0000000a"},{"rel":"guest","name":"me"}],"videos":[{"uri":"https://youtu.be/abcdefghijk?t=9"},{"uri":"https://x.org"}]}\n'
    (tmp_path / "r.json").write_text(run % ("5", "verified") + run % ("6", "new"))
    (r,) = normalize.runs(spark.read.schema(normalize.RUN).json(f"{tmp_path}/r.json")).collect()
    assert (r.id, r.level_id, r.times_ms.rta, r.times_ms.igt) == (5, None, 3723004, None)
    assert [tuple(p) for p in r.players] == [(10, None), (None, "me")] and [tuple(v) for v in r.videos] == [("youtube", "abcdefghijk", 9, None), ("link", None, None, "https://x.org")]
    good, bad = normalize.quarantined(spark.createDataFrame([("0000000a",), ("??",)], "id string"), {"id": normalize.number(F.col("id"))})
    assert good.count() == 1 and [(b.id, b.problem) for b in bad.collect()] == [("??", "id")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Any%", "Any"), ("a / b", "a__b"), ("", "_"), ("All Campaigns", "All_Campaigns"), ("it's", "its")], "s string, want string")
    assert all(r.got == r.want for r in df.select("want", text.slugify(F.col("s")).alias("got")).collect())
    df = spark.createDataFrame([("PT1H2M3.004S", 3723004), ("P1DT0S", 86400000), ("PT4.5S", 0), ("x", None)], "s string, want long")
    assert all(r.got == r.want for r in df.select("want", text.duration_ms(F.col("s")).alias("got")).collect())
    df = spark.createDataFrame([(0, "-"), (4, "0.004s"), (3723004, "1h02m03.004s"), (62000, "1m02s")], "ms long, want string")
    assert all(r.got == r.want for r in df.select("want", text.duration_text(F.col("ms")).alias("got")).collect())
    df = spark.createDataFrame([("2020-01-02", "2020-01-09", "2020-01-02..09"), ("2020-01-02", "2020-03-01", "2020-01-02..03-01"), ("2020-01-02", "2021-01-02", "2020-01-02..2021-01-02"), ("2020-01-02", "2020-01-02", "2020-01-02")], "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", text.date_range(F.col("a"), F.col("b")).alias("got")).collect())
    df = spark.createDataFrame([("/a//./b/", "a/b"), ("", "")], "p string, want string")
    assert all(r.got == r.want for r in df.select("want", text.normal_path(F.col("p")).alias("got")).collect())
    assert spark.createDataFrame([("r5 / g6 / n7 / o00ff",), ("x5",)], "m string").select(text.graph_message(F.col("m")).alias("g")).collect()[0].g == ("r", 5, 6, 7, 255)


def test_shell_words(spark):
    cases = [
        (b"a b", [b"a", b"b"], []), (b"'a b' \"c $d\" e\\ f", [b"a b", b"c $d", b"e f"], ["dollar_sign"]), (b"a\\\nb", [b"ab"], []), (b"'' x", [b"", b"x"], []),
        (b"~ a~ #x y#", [b"~", b"a~", b"#x", b"y#"], ["tilde", "hash"]), (b"a|b", [b"a|b"], ["pipe"]), (b"a\nb", [b"a", b"b"], ["newline"]),
        (b"'open", [b"open"], ["unclosed_single_quote"]), (b'"open', [b"open"], ["unclosed_double_quote"]), (b"x\\", [b"x"], ["trailing_backslash"]), (b'"a\\"b\\c"', [b'a"b\\c'], []), (b"", [], []),
    ]
    for line, args, errors in cases:
        assert text.shell_words(line)[0] == args, line
        assert [k for k, _, _ in text.shell_words(line)[1]] == errors, line
    row = spark.createDataFrame([("say 'hi there' *",)], "s string").select(text.split_shell("s").alias("r")).first().r
    assert [bytes(a) for a in row.args] == [b"say", b"hi there", b"*"] and tuple(row.errors[0]) == ("asterisk", 42, 15)


def test_streams_across_items(spark):
    rows = [(1, 0, "text", "a\nb", None, None), (1, 1, "text", "c\n\nd e  ", None, None), (1, 2, "text", "f", None, None), (1, 3, "text", None, None, "boom"), (1, 4, "text", "é漢g", None, None), (1, 5, "bytes", None, b"xyz", None), (1, 6, "text", "", None, None), (1, 7, "value", None, None, None)]
    items = spark.createDataFrame(rows, streams.ITEM)
    got = lambda df: [r.err or r.text or (bytes(r.bytes) if r.bytes is not None else r.kind) for r in df.orderBy("seq").collect()]
    assert got(streams.lines(items)) == ["a\n", "bc\n", "\n", "d e  f", "boom", "é漢g", b"xyz", "value"]
    assert got(streams.words(items)) == ["a", "bc", "d", "e", "f", "boom", "é漢g", b"xyz", "value"]
    assert got(streams.chunks(items, 2)) == ["a\n", "bc", "\n\n", "d ", "e ", " f", "boom", "é漢", "g", b"xy", b"z", "value"]
    assert got(streams.chunks(items, 0))[0] == "a\nbc\n\nd e  f"
    assert got(streams.split_after(items, "b"))[:2] == ["a\nb", "c\n\nd e  f"]
    assert got(streams.split_after(items, "bc"))[:2] == ["a\nbc", "\n\nd e  f"]
    assert got(streams.split_after(spark.createDataFrame([(1, 0, "text", "aaa", None, None)], streams.ITEM), "aa")) == ["aa", "a"]
    assert got(streams.fail_fast(items)) == ["a\nb", "c\n\nd e  ", "f"] and got(streams.errs(items)) == ["boom"]
    assert len(got(streams.without_empty(items))) == 7
    assert streams.lines(items.limit(0)).count() == 0


def test_values_have_a_total_order():
    ordered = ["null", "false", "true", "-1e300", "-1", "-0.0", "0", "1e-5", "2", "10", '{"$bytes":"00"}', '{"$bytes":"0001"}', '""', '"a"', '"a\\u0000"', '"ab"', "[]", "[1]", "[1,2]", "[2]", "{}", '{"a":1}', '{"a":1,"b":0}', '{"b":0}']
    keys = [values.order_key(values.imported(t)) for t in ordered]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert values.kind_of(values.imported("9007199254740993")) == "bytes" and values.kind_of(values.imported("9007199254740992")) == "number"
    assert values.kind_of(values.imported("1e999")) == "string" and values.kind_of(values.imported('{"$bytes": 3}')) == "string_map"


def test_value_columns(spark):
    df = spark.createDataFrame([(2**53 + 1, 1.5), (5, float("inf"))], "n long, x double")
    rows = df.select(values.number_or_bytes(F.col("n")).alias("n"), values.double_or_bytes(F.col("x")).alias("x")).collect()
    assert [tuple(r) for r in rows] == [('{"$bytes":"0020000000000001"}', "1.5"), ("5", '{"$bytes":"7ff0000000000000"}')]
    bad = spark.createDataFrame([("{",), (None,), ("[1]",)], "t string").select(values.value_kind("t").alias("k")).collect()
    assert [r.k for r in bad] == [None, None, "array"]


def test_annotations(spark):
    body = "[def a.b +doc-test @self]\nsee [impl a.b] and `[impl c]` [x](y) [impl bad..id]\n```\n[impl hidden]\n```\n// [test a.b.c] [solo]\n"
    rows = annotations.parse(spark.createDataFrame([("f.md", body)], "path string, content string"), with_context=True).orderBy("line", "col").collect()
    assert [(r.kind, r.id, r.line, r.col) for r in rows] == [("def", "a.b", 1, 1), ("impl", "a.b", 2, 5), ("test", "a.b.c", 6, 4)]
    assert (rows[0].add_types, rows[0].remove_types, rows[0].mode) == (["doc"], ["test"], "self") and rows[1].add_types == []
    files = spark.createDataFrame([("g", "// one\n// two\n//\n//  three")], "path string, content string")
    got = [r.context for r in annotations.contexts(annotations.file_lines(files)).orderBy("line").collect()]
    assert got[0] == got[1] == "one\ntwo" and got[3] == "three"


def test_requirements_roll_up(spark):
    def_ = lambda i, add=(), remove=(), mode=None, file="f": ("def", i, list(add), list(remove), mode, file, 1, 1)
    note = lambda kind, i: (kind, i, [], [], None, "g", 1, 1)
    rows = [def_("a", add=["doc", "def"]), def_("a.b", remove=["doc"]), def_("a.c", mode="self"), def_("x.y.z"), def_("a", file="e"), note("impl", "a.b"), note("test", "a.b"), note("impl", "a.c"), note("impl", "nowhere")]
    frame = spark.createDataFrame(rows, "kind string, id string, add_types array<string>, remove_types array<string>, mode string, file string, line int, col int")
    tree = hierarchy.requirements(frame)
    # the definition in the first file counts, which adds nothing
    assert {r.id: (r.required, r.implicit) for r in tree.collect()} == {
        "a": (["impl", "test"], False), "a.b": (["impl", "test"], False), "a.c": (["impl", "test"], False), "x": (["impl", "test"], True), "x.y": (["impl", "test"], True), "x.y.z": (["impl", "test"], False),
    }
    status = hierarchy.satisfaction(tree)
    assert {r.id: (r.satisfied, r.complete) for r in status.collect()} == {"a": (False, False), "a.b": (True, True), "a.c": (False, False), "x": (False, False), "x.y": (False, False), "x.y.z": (False, False)}
    assert hierarchy.duplicate_definitions(frame).count() == 1
    assert [r.line for r in hierarchy.listing(status, ["a"], every=True).collect()] == ["a: missing impl, test", "  a.b: complete", "  a.c: missing test"]
    assert hierarchy.listing(status, skip=1, limit=2).count() == 2
    assert tuple(hierarchy.totals(status).first()) == (6, 1, 5)


def test_graph_depths_cycles_and_blobs(spark):
    edges = spark.createDataFrame([("d", "c", 0), ("c", "b", 0), ("b", "a", 0), ("d", "a", 1)], "child string, parent string, ordinal int")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    near = graph.reachable(edges, nodes.where("node = 'd'"), most_depth=1)
    assert sorted((r.node, r.depth) for r in near.collect()) == [("a", 1), ("c", 1), ("d", 0)]
    assert {r.node: r.generation for r in graph.generation_index(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert {r.node: r.revision for r in graph.revision_index(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert [r.node for r in graph.topological(nodes, edges, []).collect()] == list("abcd")
    for more in (("a", "d", 1), ("b", "c", 1)):
        with pytest.raises(ValueError):
            graph.generation_index(nodes, edges.union(spark.createDataFrame([more], edges.schema)))
    wanted = spark.createDataFrame([("d", "k", "src/x/f")], "node string, blob string, path string")
    holders = spark.createDataFrame([("a", "k", "old/f"), ("a", "k", "lib/x/f"), ("b", "k", "src/x/f")], "node string, blob string, path string")
    assert [(r.found, r["at"]) for r in graph.nearest_with_blob(edges, wanted, holders).collect()] == [("a", "lib/x/f")]


def test_streams_of_bytes_and_texts_are_cut_alike(spark):
    from larkspur.operators import streams as S

    rows = [(1, 0, "bytes", None, b"a\nb", None), (1, 1, "bytes", None, b"\xc3", None), (1, 2, "bytes", None, b"\xa9 c\n", None), (1, 3, "text", "x", None, None), (1, 4, "text", "y\nz", None, None), (1, 5, "text", None, None, "bad"), (1, 6, "text", "q", None, None)]
    df = spark.createDataFrame(rows, S.ITEM)
    listed = lambda d: [r.err or (r.text if r.kind == "text" else bytes(r.bytes)) for r in d.orderBy("seq").collect()]
    assert listed(S.lines(df)) == [b"a\n", b"b\xc3\xa9 c\n", "xy\n", "z", "bad", "q"]
    assert listed(S.words(df)) == [b"a", b"b\xc3\xa9", b"c", "xy", "z", "bad", "q"]
    got = S.joined(spark.createDataFrame([(1, 0, "bytes", None, b"a\nb", None), (1, 1, "bytes", None, b"\nc d", None), (2, 0, "text", "u", None, None), (2, 1, "bytes", None, b"v", None), (3, 0, "text", "w", None, None)], S.ITEM), between="-").orderBy("stream_id").collect()
    assert [(r.text, r.bytes and bytes(r.bytes)) for r in got] == [(None, b"a\nb-\nc d"), (None, b"u-v"), ("w", None)]


def test_patterns_across_items_match_a_plain_scan(spark):
    import random

    from larkspur.operators import streams as S

    rng = random.Random(4)
    for pattern in ("ab", "aba", "aa", "é-", "abc|"):
        rows, want = [], {}
        for stream in range(20):
            texts = ["".join(rng.choice(["a", "b", "é", "-", "c", "|", ""]) for _ in range(rng.randint(0, 4))) for _ in range(12)]
            whole, out, at = "".join(texts), [], 0
            while (hit := whole.find(pattern, at)) >= 0:
                out.append(whole[at : hit + len(pattern)])
                at = hit + len(pattern)
            want[stream] = out + ([whole[at:]] if whole[at:] else [])
            rows += [(stream, k, "text", t, None, None) for k, t in enumerate(texts)]
            rows += [(stream + 100, k, "bytes", None, t.encode(), None) for k, t in enumerate(texts)]
        got = {}
        for r in S.split_after(spark.createDataFrame(rows, S.ITEM), pattern).orderBy("stream_id", "seq").collect():
            got.setdefault(r.stream_id, []).append(r.text if r.kind == "text" else bytes(r.bytes).decode())
        for stream, parts in want.items():
            assert got.get(stream, []) == parts and got.get(stream + 100, []) == parts


def test_records_and_limits_match_a_plain_walk(spark):
    """Boards large enough for many shares and ranges, with ties at the limit and a stray time."""
    import random

    from larkspur.operators import ranking as R

    rng = random.Random(6)
    rows = [(1, b, None, i, rng.choice([10**9, rng.randint(50, 400)]) if i % 97 == 0 else rng.randint(50, 400), f"2020-01-{rng.randint(1, 28):02d}" if i % 5 else None, None, [{"user_id": i, "guest_name": None}]) for b in (1, 2) for i in range(b * 1000, b * 1000 + 600)]
    df = spark.createDataFrame(rows, "game_id long, category_id long, level_id long, id long, ms long, date string, created timestamp, players array<struct<user_id:long,guest_name:string>>").withColumn("date", F.to_date("date"))
    want = set()
    for b in (1, 2):
        best = None
        for r in sorted((r for r in rows if r[1] == b), key=lambda r: (r[5] is not None, r[5] or "", r[3])):
            if best is None or r[4] < best:
                want.add((r[3], 0 if best is None else best - r[4]))
                best = r[4]
    assert {(r.id, r.progress_ms) for r in R.progression(df).collect()} == want
    show = lambda d: {(r.id, r["rank"], r.tied_rank, r.is_tied) for r in d.collect()}
    whole = show(R.leaderboard(df))
    assert show(R.wide_leaderboard(df)) == whole
    for limit in (-1, 0, 1, 7, 40):
        assert show(R.leaderboard(df, limit=limit)) == {r for r in whole if r[1] <= limit}
