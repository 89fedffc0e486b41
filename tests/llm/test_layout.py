from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import mixing as M
from larkspur.llm import sharding as H
from larkspur.llm.common import numbered_copies


def test_matrix_has_exact_margins():
    rows = [0, 5, 17, 1, 300]
    m = H.communication_matrix(rows, 7)
    assert m.sum(1).tolist() == rows and sorted(m.sum(0).tolist())[-1] - sorted(m.sum(0).tolist())[0] <= 1
    assert (m >= 0).all() and (m == H.communication_matrix(rows, 7)).all()


def test_large_draws_stay_feasible():
    room = np.array([2 * 10**9, 3, 10**9], np.int64)
    for n in (0, 1, 10**9, int(room.sum())):
        got = H.hypergeometric(np.random.default_rng(1), room, n)
        assert got.sum() == n and (got >= 0).all() and (got <= room).all()


def test_shards_are_exact_gapless_and_mixed(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 20)
    df = spark.range(1003).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("k"))
    rows = H.shuffle_into_shards(df, ["doc_id", "k"], shards=8).collect()
    sizes = Counter(r.shard for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(1003)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        inside = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert [x for x, _ in inside] == list(range(n)) and [d for _, d in inside] != sorted(d for _, d in inside)
    again = H.shuffle_into_shards(df.repartition(7), ["doc_id", "k"], shards=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_odd_rows(spark, odd, empty, table_dir):
    rows = H.op8_hypergeometric_sharding(spark, table_dir(documents=odd)).collect()
    assert len(rows) == 12 and {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert {r.doc_id: r.size for r in rows}[1] == 8 and {r.doc_id: r.text_crc32 for r in rows}[2] == 0
    assert H.op8_hypergeometric_sharding(spark, table_dir(documents=empty)).count() == 0


def test_written_shards_hold_whole_rows_in_order(spark, docs, tmp_path):
    H.write_shards(docs([(i, f"text {i}", "en", "s") for i in range(60)]), f"{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.text for r in back) == sorted(f"text {i}" for i in range(60)) and {r.shard for r in back} == {0, 1, 2}


def test_targets_fill_and_stop():
    assert M.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert M.targets([0, 10]) == [0.0, 15.0]
    assert M.targets([10, 1000, 10]) == [20.0, 1490.0, 20.0]
    assert M.targets([]) == []


def test_draws_respect_room_and_totals():
    wanted, room = [200.0, 83.3, 166.7], [200, 400, 400]
    m = M.draw_counts(wanted, room, 16)
    assert m.sum() == 450 and (m.sum(0) <= room).all()
    assert np.abs(m.sum(0) - wanted).max() < 12


def test_permutations_visit_every_index():
    for n in (1, 2, 3, 7, 30, 97, 1000):
        for key in (0, 5):
            got = M.permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
    n = 4000
    got = M.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
    assert len(set(np.diff(got).tolist())) > n // 3  # no fixed stride
    assert (got != M.permute(np.arange(n), np.full(n, n), np.full(n, 10, np.uint64))).mean() > 0.99
    mixed = M.permute(np.array([0, 1, 0]), np.array([1, 2, 1]), np.array([1, 2, 3], np.uint64))
    assert mixed[0] == mixed[2] == 0 and mixed[1] in (0, 1)


def test_copies_are_numbered_across_partitions(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 == 0, F.lit("x")).alias("v")).repartition(7)
    got = {}
    for r in numbered_copies(df, ["k", "v"], "n").collect():
        got.setdefault((r.k, r.v), []).append(r.n)
    assert len(got) == 6 and all(sorted(v) == list(range(len(v))) for v in got.values())


def test_large_draws_follow_the_exact_law():
    rng = np.random.default_rng(6)
    for good, bad, draws in ((30, 50, 20), (3, 400, 100), (500, 20, 400), (1, 1, 1), (10, 10, 20)):
        got = np.array([H.large_hypergeometric(rng, good, bad, draws) for _ in range(6000)])
        want = rng.hypergeometric(good, bad, draws, 200_000)
        for k in np.unique(want):
            p = (want == k).mean()
            assert abs((got == k).mean() - p) < 5 * (p * (1 - p) / 6000) ** 0.5 + 0.003
    big = np.array([H.large_hypergeometric(rng, 4 * 10**9, 9 * 10**9, 10**6) for _ in range(300)])
    assert abs(big.mean() / (10**6 * 4 / 13) - 1) < 1e-3 and 380 < big.std() < 545  # 461 by the law


def test_copies_of_one_row_and_clashing_names(spark, docs, monkeypatch):
    monkeypatch.setattr(H, "BUCKET_ROWS", 20)
    df = docs([(7, "the same text", "en", "s")] * 700 + [(i, f"text {i}", "en", "s") for i in range(300)], extra=True).selectExpr("*", "'y' AS row", "1 AS bucket", "2 AS h", "3 AS copy").repartition(6)
    rows = H.shuffle_into_shards(df, ["doc_id", "text"], shards=5).collect()
    assert len(rows) == 1000 and set(df.columns) - set(rows[0].asDict()) == set() and {r.row for r in rows} == {"y"}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes.values()) == {200}
    copies = Counter(r.shard for r in rows if r.doc_id == 7)
    assert max(copies.values()) < 170 and min(copies.values()) > 110  # 140 expected


def test_mix_spreads_copies_and_keeps_texts_of_one_id(spark, docs):
    same = " ".join(f"w{k}" for k in range(300))
    rows = [(1, same, "en", "a")] * 50 + [(1, same.replace("w", "v"), "en", "a")] * 3 + [(2, same.replace("w", "u"), "en", "b")]
    out = M.mixed_documents(docs(rows)).collect()
    assert {r.text[0] for r in out} == {"w", "v", "u"}
    placed = M.positions(docs(rows)).collect()
    assert len({(r.skey, r["first"]) for r in placed}) == 54


def test_mix_by_source(spark, docs, table_dir):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(20 + i % 50)), "en", ["a", "b", None, "hot"][i % 8 if i % 8 < 3 else 3]) for i in range(2000)]
    d = table_dir(documents=docs(rows))
    out = M.op9_mixing(spark, d).collect()
    assert len(out) == 2000 and all(r.size == 20 + r.doc_id % 50 and r.taken <= 2 * r.size for r in out)
    by = {}
    for r in out:
        s = rows[r.doc_id][3]
        by.setdefault(s, [0, 0, r.source_size, r.target])
        by[s][0] += r.size
        by[s][1] += r.taken
    order = ["a", "b", "hot", None]
    want = M.targets([by[s][0] for s in order])
    for s, t in zip(order, want, strict=True):
        assert by[s][0] == by[s][2] and abs(by[s][3] - t) < 1e-6 and abs(by[s][1] / t - 1) < 0.05
    again = M.op9_mixing(spark, d).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixed_documents_hold_the_words_taken(spark, docs):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(300)), "en", f"s{i % 3}") for i in range(40)]
    df = docs(rows)
    _, _, mixed = M.mix(df)
    taken = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    got = Counter()
    for r in M.mixed_documents(df).collect():
        words = r.text.split()
        got[r.doc_id] += len(words)
        assert words == sorted(words, key=lambda w: int(w.split("_")[1])) and len(set(words)) == len(words) and r.n_chars == len(r.text)
    assert got == taken


def test_mix_takes_columns_of_any_type(spark, docs):
    df = docs([(i, f"some words {i} " * 30, "en", "ab"[i % 2]) for i in range(20)]).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("mark", F.lit(1)).withColumn("size", F.lit("x"))
    out = M.mixed_documents(df)
    assert out.columns == df.columns and out.count() > 0


def test_mix_of_odd_rows(spark, odd, empty, table_dir):
    out = M.op9_mixing(spark, table_dir(documents=odd)).collect()
    assert len(out) == 12 and all(r.taken <= 2 * r.size for r in out) and {r.doc_id: r.taken for r in out}[2] == 0
    assert M.op9_mixing(spark, table_dir(documents=empty)).count() == 0
    assert M.mixed_documents(odd).count() > 0 and M.mixed_documents(empty).count() == 0
