import math
import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import kmeans_dedup as K
from larkspur.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute_top(rows, k, is_query):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if not is_query(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def floats(rng, n):
    return [float(round(rng.uniform(-1, 1) * 64) / 64) for _ in range(n)]


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 5)
    monkeypatch.setattr(T, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(T, "BINS", 16)  # many rounds
    rng = random.Random(5)
    rows = [(i, floats(rng, 6)) for i in range(250)]
    rows += [(i, rows[0][1]) for i in range(250, 330)]  # a very common vector: ties by the dozen
    rows += [(400, None), (420, [0.5, None] + [0.0] * 4), (440, [float("nan")] + [0.0] * 5), (460, [float("inf")] + [0.0] * 5), (480, [0.0] * 6)]
    got = {tuple(r) for r in T.exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(rows, 20, lambda i: i % 20 == 0)


def test_top_k_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0, 0.0])]
    got = T.exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 64 * 32)]
    assert T.exact_top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_takes_every_row_with_a_query_id(spark):
    got = T.exact_top_k(vectors(spark, [(20, [1.0]), (20, [2.0]), (21, [3.0])]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 21, 64 * 192), (20, 1, 21, 128 * 192), (20, 2, 20, 64 * 128), (20, 2, 20, 64 * 128)]
    got = T.exact_top_k(vectors(spark, [(20, [1.0]), (20, [1.0])]), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 20, 4096)] * 2


def test_top_k_keeps_a_null_id_last(spark):
    rows = [(0, [1.0]), (None, [1.0]), (5, [1.0])]
    got = T.exact_top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 5), (2, None)]


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL_ROWS", 9)  # cells are cut into blocks
    rng = random.Random(2)
    rows = []
    for _ in range(12):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        rows += [[c + rng.gauss(0, s) for c in centre] for s in (0.0, 0.0, 0.05, 0.15, 0.25, 0.3, 0.35, 0.4)]
    rows += [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = list(enumerate(rows))
    f32 = {r.vec_id: r.embedding for r in vectors(spark, rows).collect()}
    got = {r.vec_id: r for r in K.near_duplicates(vectors(spark, rows), exact=True).collect()}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in f32.items()}
    near = {i: [j for j in f32 if j != i and sum(a * b for a, b in zip(f32[i], f32[j], strict=True)) / norm[i] / norm[j] >= 0.9] for i in f32}
    assert {i: r.n_links for i, r in got.items()} == {i: len(n) for i, n in near.items()}
    for i in f32:
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (6, [2.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in K.near_duplicates(vectors(spark, rows)).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 7, 8)]
    assert got == sorted([*alone, (5, 2, 5, True), (6, 2, 5, False), (6, 2, 5, False)])
    assert K.near_duplicates(vectors(spark, [])).count() == 0


def test_probes_find_most_pairs_and_only_pairs(spark):
    """Recall against brute force, with similarities down to the threshold; links only where there is one."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 32))
    spread = rng.uniform(0.02, 0.33, (300, 1, 1))
    x = (centres[:, None, :] + spread * rng.normal(size=(300, 6, 32))).reshape(-1, 32).astype(np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    rows = K.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    links = np.zeros(len(x), int)
    for r in rows:
        links[r.vec_id] = r.n_links
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum() > 1000


def test_cells_grow_with_the_table_and_rows_dealt_do_not():
    assert [K.cell_count(n) for n in (0, 1, 100, 10_000, 10**6, 10**10)] == [1, 1, 5, 50, 500, 50_000]
    rng = np.random.default_rng(2)
    x = K.unit(rng.normal(size=(500, 16)))
    own, row, cell = K.visited(x, K.unit(rng.normal(size=(40, 16))), 0.9, 6)
    assert len(own) == 500 and len(row) == 500 * 5 and (cell != own[row]).all()
