import random

import numpy as np
import xxhash

from larkspur.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs: (doc_id, fp); component of each row by all comparisons."""
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= 4:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(pairs))]


def near_texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(25):
        words = [word() for _ in range(rng.randint(1, 220))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            out.append(" ".join(changed))
    return out


def test_fingerprints_and_components_match_brute_force(spark, docs):
    texts = near_texts() + ["", " ", None, "one", "One", "two words", "Ünïcode ünïcode"]
    rows = S.near_duplicates(docs([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in rows}
    assert {i: v[0] for i, v in got.items()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components([(i, got[i][0]) for i in range(len(texts))])
    assert [got[i][1] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts)


def test_trees_find_every_pair_within_the_radius(spark, monkeypatch):
    """Planted distances 1 to 5 in clusters, with shards so small that they are cut into blocks."""
    monkeypatch.setattr(S, "SHARD_ROWS", 7)
    rng = random.Random(1)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps += [centre] + [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(25)]
    fps = sorted(set(fps))
    reps = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    tasks = S.search_tasks(reps)
    roots = {r.node: r.root for r in S.components(S.shard_links(tasks, S.RADIUS)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(list(enumerate(fps)))
    pairs = {(r.src, r.dst) for r in S.nearest_pairs(tasks, S.RADIUS, 2).collect()}
    distance = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    assert pairs and all(i < j and distance(i, j) <= 4 for i, j in pairs)
    for i in range(len(fps)):  # the nearest other is among them
        least = min(distance(i, j) for j in range(len(fps)) if j != i)
        assert least > 4 or any(distance(i, j) == least for j in range(len(fps)) if (min(i, j), max(i, j)) in pairs)


def met(u, v, trees, vantage):
    """Which pairs (u[i], v[i]) share a shard that one of them owns."""
    out = np.zeros(len(u), bool)
    for t, parts in enumerate(trees):
        (ca, ra), (cb, rb) = S.paths(u, t, parts, vantage), S.paths(v, t, parts, vantage)
        for own, cells, rows in ((ca, cb, rb), (cb, ca, ra)):
            out[rows[cells == own[: len(u)][rows]]] = True
    return out


def test_every_family_of_trees_is_exact():
    rng = np.random.default_rng(3)
    u = rng.integers(0, 2**64, 800, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(800)]
    v = u ^ np.array(flips, np.uint64)
    for n, trees in ((50, 3), (10**6, 3), (10**9, 4), (10**11, 8)):
        forest = S.forest(n, u[:300].view(np.int64))
        assert len(forest) == trees and met(u, v, forest, u[:300]).all()


def test_comparisons_do_not_grow_with_the_table():
    rng, each = np.random.default_rng(4), []
    for n in (50_000, 200_000, 600_000):
        u = rng.integers(0, 2**64, n, dtype=np.uint64)
        sample, pairs = u[: S.VANTAGE_SAMPLE], 0
        for t, parts in enumerate(S.forest(n, sample.view(np.int64))):
            cell = S.paths(u, t, parts, sample)[0]
            _, number, rows = np.unique(cell, return_inverse=True, return_counts=True)
            pairs += (np.bincount(number[:n], minlength=len(rows)) * rows).sum()
        each.append(pairs / n)
    assert max(each) < 2 * min(each)


def test_rows_without_ids_tie_groups(spark, docs):
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(words[: 297 + i]) for i in range(4)}
    prints = [brute_fingerprint(t) for t in texts.values()]
    assert all((a ^ b).bit_count() <= 4 for a, b in zip(prints, prints[1:], strict=False))
    rows = S.near_duplicates(docs([(9, texts[0], "en", "s"), (None, texts[1], "en", "s"), (None, texts[2], "en", "s"), (4, texts[3], "en", "s"), (None, "quite another text", "en", "s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 4), (0, 4), (4, 4), (9, 4)]


def test_odd_rows(spark, odd, empty):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == 12
    component = {r.doc_id: r.component_id for r in rows}
    assert component[1] == component[2] == component[3] == 1  # fingerprint 0 links like any other
    assert component[4] == component[5] == 4 and component[7] == 7
    assert S.near_duplicates(empty).count() == 0


def test_query(spark, docs, table_dir):
    out = S.op1_simhash_near_dedup(spark, table_dir(documents=docs([(3, "a b c d", "en", "s"), (2, "A  b\nc d", "en", "s"), (1, "", "en", "s")]))).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 2, 3: 2}
    assert {r.fingerprint for r in out if r.doc_id > 1} == {f"{brute_fingerprint('a b c d'):016x}"}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    texts = [t.encode() for t in near_texts(9)] + [b"", b"  ", b"x" * 300, b"a b c", b"a  b\tc\nd e"]
    whole = [S.fingerprint(t) for t in texts]
    monkeypatch.setattr("larkspur.llm.common.SEGMENT", 40)
    assert [S.fingerprint(t) for t in texts] == whole
