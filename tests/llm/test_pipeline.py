import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm import bpe, langid, mixing, quality

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on", "re", "he"]) for _ in range(rng.randint(1, 4)))
    texts = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(words) if i % 4 else " ".join(w.upper() + "!!" for w in words))
    texts += texts[1:12] + [t + " tail" for t in texts[13:16]] + ["", "12 34", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_every_stage_against_brute_force(spark, small, tmp_path):
    d, rows = small
    docs, text = spark.read.parquet(f"{d}/documents.parquet"), {r[0]: r[1] for r in rows}
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        seen.append((name, docs, out := spark.read.parquet(f"{tmp_path}/{k}")))
        assert name == "tokens" or out.columns == COLUMNS
        docs = out
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids(seen[0][2])) == [i for i in range(len(rows)) if text[i] and any(c.isalpha() for c in text[i])]
    kept = ids(seen[1][2])
    assert {i for i in kept if i < 120} == {i for i in range(120) if i % 4} and set(kept) >= {119 + i for i in range(1, 12) if i % 4}
    alone = {i for i in kept if not any(j < i and jaccard(text[i], text[j]) >= 0.8 for j in kept)}
    assert set(ids(seen[2][2])) == alone and len(alone) < len(kept)
    taken = mixing.mix(seen[3][1])[2].groupBy("doc_id").sum("words").collect()
    words = {}
    for r in seen[3][2].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r[0]: r[1] for r in taken}
    enc = bpe.encoding(bpe.rank_file(), public_tokenizers.PATTERN)
    want = sorted((r.doc_id, hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest()) for r in seen[4][1].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in seen[4][2].collect()) == want


def test_run_equals_the_stages(spark, small):
    d, _ = small
    first, second = (sorted(tuple(r) for r in pipeline.run(spark, d).collect()) for _ in range(2))
    assert first == second and len(first) > 50


def test_no_text_is_lost_under_a_repeated_id(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, one, "en", "s"), (5, two, "en", "s"), (6, two + " more", "en", "s"), (5, one, "de", "t"), (7, one, "en", "s")]
    docs = spark.createDataFrame([(i, t, g, s, len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(2):
        out = pipeline.one_of_each_group(spark, docs.repartition(3), "").collect()
        assert sorted((r.doc_id, r.text, r.lang) for r in out) == [(5, one, "de"), (5, two, "en")]


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(5)
    words = "the of and to in that is was for with on as by this be are from or at not".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(60)] + [(99, "Поезд идёт на восток и снег ложится на поля", None), (98, "qzxj wvkp xxqj zzkw " * 9, None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.known_language(spark, docs, "").collect()) == list(range(60))


def test_near_duplicates_without_ids(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (5, "x y z u v w"), (None, "x y z u v w"), (5, "x y z u v w")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "a b c d e"), (5, "x y z u v w")]


def test_stages_take_odd_rows(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (odd, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            assert name == "tokens" or out.columns == df.columns
            out.count()
    assert langid and quality
