import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm import bpe, langid, licenses, quality, toxicity
from larkspur.llm.common import held_out
from pyspark.sql import functions as F

WORDS = {
    "en": "the of and to in that is was for with on as by this be are from or at not but have they which one you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un une du que est pour dans par sur pas plus avec ce qui ne se été".split(),
}


def prose(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def test_language_on_the_held_out_fold(spark, docs):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng.randint(15, 60), rng), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    df = docs(rows)
    out = {r.doc_id: r for r in langid.identify(df, langid.fit(df)).select("doc_id", "lang_pred", "score", "lang").collect()}
    unseen = [r for i, r in out.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(unseen) > 20 and sum(r.lang_pred == r.lang for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_learns_only_from_its_fold(spark, docs):
    rows = [(i, "aaa bbb", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", "s") for i in range(40)]
    df = docs(rows)
    assert {r.lang for r in langid.sample_by_language(df).collect()} == {"yy"}


def ppm(texts):
    return langid.PpmModel({k: langid.grams(v) for k, v in texts.items()})


CATS = {"en": [b"the cat sat on the mat. " * 40, b"a dog. " * 30], "de": [b"der hund und die katze. " * 40]}


def test_language_costs_are_a_distribution_over_all_bytes():
    model = ppm(CATS)
    others = 257 - model.size  # bytes that no text showed cost the same
    for tree in model.trees:
        p = np.exp2(-tree.costs.reshape(-1, model.size).astype(float))
        assert np.allclose(p[:, 1:].sum(1) + others * p[:, 0], 1, atol=1e-4)


def brute_bits(sample, text, least):
    """PPM-C code length with exclusion, counted from the sample's contexts one byte at a time."""
    from collections import Counter, defaultdict
    from math import log2

    counts = [defaultdict(Counter) for _ in range(4)]
    for t in sample:
        t = b"\n\n\n" + t
        for i in range(3, len(t)):
            for order in range(4):
                counts[order][t[i - order : i]][t[i]] += 1
    total, padded = 0.0, b"\n\n\n" + text
    for i in range(3, len(padded)):
        depth = 0
        while depth < 3 and sum(counts[depth + 1][padded[i - depth - 1 : i]].values()) >= least:
            depth += 1
        left, out, cost = 1.0, set(), None
        for order in range(depth, -1, -1):
            c = {k: n for k, n in counts[order][padded[i - order : i]].items() if k not in out}
            if not c:
                continue
            if padded[i] in c:
                cost = left * c[padded[i]] / (sum(c.values()) + len(c))
                break
            left *= len(c) / (sum(c.values()) + len(c))
            out |= set(c)
        total -= log2(cost if cost is not None else left / (256 - len(out)))
    return total


def test_code_lengths_match_a_walk_of_the_tree():
    model = ppm(CATS)
    for text in (b"the cat sat", b"der hund sat on a \xff\xfe katze", b"zzz 123", "漢字 the dog".encode()):
        got = model.bits([text])[0]
        want = [brute_bits(CATS[k], text, langid.LEAST_USES) for k in model.langs]
        assert np.allclose(got, want, rtol=1e-4)


def test_languages_of_long_texts_only_are_learned(spark, docs):
    rng = random.Random(13)
    rows = [(i, prose("de" if i % 2 else "fr", 9000, rng), "de" if i % 2 else "fr", "s") for i in range(24)]
    assert min(len(r[1]) for r in rows) > 32 << 10
    df = docs(rows)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).select("doc_id", "lang_pred").collect()}
    assert all(got[i] == rows[i][2] for i in range(24))


def test_language_sample_is_bounded_by_rows(spark, docs):
    df = docs([(None, "the same text", "en", "s")] * 900 + [(7, "der text", "de", "s")] * 900)
    counts = {r.lang: r["count"] for r in langid.sample_by_language(df, 20).groupBy("lang").count().collect()}
    assert set(counts) <= {"en", "de"} and all(0 < n <= 20 for n in counts.values())


def test_letters_by_category():
    assert not any(langid.has_letter(t.encode()) for t in ("½ ②", "Ⅷ", "12 34", "_", "\u0301")) and all(langid.has_letter(t.encode()) for t in ("é", "漢", "x", "ª"))


def test_long_texts_cost_the_sum_of_their_bytes(monkeypatch):
    model = ppm(CATS)
    text = "The dog and the cat sat. ÉÀ".encode() * 200
    whole = model.bits([text, b"short"])
    monkeypatch.setattr(langid, "CHUNK", 101)
    assert np.allclose(model.bits([text, b"short"]), whole, rtol=1e-6)


def test_language_of_odd_rows(spark, odd, empty):
    got = {r.doc_id: r for r in langid.identify(odd, langid.fit(odd)).select("doc_id", "lang_pred", "score").collect()}
    for i in (1, 2, 3, 10):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[8].lang_pred == "en" and len(got) == 11
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    blank = langid.identify(odd, langid.fit(empty)).select("lang_pred").distinct().collect()
    assert [r[0] for r in blank] == ["und"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoding(bpe.rank_file(), public_tokenizers.PATTERN)


def test_encoding_is_the_library_s(encoder):
    rng = random.Random(4)
    alphabet = ["a", "é", "漢", " ", "  ", "\n", "\t", "1", "'s", "'", "!", "Ab", " the", " ", "<|endoftext|>", "\U0001f600", "\x1c"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = bpe.encode(encoder, text)
        assert ids.tolist() == encoder.encode_ordinary(text)
        assert bpe.decode(encoder, ids) == text.encode()


def test_long_texts_are_cut_at_match_boundaries(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 8)
    rng = random.Random(9)
    parts = ["word", " and", "  two", "\n\n", " " * 30, "\t\n" * 9, "'s", " 12", "!?", "é ü", " 　" * 6]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(60))
        assert "".join(bpe.safe_pieces(text, 20)) == text
        assert [i for p in bpe.safe_pieces(text, 20) for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)
    for words in (["漢字かな", "。", "です", "、", "一", "！", "x"], ["слово", " и", " ещё", ", ", "да"], ["हिन्दी", " है", "।", " १२"]):
        for _ in range(50):
            text = "".join(rng.choice(words) for _ in range(80))
            pieces = list(bpe.safe_pieces(text, 20))
            assert "".join(pieces) == text and len(pieces) > 1
            assert [i for p in pieces for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)
    text = "".join(rng.choice(parts) for _ in range(200))
    run = __import__("re").compile(bpe._RUN.pattern.replace("4096", "8"))
    monkeypatch.setattr(bpe, "_RUN", run)
    assert bpe.encode(encoder, text).tolist() == encoder.encode_ordinary(text)


def test_another_pattern_is_matched_whole(monkeypatch):
    other = bpe.encoding(bpe.rank_file(), r"\s+|\S+")
    monkeypatch.setattr(bpe, "RUN", 8)
    text = "some words" + " " * 40 + "and more\n" * 10
    assert bpe.encode(other, text).tolist() == other.encode_ordinary(text)


def test_token_digests_of_odd_rows(spark, odd, empty, encoder):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe.token_digests(odd).collect()
    assert len(rows) == 12
    for r in rows:
        ids = encoder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.token_digests(empty).count() == 0
    assert [r.ids for r in bpe.tokenize(odd).where("doc_id = 4").collect()] == [encoder.encode_ordinary("word")]


def test_license_texts_in_any_dress(spark, docs):
    mit = licenses.KNOWN["MIT"][1]
    rows = [
        (1, mit, "en", "s"), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n  "), "en", "s"), (3, mit.replace("sublicense", "sub-licence"), "en", "s"),
        (4, mit + " And more.", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, "© 2001 by me", "en", "s"), (8, "licensed under the apache license version 2 0", "en", "s"),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(rows, extra=True)).collect()}
    assert [got[i].license for i in range(1, 9)] == ["MIT", "MIT", "MIT", None, None, None, None, "Apache-2.0 notice"]
    assert got[5].digest is None and got[6].digest == got[7].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(docs([])).count() == 0
    names = {r.license for r in licenses.known_digests(spark).collect()}
    assert names == set(licenses.KNOWN)


def test_clauses_marked_c_are_no_copyright_lines(spark, docs):
    base = "You may copy it if\n(a) you ask\n(b) you pay\n(c) {}\n(d) you leave."
    texts = [base.format("you sing"), base.format("you dance"), "(c) 2020 Someone\nbody text", "(c) <year> <name>\nbody text", "body text", "© me\nbody text", "Copyright Joyent, Inc.\n\nCopyright Others\n\nbody text"]
    got = {r.doc_id: r.digest for r in licenses.scan(docs([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got[0] != got[1] and len({got[i] for i in range(2, 7)}) == 1


def test_license_rows_agree_with_the_sql(spark, docs):
    """Every known text in several dresses, repeated rows and a very long text: the same rows by SQL."""
    import duckdb

    rows = []
    for texts in licenses.KNOWN.values():
        for t in texts:
            curly = t.replace('"', "\u201c").replace("'", "\u2019").replace(" ", "\u00a0")
            rows += [(len(rows), t, "en", "s"), (len(rows) + 1, "Copyright (c) 2020 X\n\nCopyright Joyent, Inc. and others\n\n" + curly, "en", "s"), (len(rows) + 1, t.upper() + "\nmore", "en", "s")]
    rows += [(9999, licenses.KNOWN["GPL-3.0"][0] * 30, "en", "s"), (9998, None, "en", "s"), (9997, "", "en", "s")]
    df = docs(rows)
    got = sorted(((r.doc_id, r.digest or "", r.license or "") for r in licenses.scan(df).collect()))
    assert sum(1 for r in got if r[2]) >= 2 * sum(map(len, licenses.KNOWN.values()))
    documents = df.select("doc_id", "text").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    sql = con.execute(licenses.ORACLE["op3_license_scan"]).fetchall()
    assert sorted((i, d or "", k or "") for i, d, k in sql) == got


def noise(rng, n=60):
    return " ".join("".join(rng.choice(["an", "th", "er", "on", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_quality_on_the_held_out_fold(spark, docs):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(240):
        text, good = noise(rng), i % 3 > 0
        if not good:
            text = {0: text.upper().replace(" ", "!! "), 1: text.replace(" ", " | "), 2: (text[:40] + " ") * 12}[i % 9 // 3]
        rows.append((i, text, "en", "s"))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    df = docs(rows)
    out = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels)).collect()}
    unseen = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((out[i] >= 0.7) == (i % 3 > 0) for i in unseen) / len(unseen) > 0.95


def test_trees_are_flat_arrays_of_small_nodes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.BoostedTrees(x, y)
    assert ((model.predict(x) > 0.5) == (y > 0)).mean() > 0.97
    assert len(model.feature) == len(model.limit) == len(model.child) == len(model.value)
    assert quality.BoostedTrees(x, np.ones(400)).predict(x).min() > 0.99


def test_statistics_of_odd_texts():
    x = quality.statistics([None, b"", b" \n", b"A bB!! a bB!!", b"w " * 50_000])
    name = {n: k for k, n in enumerate(quality.NAMES)}
    assert not x[0].any() and not x[1].any() and np.isfinite(x).all()
    assert x[3, name["distinct_words"]] == 0.75 and x[3, name["bangs_at_ends"]] == 0.5
    assert x[4, name["adjacent_repeats"]] == 49_999 / 50_000 and x[4, name["commonest_word"]] == 1


def test_statistics_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = "\n".join(noise(rng) + "!! AB," for _ in range(30)).encode()
    whole = quality.statistics([text])
    monkeypatch.setattr(quality, "CHUNK", 500)
    assert np.allclose(quality.statistics([text]), whole)


def shown_windows(text):
    units = toxicity.Units([text])
    return {units.text(k) for k in range(len(units))}


def test_windows_of_whole_words():
    units = toxicity.Units([toxicity.normal(b"You ass, hat! Never\nkys")])
    assert [units.text(k) for k in range(len(units))] == [b" you ass- hat ", b" ass- hat ", b" hat ", b" never ", b" kys "]
    long = toxicity.Units([toxicity.normal(b"ab " + b"x" * 100 + b" cd")])
    assert (long.end - long.start).max() <= toxicity.WINDOW + 2 and len(long) > 5
    seen = np.zeros(len(long.x), bool)
    for s, e in zip(long.start, long.end, strict=True):
        seen[s:e] = True
    assert seen[:-1].all()


def test_windows_do_not_depend_on_the_parts_of_a_text():
    rng = random.Random(3)
    for text in (noise(rng, 900), "! ".join(noise(rng, 7) for _ in range(80)), noise(rng, 300) + "z" * 900 + " " + noise(rng, 200), "b o z o n k " * 300):
        whole = toxicity.normal(text.encode())
        joined = set().union(*(shown_windows(p) for p in toxicity.parts(whole, 300)))
        assert shown_windows(whole) <= joined
        if "z" * 9 not in text:  # a part may end a window early, and then a longer one stands beside it
            assert all(any(w.strip() in v for v in shown_windows(whole)) for w in joined)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_odd_rows(spark, odd, empty, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = module.score(odd, module.fit(odd, labels)).select("doc_id", "score").collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(empty, module.fit(empty, some)).count() == 0


def test_toxicity_on_the_held_out_fold_and_with_gaps(spark, docs):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        text, bad = noise(rng), i % 4 == 0
        if bad:
            text += " " + rng.choice(["grimwald", "snarkle", "bozonk"]) + " " + noise(rng, 5)
        rows.append((i, text, "en", "s"))
        marks.append((i, 1, int(bad)))
    df, labels = docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((out[i] >= 0.7) == (i % 4 == 0) for i in unseen) / len(unseen) > 0.97
    gapped = [b"you grim.wald", b"a snar-kle", b"the b o z o n k here", b"Boz*onk!", b"GRIMWALD"]
    assert (model.score(gapped) >= 0.7).sum() >= 4
    assert (model.score([noise(rng).encode() for _ in range(50)]) < 0.7).all()


def brute_kernel(a, b):
    from itertools import combinations

    def grams(w):
        c = [int(toxicity._CLASS[x]) for x in w]
        out = {}
        for start in range(len(c)):
            for rest in combinations(range(start + 1, min(len(c), start + toxicity.SPAN)), 3):
                key = (c[start], *(c[i] for i in rest))
                out[key] = out.get(key, 0) + toxicity.DECAY ** (rest[-1] - start + 1)
        return out

    def norm(n):
        spans = [rest[-1] + 1 for rest in combinations(range(1, toxicity.SPAN), 3)]
        return sum(toxicity.DECAY ** (2 * s) * max(0, n - s + 1) for s in spans) ** 0.5

    x, y = grams(a), grams(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm(len(a)) / norm(len(b))


def test_sentence_kernel_matches_brute_force():
    texts = [b" clownish way ", b" clown ", b" abababab ", b" babababa ab ", b" cl.own it ", b" b o z o n k ", b" \xc3\xa9t\xc3\xa9 12 "]
    units = toxicity.whole(texts)
    k = toxicity.kernel(units, np.arange(len(texts)), units)
    for i, a in enumerate(texts):
        folded = units.sums(toxicity.fold(units, np.array([i]), np.ones(1)))
        for j, b in enumerate(texts):
            assert abs(k[i, j] - brute_kernel(a, b)) < 1e-5 and abs(folded[j] - brute_kernel(a, b)) < 1e-5


def test_short_insults_phrases_and_long_texts_count(spark, docs):
    """Insults of three letters, and of words that are harmless alone, in labelled texts of any length."""
    rng = random.Random(21)
    rows, marks = [], []
    for i in range(500):
        words, bad = noise(rng, rng.choice([40, 50, 60, 60, 40, 50, 60, 60, 40, 50, 60, 3000])).split(), i % 3 == 0
        both = ["zig", "vup"]
        at = rng.randrange(len(words) - 1)
        words[at + 1 : at + 1] = (["kyz"] if i % 2 else both) if bad else [both[i % 2]]
        rows.append((i, " ".join(words), "en", "s"))
        marks.append((i, 1, int(bad)))
    df, labels = docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    unseen = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    score = model.score([rows[i][1].encode() for i in unseen])
    assert np.mean((score >= 0.7) == np.array([i % 3 == 0 for i in unseen])) > 0.9
    assert model.score([b"kyz"])[0] >= 0.7 and model.score([b"the zig here", b"a vup there"]).max() < 0.7


def test_folds():
    assert held_out(F.lit("7"), 4, 2) is not None
