import random

import corpus_pipeline as pipeline

from larkspur.llm import shingle_dedup as D


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited_texts(seed=5):
    """Families of an original and copies with a few words changed, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    out = []
    for _ in range(20):
        words = [word() for _ in range(rng.randint(60, 300))]
        out.append(" ".join(words))
        for _ in range(5):
            changed = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                changed[rng.randrange(len(words))] = word()
            out.append(" ".join(changed))
    return out


def brute_groups(texts):
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if label[i] != label[j] and jaccard(a, texts[j]) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_stage_keeps_one_of_each_group_of_similar_texts(spark, docs):
    texts = edited_texts()
    df = docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    label = brute_groups(texts)
    assert 20 < len(set(label)) < 80
    got = {r.doc_id: r.group for r in D.near_duplicates(df).collect()}
    least = {}
    for i in sorted(got):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == label
    assert sorted(r.doc_id for r in pipeline.one_of_each_group(spark, df, "").collect()) == sorted(set(label))


def test_large_buckets_in_blocks_and_rows_without_ids(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_ROWS", 3)
    texts = edited_texts(6)[:60]
    df = docs([(None, t, "en", "s") for t in texts])
    kept = [r.text for r in pipeline.one_of_each_group(spark, df, "").collect()]
    label = dict(zip(texts, brute_groups(texts), strict=True))
    assert sorted(label[t] for t in kept) == sorted(set(label.values()))


def test_a_long_text_in_parts_has_the_same_set(monkeypatch):
    from larkspur.llm import common

    text = edited_texts()[0].encode()
    whole = D.shingle_set(text).tolist()
    monkeypatch.setattr(common, "SEGMENT", 50)
    assert D.shingle_set(text).tolist() == whole and len(whole) == len(grams(text.decode()))
