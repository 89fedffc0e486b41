import base64
import hashlib

from larkspur.plans import catalog


def test_block_encodings_of_whole_texts(spark, tmp_path):
    texts = ["", "a", "ab", "same start of more than thirty characters, end one", "same start of more than thirty characters, end 2", "é漢字 " * 5000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.b64, r.b16) for r in catalog.queries()["whole_block_encodings"](spark, str(tmp_path)).collect()}
    digest = lambda b: hashlib.md5(b).hexdigest()
    want = {i: (None, None) if t is None else (digest(base64.b64encode(t.encode())), digest(t.encode().hex().upper().encode())) for i, t in enumerate(texts)}
    assert got == want
