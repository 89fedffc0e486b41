import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text, lang, source) rows, with columns whose names clash with results."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)
        if extra:
            for name in ("score", "fp", "lang_pred", "component_id", "shard", "slot", "size", "label", "cell"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "word", "en", "a"), (5, "word", "en", "b"), (6, "éà ü 漢字", "fr", ""),
    (7, "same same same same same same", "en", "a"), (7, "same same same same same same", "en", "a"), (None, "no id here at all", "en", None),
    (8, "long " * 40_000, "en", "a"), (9, "x" * 100_000, "de", "b"), (10, "!!! ??? 12345", "de", "b"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD, extra=True)


@pytest.fixture
def empty(docs):
    return docs([])


@pytest.fixture
def table_dir(tmp_path):
    """Write DataFrames as the tables of a directory that queries read."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
