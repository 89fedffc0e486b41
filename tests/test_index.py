from pyspark.sql import functions as F

from larkspur.sources import readers


def test_index_by_a_new_key(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "b", 0), (4, None, 1)], "id long, slug string, ok int")
    got = {r.key: r.ids for r in readers.index_where(df, F.col("slug"), F.col("ok") == 1).collect()}
    assert got == {"a": [1, 3]}
