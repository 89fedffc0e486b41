import inspect

from pyspark.sql import functions as F

from larkspur.functions import codecs as C


def test_base64_and_digits_run_no_python(spark):
    df = spark.createDataFrame([("é漢字 " * 500,)], "t string").select(F.encode("t", "UTF-8").alias("b"))
    out = df.select(C.encode_blocks(F.col("b"), "base64").alias("a"), C.encode_blocks(F.col("b"), "base64_url").alias("u"), C.parse_binary_digits(C.to_binary_digits(F.col("b")))["value"].alias("d"), "b")
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert row.a == C.block_encode(bytes(row.b), *C.ALPHABETS["base64"]) and row.u == C.block_encode(bytes(row.b), *C.ALPHABETS["base64_url"]) and row.d == row.b


def test_values_are_converted_a_slice_at_a_time(spark):
    df = spark.range(1000).select(F.concat(F.lit("é\\ \n"), "id").alias("t"))
    plan = df.select(C.escaped(F.encode("t", "UTF-8")), C.z85(F.encode("t", "UTF-8")))._jdf.queryExecution().analyzed().toString()
    assert "run(" in plan and C._AT_ONCE < 1000
    back = df.select("t", C.parse_escaped(C.escaped(F.encode("t", "UTF-8"))).alias("e"), C.parse_z85(C.z85(F.encode("t", "UTF-8")))["value"].alias("z"))
    assert all(bytes(r.e).decode() == bytes(r.z).decode() == r.t for r in back.collect())


def test_readable_and_escaped_runs_are_read_in_place():
    assert "text[at:])" not in inspect.getsource(C.readable_decode).replace("_plain_bytes(base, text[at:])", "")
    data = b"word and \xc3\xa9, " * 20_000
    for base in C.READABLE:
        assert C.readable_decode(C.readable_encode(data, base), base) == data
    assert C.escaped85_decode(C.escaped85_encode(data)) == data
