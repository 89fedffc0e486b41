"""Queries that apply the text, codec, bijection and value functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import bijections, codecs, text, values
from larkspur.plans.fixture import read, sql_slug

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("SELECT doc_id, md5(lower(hex(encode(text)))) AS digest FROM documents")
def hex_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(codecs.to_hex(F.encode("text", "UTF-8"))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents")
def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codecs.parse_hex(codecs.to_hex(F.encode("text", "UTF-8")))
    return read(spark, sf_dir, "documents").select("doc_id", back.alias("r")).select("doc_id", F.md5("r.value").alias("digest"), F.col("r.error").alias("error"))


@query("SELECT doc_id, md5(CASE WHEN text = '' THEN '' ELSE bin(text) END) AS digits, md5(text) AS back FROM documents")
def binary_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's binary digits and of the bytes read back from them."""
    digits = read(spark, sf_dir, "documents").select("doc_id", codecs.to_binary_digits(F.encode("text", "UTF-8")).alias("d"))
    return digits.select("doc_id", F.md5("d").alias("digits"), F.md5(codecs.parse_binary_digits(F.col("d"))["value"]).alias("back"))


_Z85 = codecs.Z85.replace("'", "''")
_HEX = "hex(encode(text))"
_NIBBLE = "(instr('0123456789ABCDEF', substr(rpad(substr(h, i * 8 + 1, 8), 8, '0'), {k}, 1)) - 1) * CAST({w} AS BIGINT)"
_WORD = " + ".join(_NIBBLE.format(k=k + 1, w=16 ** (7 - k)) for k in range(8))
_FIVE = " || ".join(f"substr('{_Z85}', CAST(w // {85**k} % 85 + 1 AS BIGINT), 1)" for k in (4, 3, 2, 1, 0))


@query(
    f"WITH t AS (SELECT doc_id, md5(text) AS back, {_HEX} AS h, octet_length(encode(text)) AS n FROM documents), "
    f"w AS (SELECT *, list_transform(range(0, (n + 3) // 4), lambda i: {_WORD}) AS words FROM t), "
    f"d AS (SELECT *, coalesce(array_to_string(list_transform(words, lambda w: {_FIVE}), ''), '') AS digits FROM w) "
    "SELECT doc_id, md5(left(digits, length(digits) - (4 - n % 4) % 4)) AS digits, back FROM d"
)
def z85_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text in Z85 and of the bytes read back."""
    digits = read(spark, sf_dir, "documents").select("doc_id", codecs.z85(F.encode("text", "UTF-8")).alias("d"))
    return digits.select("doc_id", F.md5("d").alias("digits"), F.md5(codecs.parse_z85(F.col("d"))["value"]).alias("back"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def mixed85_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each text, checked against the bound that its mixed encoding never exceeds Z85's length."""
    docs = read(spark, sf_dir, "documents")
    coded = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.length(codecs.mixed85(F.encode("text", "UTF-8"))).alias("n"))
    return coded.where(F.col("n") <= codecs.z85_length(F.col("size"))).select("doc_id", "size")


_B32 = codecs.BASE32_DIGITS
_TOKEN = " || ".join(f"substr('{_B32}', CAST((v >> {5 * k}) & 31 AS BIGINT) + 1, 1)" for k in range(11, -1, -1))
_LETTERED = " OR ".join(f"((v >> {5 * k}) & 31) >= 10" for k in range(4))


@query(
    f"WITH l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM range(1048576) t(v) WHERE {_LETTERED}), "
    "o AS (SELECT o_orderkey, o_orderkey * 97 - 50000 AS n, abs(o_orderkey * 97 - 50000) AS a FROM orders), "
    f"b AS (SELECT o_orderkey, n, a, coalesce(l.v, a) AS v FROM o LEFT JOIN l ON a >= 10000 AND a < {codecs.PLAIN_FROM} AND l.r = a - 10000), "
    f"t AS (SELECT o_orderkey, n, a, {_TOKEN} AS s FROM b) "
    "SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN a < 10000 THEN CAST(a AS VARCHAR) ELSE lpad(ltrim(s, '0'), CAST(greatest(4, length(ltrim(s, '0'))) AS INTEGER), '0') END AS token, n AS back FROM t"
)
def b1032_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "orders").select("o_orderkey", codecs.b1032(F.col("o_orderkey") * 97 - 50000).alias("token"))
    return tokens.select("o_orderkey", "token", codecs.parse_b1032(F.col("token"))["value"].alias("back"))


_BYTE = "(instr('0123456789ABCDEF', substr(h, i * 2 + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, i * 2 + 2, 1)) - 1"


@query(
    f"WITH t AS (SELECT doc_id, md5(text) AS back, {_HEX} AS h FROM documents), "
    f"b AS (SELECT doc_id, back, list_transform(range(0, length(h) // 2), lambda i: CAST({_BYTE} AS INTEGER)) AS bytes FROM t) "
    "SELECT doc_id, md5(coalesce(array_to_string(list_transform(bytes, lambda b: CASE WHEN b = 10 THEN '\\n' WHEN b = 9 THEN '\\t' WHEN b = 13 THEN '\\r' WHEN b = 92 THEN '\\\\' "
    "WHEN b >= 32 AND b < 127 THEN chr(b) ELSE printf('\\x%02X', b) END), ''), '')) AS escaped, back FROM b"
)
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text escaped and of the bytes read back."""
    shown = read(spark, sf_dir, "documents").select("doc_id", codecs.escaped(F.encode("text", "UTF-8")).alias("e"))
    return shown.select("doc_id", F.md5("e").alias("escaped"), F.md5(codecs.parse_escaped(F.col("e"))).alias("back"))


@query("SELECT doc_id, md5(to_base64(encode(text))) AS b64, md5(hex(encode(text))) AS b16 FROM documents")
def whole_block_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text in base 64 and 16."""
    data = F.encode("text", "UTF-8")
    spare = F.pmod(-F.octet_length(data), 3)
    padded = F.concat(codecs.encode_blocks(data, "base64"), F.when(spare == 1, "=").when(spare == 2, "==").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(padded).alias("b64"), F.md5(codecs.encode_blocks(data, "hex")).alias("b16"))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob_id FROM documents")
def blob_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", codecs.git_blob_id(F.encode("text", "UTF-8")).alias("blob_id"))


_RUN_TAG = int(codecs.TAGS["run"], 16) << 40


@query(
    f"SELECT o_orderkey, rtrim(translate(to_base64(unhex(lpad(hex(CAST({_RUN_TAG} AS UBIGINT) | CAST(o_orderkey AS UBIGINT)), 16, '0'))), '+/', '-_'), '=') AS global_id, "
    "CAST(o_orderkey AS BIGINT) AS id, 'run' AS kind FROM orders"
)
def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "orders").select("o_orderkey", codecs.global_id("run", F.col("o_orderkey")).alias("global_id"))
    return made.withColumn("r", codecs.parse_global_id(F.col("global_id"))).select("o_orderkey", "global_id", "r.id", "r.kind")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def escaped85_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codecs.parse_escaped85(codecs.escaped85(F.encode("text", "UTF-8")))["value"]
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("digest"))


@query("SELECT doc_id, md5(text) AS readable66, md5(text) AS readable92 FROM documents")
def readable_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    back = lambda base: F.md5(codecs.parse_readable(codecs.readable(data, base), base)["value"]).alias(f"readable{base}")
    return read(spark, sf_dir, "documents").select("doc_id", back("66"), back("92"))


# --- text ---------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({sql_slug('text')}) AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.slugify(F.col("text"))).alias("slug"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


_MS = "CAST(o_orderkey * 1237 AS BIGINT)"


@query(
    f"SELECT o_orderkey, {_MS} AS ms, CASE WHEN {_MS} = 0 THEN '-' ELSE CASE WHEN {_MS} >= 3600000 THEN printf('%dh%02dm%02d', {_MS} // 3600000, {_MS} // 60000 % 60, {_MS} // 1000 % 60) "
    f"WHEN {_MS} >= 60000 THEN printf('%dm%02d', {_MS} // 60000, {_MS} // 1000 % 60) ELSE printf('%d', {_MS} // 1000) END || CASE WHEN {_MS} % 1000 > 0 THEN printf('.%03d', {_MS} % 1000) ELSE '' END || 's' END AS shown FROM orders"
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO-8601 durations read as milliseconds and shown for people."""
    ms = F.col("o_orderkey") * 1237
    iso = F.format_string("P%dDT%dH%dM%d.%03dS", F.floor(ms / 86400000), F.floor(ms / 3600000) % 24, F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    read_back = read(spark, sf_dir, "orders").select("o_orderkey", text.duration_ms(iso).alias("ms"))
    return read_back.withColumn("shown", text.duration_text(F.col("ms")))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 + 43684 AS seconds FROM orders")
def date_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", text.epoch_at_noon(F.to_date("o_orderdate")).alias("seconds"))


@query(
    "SELECT p_partkey, len(list_filter(range(1, 4), lambda i: list_reduce(list_transform(range(1, i + 1), lambda j: CASE WHEN a[-j] = b[-j] THEN 1 ELSE 0 END), lambda x, y: x * y) = 1)) AS shared "
    "FROM (SELECT p_partkey, ['s' || (p_partkey % 3), 'd' || (p_partkey % 5), 'f' || (p_partkey % 2)] AS a, ['s0', 'd1', 'f1'] AS b FROM part)"
)
def path_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    path = F.format_string("s%d/d%d/f%d", key % 3, key % 5, key % 2)
    return read(spark, sf_dir, "part").select("p_partkey", text.path_similarity(path, F.lit("s0/d1/f1")).cast("long").alias("shared"))


@query("SELECT p_partkey, p_name || chr(10) AS raw, '\"' || p_name || '\\n\"' AS scalar, p_name AS plain FROM part")
def yaml_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat("p_name", F.lit("\n"))
    return read(spark, sf_dir, "part").select("p_partkey", broken.alias("raw"), text.yaml_scalar(broken).alias("scalar"), text.yaml_scalar(F.col("p_name")).alias("plain"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS commits, CAST(o_orderkey + 1 AS BIGINT) AS revision, CAST(o_orderkey % 65536 AS INTEGER) AS origin FROM orders")
def graph_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    commits = F.when(key % 2 == 0, F.concat(F.lit(" / n"), key.cast("string"))).otherwise("")
    message = F.concat(F.lit("r"), (key + 1).cast("string"), F.lit(" / g7"), commits, F.lit(" / o"), F.lpad(F.hex(key % 65536), 4, "0"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.graph_message(message).alias("m")).select("o_orderkey", "m.commits", "m.revision", "m.origin")


@query("SELECT c_custkey, 'say' AS first, c_name || ' it''s' AS second, CAST(3 AS BIGINT) AS words, 'dollar_sign' AS problem FROM customer")
def shell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("say '"), "c_name", F.lit("'\" it's\" $HOME"))
    split = read(spark, sf_dir, "customer").select("c_custkey", text.split_shell(line).alias("s"))
    word = lambda k: F.element_at("s.args", k).cast("string")
    return split.select("c_custkey", word(1).alias("first"), word(2).alias("second"), F.size("s.args").cast("long").alias("words"), F.element_at("s.errors.kind", 1).alias("problem"))


@query(
    "SELECT o_orderkey, strftime(make_timestamp(CAST((seconds + offset_minutes * 60) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN offset_minutes < 0 THEN '-' ELSE '+' END "
    "|| printf('%02d:%02d', abs(offset_minutes) // 60, abs(offset_minutes) % 60) AS iso, seconds, offset_minutes FROM "
    "(SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS seconds, CAST((o_orderkey % 53 - 26) * 30 AS INTEGER) AS offset_minutes FROM orders)"
)
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with offsets, written as ISO-8601 and read back."""
    seconds, offset = F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400, ((F.col("o_orderkey") % 53 - 26) * 30).cast("int")
    shown = read(spark, sf_dir, "orders").select("o_orderkey", text.zoned_text(seconds, offset).alias("iso"))
    return shown.select("o_orderkey", "iso", text.zoned_time(F.col("iso")).alias("t")).select("o_orderkey", "iso", "t.seconds", "t.offset_minutes")


# --- bijections -----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS zig_zag, x + 2147483648 AS unsigned FROM (SELECT o_orderkey, CAST(o_orderkey - 5000 AS BIGINT) AS x FROM orders)")
def integer_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_orderkey") - 5000
    return read(spark, sf_dir, "orders").select("o_orderkey", bijections.zig_zag(x, 32).alias("zig_zag"), bijections.signedness(x, 32).alias("unsigned"))


_BITS = " + ".join(f"((o_orderkey >> {k}) & 1) * {1 << 2 * k} + ((o_custkey >> {k}) & 1) * {2 << 2 * k}" for k in range(20))


@query(f"SELECT o_orderkey, CAST({_BITS} AS BIGINT) AS z, CAST(o_orderkey AS BIGINT) AS x, CAST(o_custkey AS BIGINT) AS y FROM orders")
def z_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = read(spark, sf_dir, "orders").select("o_orderkey", bijections.z_order(F.col("o_orderkey"), F.col("o_custkey")).alias("z"))
    return z.withColumn("p", bijections.z_order_inverse(F.col("z"))).select("o_orderkey", "z", "p.x", "p.y")


def _points(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        forward, back = getattr(bijections, name), getattr(bijections, f"{name}_inverse")
        points = read(spark, sf_dir, "orders").select("o_orderkey", forward(F.col("o_orderkey") * 131).alias("p"))
        return points.select("o_orderkey", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"), back(F.col("p.x"), F.col("p.y")).cast("long").alias("back"))

    return run


_U = "SELECT o_orderkey, CAST(o_orderkey * 131 AS BIGINT) AS u FROM orders"
_RESULT = "SELECT o_orderkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(u AS BIGINT) AS back"
#: Shells of an index below the cut edge: number, first index, points.
_SQUARE = f"SELECT *, CASE WHEN m = 0 THEN 0 ELSE (2 * m - 1) * (2 * m - 1) END AS base, CASE WHEN m = 0 THEN 1 ELSE 8 * m END AS size FROM (SELECT *, CAST((CAST(floor(sqrt(u)) AS BIGINT) + 1) // 2 AS BIGINT) AS m FROM ({_U}))"
_TRIANGLE = f"SELECT *, m * (2 * m - 1) AS base, 4 * m + 1 AS size FROM (SELECT *, CAST(floor((1 + sqrt(1 + 8 * u)) / 4) AS BIGINT) AS m FROM ({_U}))"


def _scattered_sql(shells: str) -> str:
    """SQL rows of shells with j: the scattered place of each index in its shell, walked until it is inside."""
    big, wide = "18446744073709551616::UHUGEINT", "UHUGEINT"

    def mixed(rows: str, z: str, out: str) -> str:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            rows = f"SELECT * EXCLUDE (z), CAST(CAST(xor(z, z >> {shift}) AS {wide}) * {factor}::{wide} % {big} AS UBIGINT) AS z FROM ({rows})" if z == "z" else (
                f"SELECT *, CAST(CAST(xor({z}, ({z}) >> {shift}) AS {wide}) * {factor}::{wide} % {big} AS UBIGINT) AS z FROM ({rows})"
            )
            z = "z"
        return f"SELECT * EXCLUDE (z), z AS {out} FROM ({rows})"

    keyed = mixed(f"SELECT *, CAST(CAST(m AS {wide}) * {bijections.LAYER_KEY}::{wide} % {big} AS UBIGINT) AS layer FROM ({shells})", "layer", "key")
    start = f"SELECT o_orderkey, u, m, CAST(size AS UBIGINT) AS size, key, half, (1::UBIGINT << half) - 1 AS mask, CAST(u - base AS UBIGINT) AS v, FALSE AS done FROM (SELECT *, CASE WHEN size = 1 THEN 0::UBIGINT ELSE CAST((length(bin(CAST(size - 1 AS UBIGINT))) + 1) // 2 AS UBIGINT) END AS half FROM ({keyed}))"
    rows = "SELECT *, (v >> half) & mask AS l, v & mask AS r FROM w WHERE NOT done"
    for k in range(bijections.ROUNDS):
        rows = mixed(rows, f"xor(xor(r, key), {bijections.ROUND_KEY * k % 2**64}::UBIGINT)", "f")
        rows = f"SELECT * EXCLUDE (l, r, f), r AS l, xor(l, f & mask) AS r FROM (SELECT *, f & mask AS g FROM ({rows}))".replace("f & mask) AS r", "g) AS r").replace("EXCLUDE (l, r, f)", "EXCLUDE (l, r, f, g)")
    step = f"SELECT o_orderkey, u, m, size, key, half, mask, (l << half) | r AS v, ((l << half) | r) < size AS done FROM ({rows})"
    return f"WITH RECURSIVE w AS ({start} UNION ALL {step}) SELECT o_orderkey, u, m, CAST(v AS BIGINT) AS j FROM w WHERE done"


def _hilbert_sql(bits: int = 16) -> str:
    rows = f"SELECT *, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y FROM ({_U})"
    for level in range(bits):
        side = 1 << level
        rows = f"SELECT *, (u >> {2 * level + 1}) & 1 AS rx, xor((u >> {2 * level}) & 1, (u >> {2 * level + 1}) & 1) AS ry FROM ({rows})"
        rows = f"SELECT * EXCLUDE (x, y), CASE WHEN ry = 0 AND rx = 1 THEN {side - 1} - x ELSE x END AS x, CASE WHEN ry = 0 AND rx = 1 THEN {side - 1} - y ELSE y END AS y FROM ({rows})"
        rows = f"SELECT * EXCLUDE (x, y, rx, ry), CASE WHEN ry = 0 THEN y ELSE x END + {side} * rx AS x, CASE WHEN ry = 0 THEN x ELSE y END + {side} * ry AS y FROM ({rows})"
    return f"{_RESULT} FROM ({rows})"


_AROUND = "SELECT *, j % greatest(2 * m, 1) AS s, j // greatest(2 * m, 1) AS e FROM (SELECT *, u - base AS j FROM ({rows}))"
_HALF_WAY = "CASE WHEN j <= 2 * m THEN m - j ELSE -m END AS x, CASE WHEN j <= 2 * m THEN m ELSE 3 * m - j END AS y"
for _name, _sql in {
    "spiral_square": f"{_RESULT} FROM (SELECT *, CASE WHEN m = 0 THEN 0 WHEN e = 0 THEN m WHEN e = 1 THEN m - 1 - s WHEN e = 2 THEN -m ELSE 1 - m + s END AS x, "
    f"CASE WHEN m = 0 THEN 0 WHEN e = 0 THEN 1 - m + s WHEN e = 1 THEN m WHEN e = 2 THEN m - 1 - s ELSE -m END AS y FROM ({_AROUND.format(rows=_SQUARE)}))",
    "spiral_triangle": f"{_RESULT} FROM (SELECT *, {_HALF_WAY} FROM (SELECT *, u - base AS j FROM ({_TRIANGLE})))",
    "hilbert": _hilbert_sql(),
    "scatter_square": f"{_RESULT} FROM (SELECT *, CASE WHEN m = 0 THEN 0 WHEN e = 0 THEN s - m WHEN e = 1 THEN m WHEN e = 2 THEN m - s ELSE -m END AS x, CASE WHEN m = 0 THEN 0 WHEN e = 0 THEN m WHEN e = 1 THEN m - s WHEN e = 2 THEN -m ELSE s - m END AS y "
    f"FROM (SELECT *, j % greatest(2 * m, 1) AS s, j // greatest(2 * m, 1) AS e FROM ({_scattered_sql(_SQUARE)})))",
    "scatter_triangle": f"{_RESULT} FROM (SELECT *, {_HALF_WAY} FROM ({_scattered_sql(_TRIANGLE)}))",
}.items():
    QUERIES[f"{_name}_points"] = _points(_name)
    ORACLE[f"{_name}_points"] = _sql


@query("SELECT event_id, value AS back, CAST(row_number() OVER (ORDER BY value, event_id) AS BIGINT) AS place FROM events")
def float_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles through their ordered integers, and their places by those (ranked by ranges, not in one task)."""
    rows = read(spark, sf_dir, "events").select("event_id", bijections.double_order(F.col("value") - 50).alias("u"))
    rows = rows.withColumn("back", bijections.double_from_order(F.col("u")) + 50).withColumn("back", F.round("back", 2))
    part = F.floor(F.col("back") / 10)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # one row for each range of values
    ranked = rows.withColumn("part", part).join(starts, "part")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("u", "event_id"))
    return ranked.select("event_id", "back", place.alias("place"))


# --- values ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'string_map' AS kind FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = read(spark, sf_dir, "events").withColumn("v", F.parse_json("props"))
    return parsed.select("event_id", F.variant_get("v", "$.k", "long").alias("k"), values.value_kind(F.col("props")).alias("kind"))


@query("SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS place FROM events")
def value_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by the total order of their JSON values."""
    keyed = read(spark, sf_dir, "events").withColumn("key", values.value_order(F.col("props")))
    return keyed.select("event_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy("key")).cast("long").alias("place"))


@query("SELECT o_orderkey, CAST(CAST(x AS DOUBLE) AS HUGEINT) = x AS exact FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 9007199254741 AS x FROM orders)")
def exact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", values.exact(F.col("o_orderkey") * F.lit(9007199254741)).alias("exact"))


@query("SELECT event_id, event_type AS got, TRUE AS has, CAST(2 AS INTEGER) AS n FROM events")
def ordered_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    rows = read(spark, sf_dir, "events").withColumn("m", F.array(entry("user", F.col("user_id").cast("string")), entry("type", F.col("event_type"))))
    return rows.select("event_id", values.map_get(F.col("m"), "type").alias("got"), values.map_contains(F.col("m"), "user").alias("has"), F.size(values.map_keys(F.col("m"))).alias("n"))
