import os

import pytest
from pyspark.sql import functions as F

from larkspur.functions import codecs as C


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()["r"]


def test_hex_and_binary_digits(spark):
    df = spark.createDataFrame([("0aFF",), (" 0 a\nff ",), ("abc",), ("zz",), ("",)], ["s"]).select(C.parse_hex(F.col("s")).alias("r"))
    got = [(None if r.r.value is None else bytes(r.r.value), r.r.error) for r in df.collect()]
    assert got == [(b"\x0a\xff", None), (b"\x0a\xff", None), (None, "odd number of hex digits"), (None, "invalid hex digit"), (b"", None)]
    df = spark.createDataFrame([("00001010 11111111",), ("0101",), ("00000002",), ("",)], ["s"]).select(C.parse_binary_digits(F.col("s")).alias("r"))
    got = [(None if r.r.value is None else bytes(r.r.value), r.r.error) for r in df.collect()]
    assert got == [(b"\x0a\xff", None), (None, "number of bits is not a multiple of 8"), (None, "invalid binary digit"), (b"", None)]
    every = bytes(range(256))
    assert one(spark, C.to_binary_digits(F.col("b")), b=every) == "".join(f"{b:08b}" for b in every)
    assert one(spark, C.to_hex(F.col("b")), b=every) == every.hex()


@pytest.mark.parametrize("number,text", [(1, "00000001"), (35, "0000000z"), (45360, "00000z00"), (36**8 - 1, "zzzzzzzz")])
def test_base36(spark, number, text):
    assert one(spark, C.base36_encode(F.col("n")), n=number) == text
    assert one(spark, C.base36_decode(F.col("s")), s=text).value == number


def test_base36_errors(spark):
    assert one(spark, C.base36_decode(F.col("s")), s="").error == "wrong length"
    assert one(spark, C.base36_decode(F.col("s")), s="0000000Z").error == "invalid digit"


IDS = {"game": ["gamcAAAAAAA", "gamekNdA__8"], "user": ["usrgAAAAAAA", "usrikNdA__8"], "run": ["runoAAAAAAA", "runqkNdA__8"], "level": ["lvlIAAAAAAA", "lvlKkNdA__8"], "category": ["cat4AAAAAAA", "cat6kNdA__8"]}


@pytest.mark.parametrize("kind", IDS)
def test_global_ids(spark, kind):
    for number, text in zip((0, 36**8 - 1), IDS[kind], strict=True):
        assert one(spark, C.global_id(kind, F.col("n")), n=number) == text
        back = one(spark, C.parse_global_id(F.col("s")), s=text)
        assert (back.kind, back.id) == (kind, number)
    assert one(spark, C.parse_global_id(F.col("s")), s="nonsense") is None


def test_z85_vectors():
    for text, data in (("00000", "00000000"), ("00010", "00000055"), ("%nSc0", "FFFFFFFF"), ("%nSb#", "FFFFFFFE")):
        assert C.z85_encode(bytes.fromhex(data)) == text
        assert C.z85_decode(text).hex().upper() == data
    for bad in ("#####", "%nSc1", "0000_", "0000,", "0"):
        with pytest.raises(ValueError):
            C.z85_decode(bad)


def test_z85_round_trip_of_every_tail(spark):
    for n in range(30):
        data = os.urandom(n)
        assert C.z85_decode(C.z85_encode(data)) == data
        assert len(C.z85_encode(data)) == one(spark, C.z85_length(F.col("n")), n=n)
        assert one(spark, C.z85_decoded_length(F.col("n")), n=len(C.z85_encode(data))) == n
    for b in range(256):
        assert C.z85_decode(C.z85_encode(bytes([b]))) == bytes([b])
    assert bytes(one(spark, C.parse_z85(C.z85(F.col("b"))), b=b"\x00\x01raw").value) == b"\x00\x01raw"


def test_mixed85_keeps_printable_runs():
    assert C.mixed85_encode(b"text") == "|text"
    assert C.mixed85_encode(b"long text") == "0|long text"
    assert C.mixed85_encode(b"\x00\x00\x00\x00") == "00000"
    mixed = C.mixed85_encode(b"abcdefgh\x00\x01\x02\x03")
    assert mixed.startswith("1|abcdefgh") and len(mixed) == 15
    assert C.mixed85_encode(b"abcd\xff\xff\xff\xff") == "|abcd%nSc0"


def test_b1032(spark):
    for number, token in ((42, "42"), (9999, "9999"), (10_000, "000A"), (1_000_000, "UGI0"), (-10_000, "-000A"), (-42, "-42"), (2**20, "10000")):
        assert C.b1032_encode(number) == token
        assert C.b1032_decode(token.lower()) == number
    for n in [*range(9990, 10_300), *range(304_000, 305_000), 2**63 - 1, -(2**63)]:
        assert C.b1032_decode(C.b1032_encode(n)) == n
    for bad in ("", "W", "-", "VVVVVVVVVVVVVV", "1.5"):
        with pytest.raises(ValueError):
            C.b1032_decode(bad)
    assert one(spark, C.parse_b1032(C.b1032(F.col("n"))), n=123_456).value == 123_456


def test_escaped_text_and_masked_hex(spark):
    every = bytes(range(256))
    assert C.text_to_bytes(C.bytes_to_text(every)) == every
    assert C.bytes_to_text(b"a\n\t\r\\\x00\xff") == "a\\n\\t\\r\\\\\\x00\\xFF"
    assert C.text_to_bytes("bad \\q") is None and C.text_to_bytes("é") is None
    assert C.masked_hex("0x1_ f") == (b"\x10\xf0", b"\xf0\xf0")
    got = one(spark, C.parse_masked_hex(F.col("s")), s="A_")
    assert (bytes(got.bytes), bytes(got.mask)) == (b"\xa0", b"\xf0")


def test_block_encodings(spark):
    assert C.block_encode(b"foobar", *C.ALPHABETS["base32"]) == "MZXW6YTBOI"
    assert C.block_encode(b"fooba", *C.ALPHABETS["base64"]) == "Zm9vYmE"
    assert one(spark, C.encode_blocks(F.col("b"), "hex"), b=b"\x01\xab") == "01AB"
    assert one(spark, C.encode_blocks(F.col("b"), "z85"), b=b"\x00\x00\x00U") == "00010"


def test_object_ids(spark):
    assert one(spark, C.git_blob_id(F.col("b")), b=b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    empty = one(spark, C.git_tree_id(F.array().cast("array<struct<mode:string,name:string,id:string>>")), b=b"")
    assert empty == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


@pytest.mark.parametrize("base", ["66", "92"])
def test_readable_encodings(spark, base):
    import random

    rng = random.Random(8)
    for _ in range(400):
        data = b"".join(rng.choice([b"abc", b"word-", bytes([rng.randrange(256)]), b"~.", b"x" * rng.randrange(40)]) for _ in range(rng.randrange(12)))
        text = C.readable_encode(data, base)
        assert C.readable_decode(text, base, strict=True) == data
        assert len(text) == len(C._plain_digits(base, data))
    assert C.readable_decode(C.readable_encode(b"a" * 5000, base), base) == b"a" * 5000
    assert bytes(one(spark, C.parse_readable(C.readable(F.col("b"), base), base), b=b"abc\x00def").value) == b"abc\x00def"
    with pytest.raises(ValueError):
        C.readable_decode("~", base) if base == "92" else C.readable_decode("A", base)


def test_readable_vectors():
    assert C.readable_encode(b"abc", "66") == "~abc" and C.readable_encode(b"abcdef", "66") == "..abcdef"
    assert C.readable_encode(b"abcdefghi", "66") == ".3.abcdefghi" and C.readable_encode(b"abcdefghijkl", "66") == ".4.abcdefghijkl."
    assert C.readable_encode(b"abcd", "92") == "~abcd" and C.readable_encode(b"abcdefgh", "92") == "||abcdefgh"
    assert C.readable_encode(b"abcdefghijklmnop", "92") == "|4|abcdefghijklmnop|" and C.readable_encode(b"x" * 20, "92") == "|5|" + "x" * 20 + ".."


def test_escaped85_round_trip(spark):
    import random

    assert C.escaped85_encode(b"") == "" and C.escaped85_encode(b"abc") == "`abc." and C.escaped85_encode(b"abcdefg") == "_abcdefg.."
    assert C.escaped85_encode(b"\x00\x00\x00\x00") == "00000" and C.escaped85_encode(b"\x01abcd") == "1,abcd...."
    assert C.escaped85_encode(b"\xff") == "30" and C.escaped85_decode("30") == b"\xff"
    rng = random.Random(6)
    for _ in range(600):
        data = b"".join(rng.choice([b"abc", b"safe run!", bytes([rng.randrange(256)]), b"\x00", b"\x54", b"x" * rng.randrange(20)]) for _ in range(rng.randrange(10)))
        assert C.escaped85_decode(C.escaped85_encode(data)) == data
    assert bytes(one(spark, C.parse_escaped85(C.escaped85(F.col("b"))), b=b"\x00raw bytes\x01").value) == b"\x00raw bytes\x01"
    for bad in ("%nSc1", "a_", "abcd_", "_abc", "\u00e9aaaa"):
        with pytest.raises(ValueError):
            C.escaped85_decode(bad)


def test_base42_lengths():
    assert C.base42_digits(50) == "2P" and C.base42_length("2P", True) == (50, True)
    for n in (0, 8, 10, 42, 50, 100, 1000, 10_000, 42**4 - 1):
        assert C.base42_length(C.base42_digits(n), True)[0] == n
    for n in (8, 20, 50, 800):
        for little in (True, False):
            assert C.base42_length(C.base42_digits(n, little), False) == (n, little)
    with pytest.raises(ValueError):
        C.base42_digits(5)
    assert C.escaped85_decode("9|abcdefgh") == b"abcdefgh" and C.escaped85_decode("1|to the end") == b"to the end"
