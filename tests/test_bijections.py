import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import bijections as B


def pairs(spark, column, n=1 << 16):
    return [(r.p.x, r.p.y) for r in spark.range(n).select("id", column(F.col("id")).alias("p")).orderBy("id").collect()]


def test_signedness_and_zig_zag(spark):
    rows = spark.range(-128, 128).select(
        "id", B.signedness(F.col("id"), 8).alias("u"), B.signedness(B.signedness(F.col("id"), 8), 8, False).alias("s"),
        B.zig_zag(F.col("id"), 8).alias("z"), B.zig_zag_inverse(B.zig_zag(F.col("id"), 8)).alias("b"),
    ).collect()
    assert [r.u for r in rows] == list(range(256)) and all(r.s == r.id == r.b for r in rows)
    z = {r.id: r.z for r in rows}
    assert [z[k] for k in (0, -1, 1, -2, 127, -128)] == [0, 1, 2, 3, 254, 255]
    wide = spark.createDataFrame([(-(2**63),), (0,), (2**63 - 1,)], ["x"])
    assert [int(r[0]) for r in wide.select(B.signedness(F.col("x"), 64)).collect()] == [0, 2**63, 2**64 - 1]


def test_floats_keep_their_total_order(spark):
    values = [-math.inf, -1e308, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], ["x"]).select("x", B.double_order(F.col("x")).alias("u"))
    rows = df.select("x", "u", B.double_from_order(F.col("u")).alias("y")).collect()
    assert [int(r.u) for r in rows] == sorted(int(r.u) for r in rows) and len({int(r.u) for r in rows}) == len(values)
    assert all(r.x == r.y and math.copysign(1, r.x) == math.copysign(1, r.y) for r in rows)
    small = spark.createDataFrame([(-1.5,), (-0.0,), (0.0,), (2.5,)], "x float").select("x", B.float_order(F.col("x")).alias("u"))
    got = small.select("x", "u", B.float_from_order(F.col("u")).alias("y")).collect()
    assert [r.u for r in got] == sorted(r.u for r in got) and all(r.x == r.y for r in got)


def test_z_order(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (3, 5), (2**32 - 1, 0), (2**32 - 1, 2**32 - 1), (123456789, 987654321)], "x long, y long")
    rows = df.select("x", "y", B.z_order(F.col("x"), F.col("y")).alias("u")).select("*", B.z_order_inverse(F.col("u")).alias("p")).collect()
    assert [r.u for r in rows[:4]] == [0, 1, 2, 0b100111]
    assert all((r.p.x, r.p.y) == (r.x, r.y) for r in rows)


@pytest.mark.parametrize("name", ["hilbert", "spiral_square", "scatter_square"])
def test_square_curves_are_bijections(spark, name):
    forward, back = getattr(B, name), getattr(B, f"{name}_inverse")
    rows = spark.range(1 << 16).select("id", forward(F.col("id"), 8).alias("p")).select("id", "p", back(F.col("p.x"), F.col("p.y"), 8).alias("u")).collect()
    assert all(r.u == r.id for r in rows)
    low = 0 if name == "hilbert" else -128
    assert {(r.p.x, r.p.y) for r in rows} == {(x, y) for x in range(low, low + 256) for y in range(low, low + 256)}


@pytest.mark.parametrize("name", ["spiral_triangle", "scatter_triangle"])
def test_triangle_curves_are_bijections(spark, name):
    forward, back = getattr(B, name), getattr(B, f"{name}_inverse")
    rows = spark.range(32896).select("id", forward(F.col("id"), 8).alias("p")).select("id", "p", back(F.col("p.x"), F.col("p.y"), 8).alias("u")).collect()
    assert all(r.u == r.id for r in rows)
    assert {(r.p.x, r.p.y) for r in rows} == {(x, y) for y in range(-128, 128) for x in range(-128, y + 1)}


def test_spirals_grow_by_shells(spark):
    square = pairs(spark, lambda c: B.spiral_square(c, 8), 65025)
    shells = [max(abs(x), abs(y)) for x, y in square]
    assert shells == sorted(shells) and square[:4] == [(0, 0), (1, 0), (1, 1), (0, 1)]
    triangle = pairs(spark, lambda c: B.spiral_triangle(c, 8), 32640)
    assert triangle[:6] == [(0, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def test_hilbert_neighbours_are_adjacent(spark):
    curve = pairs(spark, lambda c: B.hilbert(c, 8))
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(curve, curve[1:], strict=False))


def test_scattered_shells_keep_the_perimeter_s_order():
    """Undoing the permutation of a shell leaves its perimeter, clockwise from (-m, m)."""
    import numpy as np

    m = 3
    u = np.arange((2 * m - 1) ** 2, (2 * m + 1) ** 2)
    x, y = B.scatter_square_points(u, 8)
    j = B.scatter(u - u[0], np.full(8 * m, 8 * m), np.full(8 * m, m)).astype(int)
    walk = [(k - m, m) for k in range(2 * m)] + [(m, m - k) for k in range(2 * m)] + [(m - k, -m) for k in range(2 * m)] + [(-m, k - m) for k in range(2 * m)]
    assert [walk[k] for k in j] == list(zip(x.tolist(), y.tolist(), strict=True))
