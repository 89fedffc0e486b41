"""Order-preserving and space-filling bijections between integers, floats and pairs.

Widths up to 32 bits are LONG; unsigned 64-bit values are DECIMAL(20,0). Curves map an unsigned integer of
2w bits to a pair of w-bit coordinates. Straight arithmetic is a column expression; iterated bit work runs in
Arrow UDFs over numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- integers and floats ------------------------------------------------------------------------------


def signedness(x: Column, bits: int, signed: bool = True) -> Column:
    """Order-preserving map of signed to unsigned integers (signed=True) or back."""
    if bits < 64:
        return x.cast("long") + (1 if signed else -1) * (1 << (bits - 1))
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return (x.cast("decimal(20,0)") + half).cast("decimal(20,0)") if signed else (x.cast("decimal(20,0)") - half).cast("long")


def zig_zag(x: Column, bits: int) -> Column:
    """Signed to unsigned with small magnitudes first: 0, -1, 1, -2, ... (bits below 64)."""
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63)).bitwiseAND((1 << bits) - 1)


def zig_zag_inverse(u: Column) -> Column:
    u = u.cast("long")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def _ordered_bits(values: np.ndarray, uint, sint) -> np.ndarray:
    bits = values.view(uint)
    width = bits.dtype.itemsize * 8
    return np.where(bits >> uint(width - 1), ~bits, bits | uint(1 << (width - 1)))


@F.pandas_udf(T.DecimalType(20, 0))
def double_order(x: pd.Series) -> pd.Series:
    """Unsigned 64-bit integers in the total order of doubles, -0.0 below 0.0 and NaNs at the ends."""
    from decimal import Decimal

    null, bits = x.isna() & ~x.map(lambda v: v is not None and v != v), _ordered_bits(x.to_numpy(np.float64), np.uint64, np.int64)
    return pd.Series([None if n else Decimal(int(b)) for n, b in zip(null, bits, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def double_from_order(u: pd.Series) -> pd.Series:
    """Inverse of double_order."""
    bits = np.array([0 if v is None else int(v) for v in u], np.uint64)
    raw = np.where(bits >> np.uint64(63), bits & np.uint64(2**63 - 1), ~bits)
    return pd.Series(raw.view(np.float64)).where(u.notna(), None)


@F.pandas_udf(T.LongType())
def float_order(x: pd.Series) -> pd.Series:
    """The same for 32-bit floats, as LONG."""
    return pd.Series(_ordered_bits(x.to_numpy(np.float32), np.uint32, np.int32).astype(np.int64))


@F.pandas_udf(T.FloatType())
def float_from_order(u: pd.Series) -> pd.Series:
    bits = u.to_numpy(np.int64).astype(np.uint32)
    return pd.Series(np.where(bits >> np.uint32(31), bits & np.uint32(2**31 - 1), ~bits).view(np.float32))


# --- Z order --------------------------------------------------------------------------------------------

#: Shifts and masks that spread the low 32 bits over the even bits.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(x: Column) -> Column:
    x = x.cast("long")
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(_SPREAD[-1][1])
    for (shift, _), (_, mask) in zip(_SPREAD[::-1], [*_SPREAD[-2::-1], (0, 0x00000000FFFFFFFF)], strict=True):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(mask)
    return x


def z_order(x: Column, y: Column) -> Column:
    """Interleaved bits of two unsigned 32-bit values, x in the even ones; a LONG's bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def z_order_inverse(u: Column) -> Column:
    u = u.cast("long")
    return F.struct(_gather(u).alias("x"), _gather(F.shiftrightunsigned(u, 1)).alias("y"))


# --- shells around the origin ---------------------------------------------------------------------------


def isqrt(n: Column) -> Column:
    """Floor of the square root of a LONG, corrected for the double's rounding."""
    return let(F.floor(F.sqrt(n.cast("double"))).cast("long"), lambda r: F.when(r * r > n, r - 1).when((r + 1) * (r + 1) <= n, r + 1).otherwise(r))


def spiral_square(u: Column, bits: int = 16) -> Column:
    """struct(x, y) of signed w-bit coordinates by square shells; counter-clockwise from (m, 1 - m).

    The coordinates -2 ** (w - 1), whose shells are cut, follow at the end: the column, then the row.
    """
    return let(u.cast("long"), lambda u: let(F.ceil(isqrt(u) / 2).cast("long"), lambda m: _square_point(u, m, bits)))


def _square_point(u: Column, m: Column, bits: int) -> Column:
    low, side = -(1 << (bits - 1)), 1 << bits
    inner = (side - 1) * (side - 1)
    x, y = _on_square(m, u - (2 * m - 1) * (2 * m - 1))
    rest = u - inner
    edge = F.when(rest < side, F.struct(F.lit(low).cast("long").alias("x"), (rest + low).alias("y"))).otherwise(
        F.struct((rest - side + low + 1).alias("x"), F.lit(low).cast("long").alias("y"))
    )
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    return F.when(u == 0, start).when(u < inner, F.struct(x.alias("x"), y.alias("y"))).otherwise(edge)


def _on_square(m: Column, j: Column) -> tuple[Column, Column]:
    """Point j of the 8m points with max(|x|, |y|) = m."""
    step, k = j % (2 * m), F.floor(j / (2 * m))
    x = F.when(k == 0, m).when(k == 1, m - 1 - step).when(k == 2, -m).otherwise(1 - m + step)
    y = F.when(k == 0, 1 - m + step).when(k == 1, m).when(k == 2, m - 1 - step).otherwise(-m)
    return x, y


def spiral_square_inverse(x: Column, y: Column, bits: int = 16) -> Column:
    x, y, low, side = x.cast("long"), y.cast("long"), -(1 << (bits - 1)), 1 << bits
    inner = (side - 1) * (side - 1)
    m = F.greatest(F.abs(x), F.abs(y))
    j = (
        F.when((x == m) & (y > -m), y + m - 1).when((y == m) & (x < m), 3 * m - 1 - x)
        .when((x == -m) & (y < m), 5 * m - 1 - y).otherwise(7 * m - 1 + x)
    )
    return F.when(x == low, inner + y - low).when(y == low, inner + side + x - low - 1).when(m == 0, F.lit(0)).otherwise((2 * m - 1) * (2 * m - 1) + j)


def spiral_triangle(u: Column, bits: int = 16) -> Column:
    """struct(x, y) with x <= y by half shells: the corner (m, m), the top to the left, the left side down.

    The 2 ** w points with x = -2 ** (w - 1) come last, in order of y.
    """
    return let(u.cast("long"), lambda u: let(_half_shell(u), lambda m: _triangle_point(u, m, bits)))


def _half_shell(u: Column) -> Column:
    """Number of the half shell that holds index u; shell m starts at m (2m - 1)."""
    guess = F.floor((1 + F.sqrt(1 + 8 * u.cast("double"))) / 4).cast("long")
    base = lambda m: m * (2 * m - 1)
    return let(guess, lambda g: F.when(base(g + 1) <= u, g + 1).when(base(g) > u, g - 1).otherwise(g))


def _triangle_point(u: Column, m: Column, bits: int) -> Column:
    low = -(1 << (bits - 1))
    inner = -low * (-2 * low - 1)
    j = u - m * (2 * m - 1)
    x, y = F.when(j <= 2 * m, m - j).otherwise(-m), F.when(j <= 2 * m, m).otherwise(3 * m - j)
    zero = F.lit(0).cast("long")
    edge = F.struct(F.lit(low).cast("long").alias("x"), (u - inner + low).alias("y"))
    return F.when(u == 0, F.struct(zero.alias("x"), zero.alias("y"))).when(u < inner, F.struct(x.alias("x"), y.alias("y"))).otherwise(edge)


def spiral_triangle_inverse(x: Column, y: Column, bits: int = 16) -> Column:
    """Inverse of spiral_triangle; null where x > y."""
    x, y, low = x.cast("long"), y.cast("long"), -(1 << (bits - 1))
    inner = -low * (-2 * low - 1)
    m = F.greatest(F.abs(x), F.abs(y))
    j = F.when(y == m, m - x).otherwise(3 * m - y)
    return F.when(x > y, None).when(x == low, inner + y - low).when(m == 0, F.lit(0)).otherwise(m * (2 * m - 1) + j)


# --- Hilbert curve ----------------------------------------------------------------------------------------


def hilbert_points(index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of curve positions, from the highest digit down; (0, 0) first, then along x or y by order."""
    x, y = np.zeros_like(index), np.zeros_like(index)
    for level in range(bits):
        side = np.uint64(1) << np.uint64(level)
        digit = index >> np.uint64(2 * level)
        rx = (digit >> np.uint64(1)) & np.uint64(1)
        ry = (digit ^ rx) & np.uint64(1)
        turn = ry == 0
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - np.uint64(1) - x, x), np.where(flip, side - np.uint64(1) - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        x, y = x + side * rx, y + side * ry
    return x, y


def hilbert_index(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of hilbert_points."""
    out = np.zeros_like(x)
    for level in reversed(range(bits)):
        side = np.uint64(1) << np.uint64(level)
        rx, ry = (x >> np.uint64(level)) & np.uint64(1), (y >> np.uint64(level)) & np.uint64(1)
        out = out + side * side * ((np.uint64(3) * rx) ^ ry)
        x, y = x & (side - np.uint64(1)), y & (side - np.uint64(1))
        turn = ry == 0
        flip = turn & (rx == 1)
        x, y = np.where(flip, side - np.uint64(1) - x, x), np.where(flip, side - np.uint64(1) - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return out


# --- scattered shells ---------------------------------------------------------------------------------------

#: Fixed values of the scattering permutation.
ROUNDS = 4
LAYER_KEY, ROUND_KEY = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a public generator."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def scatter(index: np.ndarray, size: np.ndarray, layer: np.ndarray, forward: bool = True) -> np.ndarray:
    """A Feistel permutation of 0..size-1 for each layer, walked until it falls inside."""
    index, size, layer = (np.asarray(v, np.uint64) for v in (index, size, layer))
    with np.errstate(over="ignore"):
        key = _mix(layer * np.uint64(LAYER_KEY))
        half = np.array([(max(int(n) - 1, 0).bit_length() + 1) // 2 for n in size.tolist()], np.uint64)
        mask = (np.uint64(1) << half) - np.uint64(1)
        out, open_ = index.copy(), np.ones(len(index), bool)
        while open_.any():
            h, m, k, v = half[open_], mask[open_], key[open_], out[open_]
            left, right = (v >> h) & m, v & m
            for r in range(ROUNDS) if forward else reversed(range(ROUNDS)):
                salt = np.uint64(ROUND_KEY * r % 2**64)
                if forward:
                    left, right = right, (left ^ _mix(right ^ k ^ salt)) & m
                else:
                    left, right = (right ^ _mix(left ^ k ^ salt)) & m, left
            out[open_] = (left << h) | right
            open_ = out >= size
    return out


def _pair_udf(function):
    @F.pandas_udf("x long, y long")
    def run(values: pd.Series) -> pd.DataFrame:
        x, y = function(values.to_numpy(np.int64).astype(np.uint64))
        return pd.DataFrame({"x": x.astype(np.int64), "y": y.astype(np.int64)})

    return run


def _index_udf(function):
    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(function(x.to_numpy(np.int64), y.to_numpy(np.int64)).astype(np.int64))

    return run


def hilbert(u: Column, bits: int = 16) -> Column:
    return _pair_udf(lambda v: hilbert_points(v, bits))(u)


def hilbert_inverse(x: Column, y: Column, bits: int = 16) -> Column:
    return _index_udf(lambda a, b: hilbert_index(a.astype(np.uint64), b.astype(np.uint64), bits))(x, y)


def _square_shells(m: np.ndarray, bits: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first index, points, layer) of square shells m; `cut` marks what lies on the cut edge."""
    side = 1 << bits
    base, size = np.where(m > 0, (2 * m - 1) ** 2, 0), np.where(m > 0, 8 * m, 1)
    return np.where(cut, (side - 1) ** 2, base), np.where(cut, 2 * side - 1, size), np.where(cut, side >> 1, m)


def _triangle_shells(m: np.ndarray, bits: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    half = 1 << (bits - 1)
    return np.where(cut, half * (2 * half - 1), m * (2 * m - 1)), np.where(cut, 2 * half, 4 * m + 1), np.where(cut, half, m)


def _floor_root(n: np.ndarray) -> np.ndarray:
    r = np.sqrt(n.astype(np.float64)).astype(np.int64)
    return r - (r * r > n) + ((r + 1) * (r + 1) <= n)


def scatter_square_points(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Square shells whose points, clockwise from (-m, m), stand in scattered order; the cut edge in order of its bits, scattered."""
    u, side, low = u.astype(np.int64), 1 << bits, -(1 << (bits - 1))
    cut = u >= (side - 1) ** 2
    m = np.where(cut, 0, (_floor_root(u) + 1) // 2)
    base, size, layer = _square_shells(m, bits, cut)
    j = scatter(u - base, size, layer).astype(np.int64)
    step, edge = j % np.maximum(2 * m, 1), j // np.maximum(2 * m, 1)
    x = np.select([m == 0, edge == 0, edge == 1, edge == 2], [0 * m, step - m, m, m - step], -m)
    y = np.select([m == 0, edge == 0, edge == 1, edge == 2], [0 * m, m, m - step, -m], step - m)
    raw = np.where(j < side, j, j - side + (j - side >= side >> 1))
    value = np.where(raw >= side >> 1, raw - side, raw)
    return np.where(cut, np.where(j < side, low, value), x), np.where(cut, np.where(j < side, value, low), y)


def scatter_square_index(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    side, low = 1 << bits, -(1 << (bits - 1))
    m, cut = np.maximum(np.abs(x), np.abs(y)), (x == low) | (y == low)
    base, size, layer = _square_shells(m, bits, cut)
    j = np.select([m == 0, (y == m) & (x < m), (x == m) & (y > -m), (y == -m) & (x > -m)], [0 * m, x + m, 3 * m - y, 5 * m - x], 7 * m + y)
    rx, ry = x % side, y % side
    j = np.where(cut, np.where(x == low, ry, side + rx - (rx > side >> 1)), j)
    return base + scatter(j, size, layer, False).astype(np.int64)


def scatter_triangle_points(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """spiral_triangle with every half shell's points, and the cut edge's, in scattered order."""
    u, low = u.astype(np.int64), -(1 << (bits - 1))
    cut = u >= -low * (-2 * low - 1)
    m = ((1 + np.sqrt(1 + 8.0 * u)) // 4).astype(np.int64)
    m = np.where(cut, 0, m - (m * (2 * m - 1) > u) + ((m + 1) * (2 * m + 1) <= u))
    base, size, layer = _triangle_shells(m, bits, cut)
    j = scatter(u - base, size, layer).astype(np.int64)
    top = j <= 2 * m
    return np.where(cut, low, np.where(top, m - j, -m)), np.where(cut, low + j, np.where(top, m, 3 * m - j))


def scatter_triangle_index(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Inverse of scatter_triangle_points, for x <= y."""
    low = -(1 << (bits - 1))
    m, cut = np.maximum(np.abs(x), np.abs(y)), x == low
    base, size, layer = _triangle_shells(m, bits, cut)
    j = np.where(cut, y - low, np.where(y == m, m - x, 3 * m - y))
    return base + scatter(j, size, layer, False).astype(np.int64)


def scatter_square(u: Column, bits: int = 16) -> Column:
    return _pair_udf(lambda v: scatter_square_points(v, bits))(u)


def scatter_square_inverse(x: Column, y: Column, bits: int = 16) -> Column:
    return _index_udf(lambda a, b: scatter_square_index(a, b, bits))(x, y)


def scatter_triangle(u: Column, bits: int = 16) -> Column:
    return _pair_udf(lambda v: scatter_triangle_points(v, bits))(u)


def scatter_triangle_inverse(x: Column, y: Column, bits: int = 16) -> Column:
    return _index_udf(lambda a, b: scatter_triangle_index(a, b, bits))(x, y)
