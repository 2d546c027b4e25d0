"""Quadtree keys and rounding (F16-F20, P15, P16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map: exclusive bounds of both axes, the shift to positive coordinates, digits of a key.
BOUND_LOW, BOUND_HIGH, SHIFT, DIGITS = -104.0, 56.0, 104.0, 15
SCALE = (1 << DIGITS) / (BOUND_HIGH - BOUND_LOW)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def on_map(x: Column | str, y: Column | str) -> Column:
    """Both coordinates strictly inside the map; missing and not-a-number are outside."""
    x, y = _col(x), _col(y)
    return F.coalesce((x > BOUND_LOW) & (x < BOUND_HIGH) & (y > BOUND_LOW) & (y < BOUND_HIGH), F.lit(False))


def within(x: Column | str, y: Column | str, x_min: float | None = None, x_max: float | None = None, y_min: float | None = None, y_max: float | None = None) -> Column:
    """Exclusive bounds, each of them optional."""
    ok = F.lit(True)
    for c, low, high in ((_col(x), x_min, x_max), (_col(y), y_min, y_max)):
        ok = ok & (c > low) if low is not None else ok
        ok = ok & (c < high) if high is not None else ok
    return ok


def interleave(xi: Column, yi: Column, digits: int = DIGITS) -> Column:
    """Digits 2 * ybit + xbit of the low bits of two integers, most significant first."""
    return F.transform(F.sequence(F.lit(digits - 1), F.lit(0), F.lit(-1)), lambda i: (2 * (F.call_function("shiftright", yi, i).bitwiseAND(F.lit(1).cast("bigint"))) + F.call_function("shiftright", xi, i).bitwiseAND(F.lit(1).cast("bigint"))).cast("int"))


def quadkey(x: Column | str, y: Column | str) -> Column:
    """shift, turn y upside down, scale, cut towards 0, and interleave the low 15 bits; null off the map.

    The turned y is negative and wraps modulo 2 ** 15, as its two's complement does.
    """
    xi = ((_col(x) + SHIFT) * SCALE).cast("bigint")
    yi = (-(_col(y) + SHIFT) * SCALE).cast("bigint")
    return F.when(on_map(x, y), interleave(xi, yi))


def encode_point(xi: Column | str, yi: Column | str) -> Column:
    """the key of a point of the twice as fine integer grid."""
    return interleave(F.call_function("shiftright", _col(xi), F.lit(1)), F.call_function("shiftright", _col(yi), F.lit(1)))


def quad_to_xy(key: Column | str) -> Column:
    """F16: struct(x, y) of the low and the high bits of the digits."""
    fold = lambda bit: F.aggregate(_col(key), F.lit(0).cast("bigint"), lambda a, d: a * 2 + bit(d).cast("bigint"))
    return F.struct(fold(lambda d: d.bitwiseAND(F.lit(1))).alias("x"), fold(lambda d: F.call_function("shiftright", d, F.lit(1))).alias("y"))


def decode_point(key: Column | str) -> Column:
    """struct(x, y, precision): the centre of the key's cell on the twice as fine grid."""
    n = F.size(_col(key))
    centre = lambda v: F.call_function("shiftleft", F.call_function("shiftleft", v, F.lit(1)) + 1, DIGITS - n)
    xy = quad_to_xy(key)
    return F.struct(centre(xy["x"]).alias("x"), centre(xy["y"]).alias("y"), n.cast("bigint").alias("precision"))


def prefix(key: Column | str, digits: int) -> Column:
    """The key of the coarser cell with ``digits`` digits; the whole key when it has fewer."""
    return F.slice(_col(key), 1, digits)


def key_text(key: Column | str) -> Column:
    """The digits with commas between them."""
    return F.array_join(_col(key).cast("array<string>"), ",")


def js_round(c: Column | str) -> Column:
    """to the nearest integer, halves upwards."""
    return F.floor(_col(c) + 0.5)
