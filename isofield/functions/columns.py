"""Column expressions that the operators share. Arrays are three-vectors unless said otherwise; everything is double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x where it is a finite number, else null, so that aggregates skip it."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def coerced(x: Column) -> Column:
    """x as a finite double; text that is no number, NaN and infinities become null."""
    return finite(x.try_cast("double"))


def iso_date(x: Column) -> Column:
    """The date of a text of the form YYYY-MM-DD, null for any other text and for days that do not exist."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


def relabelled(x: Column, names: dict[str, str]) -> Column:
    """The new name of a label; labels without one stay."""
    if not names:
        return x
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in names.values()]), F.nullif(F.array_position(F.array(*[F.lit(k) for k in names]), x), F.lit(0).cast("long")).cast("int") - 1), x)


def token(prefix: str, x: Column, digits: int) -> Column:
    """A part of a file name: the prefix and the number to fixed digits, with p for the point."""
    return F.concat(F.lit(prefix), F.translate(F.format_string(f"%.{digits}f", x.cast("double")), ".", "p"))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_column(low), F.least(as_column(high), x))


def dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def octant(x: Column, y: Column, z: Column) -> Column:
    """Sign code: 1 for x >= 0, 2 for y >= 0, 4 for z >= 0."""
    bit = lambda c, k: F.when(c >= 0, F.lit(k)).otherwise(F.lit(0))
    return bit(x, 1) + bit(y, 2) + bit(z, 4)


def line_of_sight(position: list[Column]) -> list[Column]:
    length = norm(position)
    return [F.try_divide(c, length) for c in position]


def direction_error(truth: list[Column], predicted: list[Column]) -> Column:
    """Angle in degrees; null where either vector is zero."""
    size = norm(truth) * norm(predicted)
    return F.when(size > 0, F.degrees(F.acos(clip(dot(truth, predicted) / size, -1.0, 1.0))))


def schechter_log_shape(magnitude: Column, knee: float, slope: float) -> Column:
    """Log of the magnitude distribution with the given knee and faint-end slope."""
    exponent = F.lit(0.4) * (F.lit(knee) - magnitude)
    return F.log(F.lit(0.4) * F.log(F.lit(10.0))) + F.lit(slope + 1) * exponent * F.log(F.lit(10.0)) - F.pow(F.lit(10.0), exponent)


def sky(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude and latitude in radians."""
    return F.atan2(y, x), F.asin(clip(F.try_divide(z, norm([x, y, z])), -1.0, 1.0))


def order_hash(id_: Column, seed: int) -> Column:
    """A number in [0, 2**31) by arithmetic that any SQL engine repeats."""
    return F.pmod(id_.cast("long") * F.lit(1103515245) + F.lit(seed).cast("long") * F.lit(12345), F.lit(2147483648))


#: Multipliers of random_number().
ID_FACTOR, DRAW_FACTOR, SEED_FACTOR, MIX_FACTORS = 374761393, 668265263, 1274126177, (739982445, 695872825)


def _random_steps(seed: int | Column, id_: Column):
    """The functions that random_number() applies to a draw, one after the other."""
    part = lambda c, factor: (c if isinstance(c, Column) else F.lit(c)).cast("long") % (1 << 31) * F.lit(factor)
    yield lambda draw: F.pmod(part(id_, ID_FACTOR) + part(draw, DRAW_FACTOR) + part(seed, SEED_FACTOR), F.lit(1 << 31))
    mix = lambda shift, factor: lambda x: F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor), F.lit(1 << 31))
    yield mix(15, MIX_FACTORS[0])
    yield mix(12, MIX_FACTORS[1])
    yield lambda x: x.bitwiseXOR(F.shiftright(x, 15))


def random_number(seed: int | Column, draw: Column, id_: Column) -> Column:
    """A number in [0, 2**31) that seed, draw and id fix, by integer arithmetic, shifts and xor that any SQL engine repeats."""
    for step in _random_steps(seed, id_):
        draw = step(draw)
    return draw


def random_numbers(seed: int | Column, draws: Column, id_: Column) -> Column:
    """random_number() of each draw of an array; each step passes over the array, so that none is evaluated twice."""
    for step in _random_steps(seed, id_):
        draws = F.transform(draws, step)
    return draws


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation on a fixed grid, constant beyond its ends."""
    out = F.lit(float(ys[-1]))
    for x0, x1, y0, y1 in reversed(list(zip(xs, xs[1:], ys, ys[1:]))):
        out = F.when(x < x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)
