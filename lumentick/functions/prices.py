"""Decimal rounding and price increments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def increments(text: str) -> list[tuple[float, float | None]]:
    """``0.0001 1; 0.01`` as (increment, limit): each holds up to its limit, the last without one."""
    out = []
    for part in text.split(";"):
        words = part.split()
        if words:
            out.append((float(words[0]), float(words[1]) if len(words) > 1 else None))
    return out


def increment(price: Column, text: str, direction: int = 0) -> Column:
    """The increment that holds at a price; at a limit ``direction`` picks the range (0: the finer one)."""
    ranges = increments(text)
    if not ranges:
        return F.lit(0.0)
    size, out = F.abs(price), F.lit(ranges[-1][0])
    sign = F.when(price < 0, -direction).otherwise(direction)
    for (inc, limit), (following, _) in reversed(list(zip(ranges, ranges[1:]))):
        eps = min(inc, following) * 1e-6
        at = F.abs(size - F.lit(limit)) <= eps
        chosen = F.when(sign < 0, F.lit(inc)).when(sign > 0, F.lit(following)).otherwise(F.lit(min(inc, following)))
        out = F.when(at, chosen).when(size < limit, F.lit(inc)).otherwise(out)
    return out


def decimal(c: Column, digits: int = 10) -> Column:
    """Without binary noise after ``digits`` places; numbers too large to have such places stay."""
    unit = F.lit(float(10**digits))
    return F.when(F.abs(c * unit) < 2.0**52, F.rint(c * unit) / unit).otherwise(c)


def rounded(price: Column, text: str, direction: int = 0) -> Column:
    """The price on its increment's grid: down for a negative direction, up for a positive one, else half to even."""
    inc = increment(price, text, direction)
    steps = decimal(price / F.nullif(inc, F.lit(0.0)), 6)
    near = F.floor(steps) if direction < 0 else F.ceil(steps) if direction > 0 else F.rint(steps)
    return F.when(inc == 0, price).otherwise(decimal(near.cast("double") * inc))


def stepped(price: Column, text: str, direction: int) -> Column:
    """The next price on the grid in the direction; a price off the grid goes to its nearest neighbour there."""
    to = rounded(price, text, direction)
    moved = F.abs(to - price) > 1e-9
    return F.when(moved, to).otherwise(decimal(price + F.lit(direction) * increment(price, text, direction)))


def precision(price: Column, text: str) -> Column:
    """Digits after the point of the increment at a price."""
    out = F.lit(0)
    for inc, _ in increments(text):
        digits = len(f"{inc:.10f}".rstrip("0").partition(".")[2])
        out = F.when(increment(price, text) == inc, F.lit(digits)).otherwise(out)
    return out


#: Ways to round to a whole number: towards and away from zero, down and up, to the nearest with ties in three ways.
MODES = ("UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN", "UNNECESSARY")


def whole(c: Column, mode: str = "HALF_UP") -> Column:
    """``c`` (a double) rounded to a whole number; UNNECESSARY is an error where it isn't one."""
    size, sign = F.abs(c), F.signum(c)
    low = F.when(F.rint(size) > size, F.rint(size) - 1).otherwise(F.rint(size))
    rest = size - low
    up = {
        "UP": rest > 0, "DOWN": F.lit(False), "CEILING": (rest > 0) & (c > 0), "FLOOR": (rest > 0) & (c < 0), "HALF_UP": rest >= 0.5, "HALF_DOWN": rest > 0.5, "HALF_EVEN": F.rint(size) > low,
        "UNNECESSARY": F.when(rest > 0, F.raise_error(F.lit("rounding would be necessary")).cast("boolean")).otherwise(False),
    }[mode]
    return F.when(F.isnan(c) | (size >= 2.0**52), c).otherwise(sign * (low + up.cast("double")))


def scaled(c: Column, digits: int, mode: str = "HALF_UP") -> Column:
    """``c`` rounded to ``digits`` places after the point (negative: before it)."""
    unit = F.lit(float(10 ** abs(digits)))
    return F.when(F.abs(c) >= 2.0**52, c).otherwise(whole(c * unit, mode) / unit if digits >= 0 else whole(c / unit, mode) * unit)


def significant(c: Column, digits: int, mode: str = "HALF_UP") -> Column:
    """``c`` rounded to ``digits`` significant digits."""
    unit = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) < 1e-290) | (F.abs(c) > 1e290), c).otherwise(whole(decimal(c * unit, 2), mode) / unit)


def half_up(c: Column, digits: int) -> Column:
    return scaled(c, digits, "HALF_UP")


def combined(kind: str, first: Column, second: Column) -> Column:
    """sum, difference, average, product, quotient, max or min of two doubles, without binary noise; NaN and null as they come."""
    made = {
        "sum": first + second, "difference": first - second, "average": (first + second) / 2, "product": first * second, "max": F.when(F.isnan(first) | F.isnan(second), F.lit(float("nan"))).otherwise(F.greatest(first, second)),
        "min": F.when(F.isnan(first) | F.isnan(second), F.lit(float("nan"))).otherwise(F.least(first, second)),
        "quotient": F.when(second != 0, F.try_divide(first, second)).otherwise(F.when((first == 0) | F.isnan(first), F.lit(float("nan"))).otherwise(F.signum(first) * F.lit(float("inf")))),
    }[kind]
    return decimal(made)


#: The tiny decimals' powers of ten by their four low bits (0 has NaN and the infinities); the mantissa stands above them.
POWERS = tuple(9 - k for k in range(1, 16))


def tiny_decimal(c: Column) -> Column:
    """A double as a tiny decimal, an int of a 28-bit mantissa and four bits of scale: the first scale that holds its first nine digits."""
    found = []
    for k, power in enumerate(POWERS, 1):
        m = c / F.lit(10.0**power) if power >= 0 else c * F.lit(10.0**-power)
        fits = (F.abs(m) < 2.0**27) & (F.abs(m - F.rint(m)) <= 1e-9 * F.abs(m))
        found.append(F.when(fits, F.rint(m).cast("int") * 16 + k))
    return F.coalesce(*found, F.lit(0)).cast("int")


def from_tiny_decimal(c: Column) -> Column:
    """The double of a tiny decimal; a scale of 0 has NaN, the infinities, and mantissas of 25 bits in finer units."""
    scale, m = c.bitwiseAND(F.lit(15)), F.shiftright(c, 4).cast("double")
    kind, fine = F.shiftright(c, 4).bitwiseAND(F.lit(7)), F.shiftright(c, 7).cast("double")
    out = F.when(kind == 1, float("inf")).when(kind == 7, float("-inf")).when(kind == 2, fine / 1e7).when(kind == 3, fine / 1e8).when(kind == 6, fine / 128).otherwise(float("nan"))
    for k, power in enumerate(POWERS, 1):
        out = F.when(scale == k, m * F.lit(10.0**power) if power >= 0 else m / F.lit(10.0**-power)).otherwise(out)
    return out


def defined(first: Column, second: Column, both: Column) -> Column:
    """``both`` where neither is NaN or null, else the one that is a number."""
    missing = lambda x: x.isNull() | F.isnan(x)
    return F.when(missing(first), second).when(missing(second), first).otherwise(both)
