"""Decimal rounding of doubles by their exact binary values, half to even, in whole numbers alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = "decimal(38,0)"
#: From here on doubles are whole numbers; up to the second bound they fit into 38 digits.
_INTEGRAL, _MOST = float(1 << 53), float(1 << 123)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _units(v: Column, places: int) -> Column:
    """How many times ``10**-places`` goes into ``v``, which is not negative and below 2**53, rounded half to even.

    10**places is 2**places * 5**places. The first factor is exact; the product is split into its whole part and 104
    bits after the point, each a whole number, and these are multiplied by the second one. A fraction with bits beyond
    those 104 has none of the first 51, so it is far below one half.
    """
    five, word = F.lit(5**places).cast(_WHOLE), float(1 << 52)
    big, half = F.lit(1 << 52).cast(_WHOLE), F.lit(1 << 51).cast(_WHOLE)

    def rounded(whole: Column, high: Column, low: Column) -> Column:
        lower = (low.cast(_WHOLE) * five).cast(_WHOLE)
        upper = (high.cast(_WHOLE) * five + _quotient(lower, big)).cast(_WHOLE)
        below = (whole.cast(_WHOLE) * five + _quotient(upper, big)).cast(_WHOLE)
        rest, sticky = upper % big, lower % big
        up = (rest > half) | ((rest == half) & ((sticky > 0) | (below % 2 == 1)))
        return (below + F.when(up, 1).otherwise(0)).cast(_WHOLE)

    def parts(y: Column) -> Column:
        f = (y - F.floor(y)) * word
        return rounded(F.floor(y), F.floor(f), F.floor((f - F.floor(f)) * word))

    return _let(v * float(1 << places), parts)


def _quotient(a: Column, b: Column) -> Column:
    return ((a - a % b) / b).cast(_WHOLE)


def _integer(v: Column) -> Column:
    """A whole double below 2**123 as a decimal: two pieces of 60 bits or more, each exact."""
    step = float(1 << 60)
    high = F.floor(v / step)
    return (high.cast(_WHOLE) * F.lit(1 << 60).cast(_WHOLE) + F.floor(v - high.cast("double") * step).cast(_WHOLE)).cast(_WHOLE)


def fixed_text(v: Column, places: int = 6) -> Column:
    """``v`` with so many decimals, as text; missing and infinite values are blank.

    From 2**123 on, about 10**37, the digits are those of the shortest text that reads as the same double.
    """
    v = v.cast("double")
    size = F.abs(v)
    n = _units(size, places).cast("string")
    padded = F.lpad(n, F.greatest(F.length(n), F.lit(places + 1)), "0")
    small = F.concat(F.substring(padded, F.lit(1), F.length(padded) - places), F.lit("."), F.right(padded, F.lit(places)))
    large = F.concat(F.when(size < _MOST, _integer(size).cast("string")).otherwise(F.printf(F.lit("%.0f"), size)), F.lit("." + "0" * places))
    sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    unknown = v.isNull() | F.isnan(v) | (size == float("inf"))
    return F.when(unknown, "").otherwise(F.concat(sign, F.when(size < _INTEGRAL, small).otherwise(large)))


def round_even(v: Column, places: int) -> Column:
    """``v`` rounded to so many decimals, as the nearest double. Doubles too wide apart to have such decimals stay."""
    size = F.abs(v.cast("double"))
    units = _units(size, places).cast("double") / float(10**places)
    exact = float((1 << 53) // 10**places)
    return F.when(v.isNull() | F.isnan(v) | (size >= exact), v.cast("double")).otherwise(F.when(v < 0, -units).otherwise(units))
