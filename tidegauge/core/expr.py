"""Small Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once and use it several times inside a fold step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    """Division that yields ``default`` (or NULL) on a zero or NULL denominator."""
    out = F.when(den != 0, num / den)
    return out if default is None else F.coalesce(out, F.lit(default))


def std0(col: Column) -> Column:
    """Sample deviation with 0.0 for one row, as reported across seeds."""
    return F.coalesce(F.stddev_samp(col), F.when(F.count(col) > 0, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(col: Column | str) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def lit_array(values: Sequence[float | int | str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def hex_int(hex_text: Column) -> Column:
    """A short hex string (up to 15 digits) as BIGINT."""
    return F.conv(hex_text, 16, 10).cast("bigint")
