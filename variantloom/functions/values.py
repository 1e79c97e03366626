"""Column helpers for missing values, numbers and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    value = c.cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN sorts above infinity


def to_number(c: Column, default: float | None = None) -> Column:
    """Lenient text-to-double: anything that is not a finite number is missing."""
    value = finite(c.try_cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def first_item(c: Column) -> Column:
    """First entry of a ``;``-packed list."""
    return F.split_part(c, F.lit(";"), F.lit(1))


def first_valid_item(c: Column) -> Column:
    """First entry of a ``;``-packed list that is a number."""
    numbers = F.transform(F.split(c, ";"), lambda item: item.try_cast("double"))
    return F.get(F.array_compact(numbers), F.lit(0))


def first_number(df: DataFrame, names: Sequence[str]) -> Column:
    """First alias column that holds a number; columns the table lacks are skipped."""
    present = [to_number(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


INTEGER_RANGES = {"tinyint": (-128, 127), "smallint": (-32768, 32767)}


def within_type(c: Column, kind: str) -> Column:
    """Cast that keeps a number too large for a small integer type at the end of its range."""
    if kind in INTEGER_RANGES:
        low, high = INTEGER_RANGES[kind]
        c = F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
    return c.try_cast(kind)


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also for an unknown condition)."""
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def at_least_one(n: Column) -> Column:
    return F.greatest(n, F.lit(1))
