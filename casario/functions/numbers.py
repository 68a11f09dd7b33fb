"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number texts: an integer, or a decimal written with a point (fixed value).
NUMBER_PATTERN = r"^\s*[+-]?(\d+|(\d+\.\d*|\.\d+)([eE][+-]?\d+)?)\s*$"


def first_text(value: Column) -> Column:
    """First item of a JSON list literal, or the value itself; empty text is null."""
    item = F.when(value.startswith("["), F.get_json_object(value, "$[0]")).otherwise(value)
    return F.nullif(item, F.lit(""))


def number_of(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_numeric(value: Column) -> Column:
    """Number held by a scalar or list field; null when there is none."""
    return number_of(first_text(value))


def is_not_numeric(value: Column) -> Column:
    """True where the field holds text that is not a number."""
    text = first_text(value)
    return text.isNotNull() & number_of(text).isNull()


def to_numeric_or_zero(value: Column) -> Column:
    return F.coalesce(to_numeric(value), F.lit(0.0))


def round_half_even(value: Column, scale: int = 0) -> Column:
    return F.bround(value, scale)


def age_days(as_of: Column, moment: Column) -> Column:
    """Whole days between two timestamps, half to even; -1 when the moment is missing."""
    micros = (F.unix_micros(as_of) - F.unix_micros(moment)).cast("double")
    return F.coalesce(F.bround(micros / F.lit(86_400_000_000.0)).cast("int"), F.lit(-1))


def filled(value: Column, missing: float = -999.0) -> Column:
    """As double, with neither null nor NaN."""
    return F.nanvl(F.coalesce(value.cast("double"), F.lit(missing)), F.lit(missing))


def floor_to_step(value: Column, step: int) -> Column:
    """Down to a multiple of ``step``; truncates towards zero."""
    return (value / F.lit(float(step))).cast("bigint") * F.lit(step)


def ceil_to_step(value: Column, step: int) -> Column:
    return F.ceil(value / F.lit(float(step))) * F.lit(step)


def page_total(rows: Column, page_size: int) -> Column:
    """Number of pages; an empty result still has one."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(float(page_size)))).cast("bigint")


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16)))


SCORERS = {"mape": mape, "rmse": rmse, "mae": mae}
