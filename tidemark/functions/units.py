"""Units of concentration and of time, and what follows from them: conversion, rounding, elapsed time."""

from __future__ import annotations

from calendar import isleap, monthrange
from datetime import datetime
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import UnitError


class UnitFamily(Enum):
    MASS_CONCENTRATION = "mass_concentration"
    VOLUME_CONCENTRATION = "volume_concentration"


class TimeUnit(str, Enum):
    """Fixed values."""

    HOUR = "hour"
    DAY = "day"
    CALENDAR_MONTH = "calendar_month"
    CALENDAR_YEAR = "calendar_year"


class Unit(Enum):
    """Symbol, family, factor to the family's base unit, decimals in reports."""

    UG_M3 = ("ug/m3", UnitFamily.MASS_CONCENTRATION, 1.0, 1)
    MG_M3 = ("mg/m3", UnitFamily.MASS_CONCENTRATION, 1000.0, 3)
    PPB = ("ppb", UnitFamily.VOLUME_CONCENTRATION, 1.0, 1)
    PPM = ("ppm", UnitFamily.VOLUME_CONCENTRATION, 1000.0, 3)

    symbol = property(lambda self: self.value[0])
    family = property(lambda self: self.value[1])
    to_base_factor = property(lambda self: self.value[2])
    reporting_precision = property(lambda self: self.value[3])

    @classmethod
    def parse(cls, unit: Unit | str) -> Unit:
        if isinstance(unit, cls):
            return unit
        by_symbol = {u.symbol: u for u in cls}
        if unit not in by_symbol:
            raise UnitError(f"unknown unit {unit!r}; valid units: {', '.join(by_symbol)}")
        return by_symbol[unit]


#: Decimals by upper-case category name, before the unit's own.
PRECISION_OVERRIDES: dict[str, int] = {}


def can_convert(src: Unit | str, dst: Unit | str) -> bool:
    return Unit.parse(src).family is Unit.parse(dst).family


def get_factor(src: Unit | str, dst: Unit | str) -> float:
    a, b = Unit.parse(src), Unit.parse(dst)
    if a.family is not b.family:
        raise UnitError(f"can't convert {a.symbol} ({a.family.value}) to {b.symbol} ({b.family.value})")
    return a.to_base_factor / b.to_base_factor


def convert_values(values: Column, src: Unit | str, dst: Unit | str) -> Column:
    """The column in another unit; the same object where the factor is 1."""
    factor = get_factor(src, dst)
    if factor == 1.0:
        return values
    if not isinstance(values, Column):
        raise TypeError(f"a column is needed, not {type(values).__name__}")
    return values * F.lit(factor)


def convert_column(df: DataFrame, column: str, src: Unit | str, dst: Unit | str) -> DataFrame:
    """The frame with one numeric column in another unit; the same frame where the factor is 1."""
    if get_factor(src, dst) == 1.0:
        return df
    if not isinstance(df.schema[column].dataType, NumericType):
        raise TypeError(f"column {column!r} isn't numeric")
    return df.withColumn(column, convert_values(F.col(f"`{column}`"), src, dst))


def round_for_reporting(values: Column, unit: Unit | str, category: str | None = None) -> Column:
    """Half-even rounding to the category's or the unit's decimals."""
    decimals = PRECISION_OVERRIDES.get((category or "").upper(), Unit.parse(unit).reporting_precision)
    return F.bround(values.cast("double"), decimals)


def validate_units_schema(units: dict[str, Unit | str]) -> dict[str, Unit]:
    out = {}
    for column, unit in units.items():
        try:
            out[column] = Unit.parse(unit)
        except UnitError as e:
            raise UnitError(f"column {column!r}: {e}") from None
    return out


def format_time_unit(unit: TimeUnit | str) -> str:
    return TimeUnit(unit).value.removeprefix("calendar_")


def elapsed(start: Column, end: Column, unit: TimeUnit | str) -> Column:
    """Time from start to end. Calendar units add the end's place in its month or year and never take off the start's."""
    unit = TimeUnit(unit)
    if unit is TimeUnit.HOUR:
        return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)
    if unit is TimeUnit.DAY:
        return F.timestamp_diff("MICROSECOND", start, end) / F.lit(8.64e10)
    years = F.year(end) - F.year(start)
    if unit is TimeUnit.CALENDAR_MONTH:
        return 12 * years + F.month(end) - F.month(start) + F.day(end) / F.day(F.last_day(end))
    return years + F.dayofyear(end) / F.dayofyear(F.make_date(F.year(end), F.lit(12), F.lit(31)))


def start_offset(day: Column, start: Column, unit: TimeUnit | str) -> Column:
    """What to take from the time since ``day`` (the first of a year) to have the time since ``start``."""
    unit = TimeUnit(unit)
    if unit in (TimeUnit.HOUR, TimeUnit.DAY):
        return elapsed(day, start, unit)
    years = F.year(start) - F.year(day)
    return 12 * years + F.month(start) - F.month(day) if unit is TimeUnit.CALENDAR_MONTH else years


def elapsed_between(start: datetime, end: datetime, unit: TimeUnit | str) -> float:
    """``elapsed`` of two datetimes; an end before the start is a ValueError."""
    if end < start:
        raise ValueError("the end is before the start")
    unit, seconds = TimeUnit(unit), (end - start).total_seconds()
    if unit in (TimeUnit.HOUR, TimeUnit.DAY):
        return seconds / (3600 if unit is TimeUnit.HOUR else 86400)
    if unit is TimeUnit.CALENDAR_MONTH:
        return 12 * (end.year - start.year) + end.month - start.month + end.day / monthrange(end.year, end.month)[1]
    return end.year - start.year + end.timetuple().tm_yday / (366 if isleap(end.year) else 365)
