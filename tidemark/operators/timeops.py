"""Time bounds, gap-filled resampling and centred rolling means."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, TimeError


@dataclass(frozen=True)
class TimeBounds:
    start: datetime
    end: datetime


def ensure_timezone_aware(t: datetime) -> datetime:
    if not isinstance(t, datetime):
        raise TimeError("a datetime is needed")
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def to_utc(t: datetime) -> datetime:
    return ensure_timezone_aware(t).astimezone(timezone.utc)


def utc(df: DataFrame, time_col: str) -> Column:
    """The column as naive UTC time: instants whatever the session's zone, naive times as they are."""
    c = F.col(f"`{time_col}`")
    if isinstance(df.schema[time_col].dataType, T.TimestampType):
        return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))
    return c.cast("timestamp_ntz")


def bounds_frame(df: DataFrame, time_col: str = "datetime") -> DataFrame:
    """Smallest and largest time over all rows, in UTC."""
    t = utc(df, time_col)
    return df.agg(F.min(t).alias("start"), F.max(t).alias("end"))


def time_bounds(df: DataFrame, time_col: str = "datetime") -> TimeBounds:
    row = bounds_frame(df, time_col).first()
    return TimeBounds(to_utc(row["start"]), to_utc(row["end"]))


_SECONDS = {"s": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}
_MONTHS = {"m": 1, "me": 1, "ms": 1, "q": 3, "qe": 3, "qs": 3, "y": 12, "ye": 12, "ys": 12, "a": 12}


@dataclass(frozen=True)
class Rule:
    """Bins of ``width`` seconds or calendar months; those of calendar units without an S are named by their last day."""

    width: int
    months: bool = False
    by_end: bool = False

    @classmethod
    def parse(cls, rule: str) -> Rule:
        m = re.fullmatch(r"(\d*)\s*([a-z]+)", rule.strip().lower())
        n, unit = (int(m[1] or 1), m[2]) if m else (0, "")
        if n >= 1 and unit in _SECONDS:
            return cls(n * _SECONDS[unit])
        by_end = unit in _MONTHS and not unit.endswith("s")
        if n >= 1 and unit in _MONTHS and not (by_end and n > 1):
            return cls(n * _MONTHS[unit], True, by_end)
        raise ConfigurationError(f"resampling rule {rule!r}: a number and s, min, h, D, MS, QS or YS are needed, or ME, QE or YE alone")

    def origin(self, first: Column) -> Column:
        """Where bin 0 starts: midnight of the first day, or the first month, quarter or year."""
        unit = "day" if not self.months else "year" if self.width % 12 == 0 else "quarter" if self.width % 3 == 0 else "month"
        return F.date_trunc(unit, first).cast("timestamp_ntz")

    def bin_of(self, origin: Column, t: Column) -> Column:
        since = (F.year(t) - F.year(origin)) * 12 + F.month(t) - F.month(origin) if self.months else F.timestamp_diff("SECOND", origin, t)
        return F.floor(since / F.lit(self.width)).cast("long")

    def name_of(self, origin: Column, at: Column) -> Column:
        if not self.months:
            return F.timestamp_add("SECOND", at * self.width, origin).cast("timestamp_ntz")
        start = F.add_months(origin.cast("date"), ((at + int(self.by_end)) * self.width).cast("int"))
        return (F.date_sub(start, 1) if self.by_end else start).cast("timestamp_ntz")


def _numeric(df: DataFrame, columns: list[str] | None, but: set[str]) -> list[str]:
    if gone := [c for c in columns or [] if c not in df.columns]:
        raise KeyError(gone[0])
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but and (columns is None or f.name in columns)]


def resample_mean(df: DataFrame, rule: str = "1h", time_col: str = "datetime", columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Means of left-closed bins anchored at midnight of the first day (calendar rules: at the first month, quarter or year),
    in UTC; bins without rows are there with nulls."""
    rule, keys = Rule.parse(rule), list(keys or [])
    names = _numeric(df, columns, {time_col, *keys})
    base = df.where(F.col(time_col).isNotNull()).select(*keys, utc(df, time_col).alias("_t"), *names)
    edges = base.groupBy(*keys).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    origin = rule.origin(F.col("_lo"))
    spine = edges.select(*keys, origin.alias("_origin"), F.explode(F.sequence(rule.bin_of(origin, F.col("_lo")), rule.bin_of(origin, F.col("_hi")))).alias("_bin"))
    first = base.join(edges, keys) if keys else base.crossJoin(F.broadcast(edges))  # without keys: one row
    means = first.withColumn("_bin", rule.bin_of(origin, F.col("_t"))).groupBy(*keys, "_bin").agg(*(F.avg(c).alias(c) for c in names))
    at = rule.name_of(F.col("_origin"), F.col("_bin"))
    return spine.join(means, [*keys, "_bin"], "left").select(*keys, at.alias(time_col), *names)


def rolling_window_mean(df: DataFrame, window: int = 3, time_col: str = "datetime", columns: list[str] | None = None, keys: list[str] | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """Centred means over rows, fewer at the ends; an even window has one row more before than after.

    Without ``keys`` there is one series and so one partition, as its definition has it; give keys to spread the work.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    names = _numeric(df, columns, {time_col, *(keys or []), *(tiebreak or [])})
    w = Window.partitionBy(*(keys or [])).orderBy(time_col, *(tiebreak or [])).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumns({c: F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).over(w) for c in names})
