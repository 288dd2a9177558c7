"""Least-squares trends over elapsed time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError, UnitError
from ..functions.quality import filter_by_qc_flags, mark_missing_by_flags
from ..functions.units import TimeUnit, Unit, elapsed, start_offset
from .timeops import utc


def linear_trend(df: DataFrame, time_unit: TimeUnit | str, category_col: str, datetime_col: str = "datetime", value_col: str = "concentration", flag_col: str = "flag", group_by: list[str] | None = None, min_samples: int = 3, min_duration_years: float = 1.0, units: dict | None = None, allow_missing_units: bool = False) -> DataFrame:
    """keys, slope, intercept, r_squared, n, duration_years, start_time, end_time, short_duration_flag, low_n_flag, slope_units.

    x is the time since the group's first valid row. Groups with a null key or fewer than ``min_samples`` rows go. No
    spread in x: slope 0, the mean as intercept, no r squared. No spread in y: no r squared.
    """
    unit = TimeUnit(time_unit)
    keys = [category_col, *(group_by or [])]
    for name in [*keys, datetime_col, value_col, flag_col]:
        if name not in df.columns:
            raise SchemaError(f"column {name!r} isn't there")
    if value_col not in (units or {}) and not allow_missing_units:
        raise UnitError(f"no unit for {value_col!r}")
    symbol = Unit.parse(units[value_col]).symbol if value_col in (units or {}) else "unknown"
    kept = mark_missing_by_flags(filter_by_qc_flags(df, flag_col), value_col, flag_col)
    k = [f"_k{i}" for i in range(len(keys))]  # names of our own: a key may be called n, t or x
    kept = kept.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), utc(kept, datetime_col).alias("_t"), F.col(f"`{value_col}`").cast("double").alias("_y"))
    kept = kept.where(F.col("_y").isNotNull() & ~F.isnan("_y") & F.col("_t").isNotNull()).dropna(subset=k)
    # time since the group's start is time since a fixed day less that of the start, so one aggregation gives both
    day = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    x, y = elapsed(day, F.col("_t"), unit), F.col("_y")
    sums = kept.groupBy(*k).agg(F.count(y).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"), F.min("_t").alias("start_time"), F.max("_t").alias("end_time"))
    sums = sums.withColumn("mx", F.col("mx") - start_offset(day, F.col("start_time"), unit))
    n = F.col("n")
    flat = n * n * F.col("vx") < 1e-12
    slope = F.when(flat, F.lit(0.0)).otherwise(F.try_divide("cxy", "vx"))
    r2 = F.when(flat | (n * F.col("vy") < 1e-12), None).otherwise(F.try_divide(F.col("cxy") * F.col("cxy"), F.col("vx") * F.col("vy")))
    years = elapsed(F.col("start_time"), F.col("end_time"), TimeUnit.CALENDAR_YEAR)
    return sums.where(n >= min_samples).select(*(F.col(a).alias(c) for c, a in zip(keys, k)), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r_squared"), "n", years.alias("duration_years"), "start_time", "end_time", (years < min_duration_years).alias("short_duration_flag"), F.lit(False).alias("low_n_flag"), F.lit(f"{symbol}/{unit.value}").alias("slope_units")).orderBy(*(f"`{c}`" for c in keys))
