"""Descriptive statistics: one conditional aggregation over unfiltered rows, tidy or wide."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataValidationError, SchemaError
from ..functions.quality import valid_value
from . import ranks


class Stat(str, Enum):
    MEAN = "mean"
    MEDIAN = "median"
    STD = "std"
    MIN = "min"
    MAX = "max"
    COUNT = "count"
    QUANTILES = "quantiles"


class OutputFormat(str, Enum):
    TIDY = "tidy"
    WIDE = "wide"


QUANTILES = (0.05, 0.25, 0.75, 0.95)


def nearest_place(n: Column, q: float) -> Column:
    """The place (from 0) of a quantile among ``n`` sorted values: round((n - 1) * q), half away from zero."""
    return F.floor((n - 1) * F.lit(float(q)) + 0.5)


def describe(df: DataFrame, value_cols: list[str], group_by: list[str] | None = None, category_col: str | None = None, flag_col: str = "flag", output: OutputFormat = OutputFormat.TIDY, stats: list[Stat] | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """keys, n_total, n_valid, n_missing, stat, value, value_col_name; wide: a column for each statistic.

    n_total counts all rows; a missing flag column turns quality control off; a null flag is valid; a null key is a
    group of its own; groups that lose all rows keep null statistics. All value columns share one aggregation; quantiles and
    the median, all exact, share two more passes that never gather a group.
    """
    keys = [*(group_by or []), *([category_col] if category_col else [])]
    for name in [*value_cols, *keys]:
        if name not in df.columns:
            raise SchemaError(f"column {name!r} isn't there")
    for name in value_cols:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise DataValidationError(f"column {name!r} isn't numeric")
    stats = [Stat(s) for s in stats] if stats is not None else list(Stat)
    flag = F.col(f"`{flag_col}`") if flag_col in df.columns else None
    k = [f"_k{i}" for i in range(len(keys))]  # names of our own: a key may be called like a statistic
    narrow = df.select(*(F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)), *(valid_value(F.col(f"`{c}`").cast("double"), flag).alias(f"_v{i}") for i, c in enumerate(value_cols)))
    plain = {Stat.MEAN: F.avg, Stat.STD: F.stddev_samp, Stat.MIN: F.min, Stat.MAX: F.max}
    wanted = {f"_q{j}": nearest_place(F.col("_all"), q) for j, q in enumerate(quantiles)} if Stat.QUANTILES in stats else {}
    if Stat.MEDIAN in stats:
        wanted |= {"_low": F.floor((F.col("_all") - 1) / 2), "_high": F.floor(F.col("_all") / 2)}
    names = [s.value for s in stats if s is Stat.MEDIAN or s in plain] + ([f"q{round(q * 100):02d}" for q in quantiles] if Stat.QUANTILES in stats else [])
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for i in range(len(value_cols)):
        v = F.col(f"_v{i}")
        aggs += [F.count(v).alias(f"_n{i}"), *(f(v).alias(f"_{s.value}{i}") for s, f in plain.items() if s in stats)]

    def row(i: int) -> Column:
        n = F.col(f"_n{i}")
        cols = [F.lit(i).alias("_i"), n.alias("n_valid"), (F.col("n_total") - n).alias("n_missing")]
        return F.struct(*cols, *(F.col(f"_{s.value}{i}").alias(s.value) for s in stats if s in plain))

    rows = narrow.groupBy(*k).agg(*aggs).select(*k, "n_total", F.explode(F.array(*(row(i) for i in range(len(value_cols))))).alias("_r")).select(*k, "n_total", "_r.*")
    if wanted:
        values = narrow.select(*k, F.posexplode(F.array(*(f"_v{i}" for i in range(len(value_cols))))).alias("_i", "_v")).where("_v IS NOT NULL")
        found = ranks.at_places(values, [*k, "_i"], "_v", wanted)
        found = found.withColumnsRenamed({c: f"_f{j}" for j, c in enumerate([*k, "_i"])})
        rows = rows.join(found, ranks.same([*k, "_i"], [f"_f{j}" for j in range(len(k) + 1)]), "left")
    places = {f"q{round(q * 100):02d}": F.col(f"_q{j}") for j, q in enumerate(quantiles)} if Stat.QUANTILES in stats else {}
    if Stat.MEDIAN in stats:
        places["median"] = F.col("_low") * 0.5 + F.col("_high") * 0.5
    title = F.element_at(F.array(*(F.lit(c) for c in value_cols)), F.col("_i") + 1)
    wide = rows.select(*(F.col(a).alias(c) for c, a in zip(keys, k)), "n_total", title.alias("value_col_name"), "n_valid", "n_missing", *(places.get(s, F.col(s)).alias(s) for s in names))
    ids = [*keys, "n_total", "n_valid", "n_missing"]
    if OutputFormat(output) is OutputFormat.WIDE:
        return wide.select(*(f"`{k}`" for k in keys), "value_col_name", "n_total", "n_valid", "n_missing", *sorted(names)).orderBy(*(f"`{k}`" for k in keys), "value_col_name")
    if not names:
        return wide.withColumns({"stat": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}).select(*(f"`{k}`" for k in ids), "stat", "value", "value_col_name").limit(0)
    tidy = wide.unpivot([*(F.col(f"`{k}`") for k in ids), F.col("value_col_name")], names, "stat", "value")
    return tidy.select(*(f"`{k}`" for k in ids), "stat", "value", "value_col_name").orderBy(*(f"`{k}`" for k in keys), "value_col_name", "stat")
