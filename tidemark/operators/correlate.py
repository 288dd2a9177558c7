"""Pairwise correlation of categories, paired by their place in a stated order."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, SchemaError, UnitError
from ..functions.quality import filter_by_qc_flags, mark_missing_by_flags
from . import ranks

MIN_SAMPLES = 3


class Method(str, Enum):
    PEARSON = "pearson"
    SPEARMAN = "spearman"


def pearson(x: Column, y: Column) -> Column:
    """Two-pass centred moments; NaN for fewer than two pairs or a constant side."""
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.coalesce(r, F.lit(float("nan")))


def correlate(df: DataFrame, order_by: list[str], group_by: list[str] | None = None, method: Method | str = Method.PEARSON, category_col: str = "pollutant", value_cols: list[str] | str = "conc", flag_col: str = "flag", min_samples: int = MIN_SAMPLES, units: dict | None = None, allow_missing_units: bool = False, wide: bool = False, categories: list[str] | None = None, spread: bool | None = None) -> DataFrame:
    """group columns, var_x, var_y, correlation, n, value_col_name for var_x <= var_y; wide: var_y become columns.

    Rows with a null flag, category or value go. A category counts in every group if it has ``min_samples`` rows in
    some group. Wide with ``categories`` names the columns and so needs no pass to find them. Values pair by their place in ``order_by`` within (group, category), up to the shorter of the two.
    With ``spread`` places and ranks are taken in coarse buckets of the first order column and of the value, so that no
    category is sorted in one task; that costs one more pass each. By default so without group columns; give True for a hot group.
    """
    try:
        method = Method(method)
    except ValueError:
        raise ConfigurationError(f"unknown method {method!r}") from None
    value_cols, groups = [value_cols] if isinstance(value_cols, str) else list(value_cols), list(group_by or [])
    for name in [*groups, category_col, *value_cols, *order_by]:
        if name not in df.columns:
            raise SchemaError(f"column {name!r} isn't there")
    if not allow_missing_units and (gone := [c for c in value_cols if c not in (units or {})]):
        raise UnitError(f"no unit for: {', '.join(gone)}")
    g = [f"_g{i}" for i in range(len(groups))]
    at = "_at" if (not groups if spread is None else spread) else None
    parts = []
    for name in value_cols:
        kept = mark_missing_by_flags(filter_by_qc_flags(df, flag_col), name, flag_col)
        kept = kept.select(*(F.col(c).alias(a) for c, a in zip(groups, g)), F.col(category_col).alias("cat"), F.col(name).cast("double").alias("v"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)))
        kept = kept.where(F.col("cat").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
        sizes = kept.groupBy(*g, "cat").agg(F.count(F.lit(1)).alias("_all"))
        able = sizes.where(F.col("_all") >= min_samples).select("cat").distinct()
        kept = kept.join(able, "cat", "left_semi").withColumn("_at", ranks.bucket(F.col("_o0"), df.schema[order_by[0]].dataType))
        base = ranks.placed(kept, [*g, "cat"], at, [*(f"_o{i}" for i in range(len(order_by))), "v"], "rn").select(*g, "cat", "v", "rn", "_all")
        if method is Method.SPEARMAN:
            # a value's rank depends on its category and on how many of its first places are paired, not on the other category
            lengths = sizes.join(able, "cat", "left_semi").groupBy(*(F.col(c).alias(f"l{c}") for c in g)).agg(F.collect_set("_all").alias("_ms"))  # one for each category
            lengths = base.join(lengths, ranks.same(g, [f"l{c}" for c in g])).withColumn("m", F.explode("_ms"))
            base = lengths.where((F.col("rn") <= F.col("m")) & (F.col("m") <= F.col("_all")))
            base = base.select(*g, "cat", "m", "rn", "_all", "v", ranks.bucket(F.col("v"), T.DoubleType()).alias("_at"))
            base = ranks.average_ranks(base, [*g, "cat", "m"], "v", at, "_rank").select(*g, "cat", "m", "rn", "_all", F.col("_rank").alias("v"))
        else:
            base = base.withColumn("m", F.lit(0))
        a = base.select(*(F.col(c).alias(f"a{c}") for c in g), F.col("cat").alias("var_x"), F.col("v").alias("x"), F.col("rn").alias("arn"), F.col("m").alias("am"), F.col("_all").alias("aall"))
        on = (F.col("arn") == F.col("rn")) & (F.col("am") == F.col("m")) & ranks.same([f"a{c}" for c in g], g) & (F.col("var_x") <= F.col("var_y"))
        if method is Method.SPEARMAN:
            on = on & (F.col("m") == F.least("aall", "_all"))
        pairs = a.join(base.withColumnsRenamed({"cat": "var_y", "v": "y"}), on).select(*g, "var_x", "var_y", "x", "y")
        out = pairs.groupBy(*g, "var_x", "var_y").agg(pearson(F.col("x"), F.col("y")).alias("correlation"), F.count(F.lit(1)).alias("n"))
        parts.append(out.select(*(F.col(a).alias(c) for c, a in zip(groups, g)), "var_x", "var_y", "correlation", "n", F.lit(name).alias("value_col_name")))
    tidy = parts[0]
    for p in parts[1:]:
        tidy = tidy.unionByName(p)
    if not wide:
        return tidy
    return tidy.groupBy(*groups, "value_col_name", "var_x").pivot("var_y", categories).agg(F.first("correlation"))


def top_correlations(tidy: DataFrame, k: int = 3, negative: bool = False) -> DataFrame:
    """The k most positive or most negative pairs of different categories."""
    off = tidy.where((F.col("var_x") != F.col("var_y")) & ~F.isnan("correlation"))
    return off.orderBy(F.asc("correlation") if negative else F.desc("correlation"), "var_x", "var_y").limit(k)
