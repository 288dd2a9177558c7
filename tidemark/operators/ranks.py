"""Places in a sorted group without gathering the group in one task.

Values fall into coarse buckets that keep their order. The counts of the buckets, summed up in order, say where each bucket
begins; sorting is then needed inside a bucket only, or only in the buckets that hold a wanted place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of numbers for each factor of e in their size, and of times for each hour.
PER_E, PER_HOUR = 4096, 4


def bucket(c: Column, kind: T.DataType) -> Column:
    """A long that never falls as ``c`` rises, for numbers and times; other kinds share one bucket. Nulls come first, NaN last."""
    if isinstance(kind, T.NumericType):
        v = c.cast("double")
        size = F.least(F.floor(F.least(F.log(F.abs(v)), F.lit(1e6)) * PER_E).cast("long"), F.lit(1 << 40)) + F.lit(1 << 32)
        found = F.when(F.isnan(v), F.lit(1 << 62)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))
        return F.when(v.isNull(), F.lit(-(1 << 62))).otherwise(found)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
        return F.coalesce(F.floor(micros / F.lit(3_600_000_000 // PER_HOUR)).cast("long"), F.lit(-(1 << 62)))
    if isinstance(kind, T.DateType):
        return F.coalesce(F.unix_date(c).cast("long"), F.lit(-(1 << 62)))
    return F.lit(0).cast("long")


def same(left: list[str], right: list[str]) -> Column:
    """Equal keys, null being equal to null; true without keys."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)), F.lit(True))


def starts(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(_s0, _s1, ..., _b, _before, _all) of each bucket ``at`` of a group: the rows before it and those of the group."""
    counts = df.groupBy(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), F.col(at).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*(f"_s{i}" for i in range(len(keys)))).orderBy("_b")
    before = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(*(f"_s{i}" for i in range(len(keys))), "_b", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_all"), "_n")


def placed(df: DataFrame, keys: list[str], at: str | None, order: list[str], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in its group by ``order``, whose first column ``at`` is a bucket of.

    Adds ``_all``, the rows of the group. Sorts inside buckets; a hot group is spread over as many tasks as it has buckets.
    Without ``at`` a group is sorted in one task.
    """
    if at is None:
        group = Window.partitionBy(*keys).orderBy(*order)
        total = F.count(F.lit(1)).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumns({name: F.row_number().over(group), "_all": total})
    begun = starts(df, keys, at).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, at).orderBy(*order))
    names = [f"_s{i}" for i in range(len(keys))]
    ranked = df.withColumn(name, within)
    out = ranked.join(begun, same([*keys, at], [*names, "_b"]))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(*names, "_b", "_before")


def average_ranks(df: DataFrame, keys: list[str], value: str, at: str | None, name: str) -> DataFrame:
    """``df`` with the rank (from 1) of ``value`` in its group; ties share the mean of their ranks. ``at`` as in ``placed``."""
    group = Window.partitionBy(*keys, *([at] if at else [])).orderBy(value)
    # with peers, up to the last of them: the ranks of a tie are those from (count before it) + 1 to this
    least, most = F.rank().over(group), F.count(F.lit(1)).over(group.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = df.withColumn(name, (least + most) / F.lit(2.0))
    if at is None:
        return ranked
    names = [f"_s{i}" for i in range(len(keys))]
    out = ranked.join(starts(df, keys, at).drop("_n", "_all"), same([*keys, at], [*names, "_b"]))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(*names, "_b", "_before")


def at_places(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """(keys, one column for each name of ``wanted``): the values at those places (from 0) of each group sorted by ``value``.

    ``wanted`` gives places from the column ``_all``, the rows of the group. One pass counts buckets; a second reads only the
    buckets that hold a wanted place and counts their values. ``value`` isn't null.
    """
    df = df.select(*keys, value, bucket(F.col(value), T.DoubleType()).alias("_at"))
    names = [f"_s{i}" for i in range(len(keys))]
    def held(place: Column, first: Column, n: Column) -> Column:
        return (place >= first) & (place < first + n)

    hist = starts(df, keys, "_at")
    hist = hist.where(reduce(lambda a, b: a | b, (held(c, F.col("_before"), F.col("_n")) for c in wanted.values()))).drop("_n")
    hits = df.join(hist.select(*names, "_b"), same([*keys, "_at"], [*names, "_b"]), "left_semi")
    counts = hits.groupBy(*keys, "_at", value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_at").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("_upto", upto).join(hist, same([*keys, "_at"], [*names, "_b"]))
    found = found.withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n"))
    picks = (F.max(F.when(held(c, F.col("_first"), F.col("_n")), F.col(value))).alias(k) for k, c in wanted.items())
    return found.groupBy(*keys).agg(*picks)
