"""Quality flags: exclusion, masking, and the value that both leave."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError


class QCFlag(str, Enum):
    VALID = "valid"
    BELOW_DL = "below_dl"
    INVALID = "invalid"
    OUTLIER = "outlier"


EXCLUDE_FLAGS = frozenset({QCFlag.INVALID, QCFlag.OUTLIER})
MISSING_FLAGS = frozenset({QCFlag.BELOW_DL})


def _names(flags: Iterable[QCFlag | str]) -> list[str]:
    return sorted(f.value if isinstance(f, QCFlag) else str(f) for f in flags)


def _need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")


def filter_by_qc_flags(df: DataFrame, flag_col: str, exclude_flags: Iterable[QCFlag | str] = EXCLUDE_FLAGS) -> DataFrame:
    """Rows whose flag isn't excluded; rows without a flag go too, as NOT IN has it."""
    _need(df, flag_col)
    names = _names(exclude_flags)
    return df.where(~F.col(flag_col).isin(names)) if names else df


def mark_missing_by_flags(df: DataFrame, conc_col: str, flag_col: str, missing_flags: Iterable[QCFlag | str] = MISSING_FLAGS) -> DataFrame:
    """Null in place of values whose flag marks them as missing."""
    _need(df, conc_col, flag_col)
    names = _names(missing_flags)
    return df.withColumn(conc_col, F.when(F.col(flag_col).isin(names), None).otherwise(F.col(conc_col))) if names else df


def valid_value(value: Column, flag: Column | None) -> Column:
    """The value where its flag neither excludes nor masks it; no flag counts as valid."""
    if flag is None:
        return value
    bad = _names(EXCLUDE_FLAGS | MISSING_FLAGS)
    return F.when(~F.coalesce(flag, F.lit(QCFlag.VALID.value)).isin(bad), value)
