"""Measurements: a lazy DataFrame with its time column, units and metadata; and the resolution of column names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataValidationError, InputValidationError, SchemaError
from ..functions.units import Unit, validate_units_schema


@dataclass(frozen=True)
class ColumnMapping:
    frame: DataFrame
    mapping: dict[str, str]
    diagnostics: dict = field(default_factory=dict)
    candidates: dict[str, list[str]] = field(default_factory=dict)


def map_columns(df: DataFrame, *, required: list[str], synonyms: Mapping[str, list[str]] | None = None, explicit: Mapping[str, str] | None = None) -> ColumnMapping:
    """Resolve names onto canonical ones: explicit, then exact or synonym without regard to case. One rename-projection.

    Several candidates are ambiguous, and that is reported before missing ones. Of columns that differ by case alone
    the last is meant. Null handling is none: names only.
    """
    if not isinstance(df, DataFrame):
        raise InputValidationError("a DataFrame is needed")
    explicit, found, candidates, unclear, missing = dict(explicit or {}), {}, {}, [], []
    for canon, name in explicit.items():
        if name not in df.columns:
            raise SchemaError(f"explicit column {name!r} for {canon!r} isn't there")
        found[canon] = name
    by_lower = {c.lower(): c for c in df.columns}
    for canon in (c for c in required if c not in explicit):
        names = [canon, *(synonyms or {}).get(canon, [])]
        hits = list(dict.fromkeys(by_lower[n.lower()] for n in names if n.lower() in by_lower))
        candidates[canon] = hits
        if len(hits) == 1:
            found[canon] = hits[0]
        else:
            (unclear if hits else missing).append(canon)
    if unclear:
        raise SchemaError("ambiguous columns: " + "; ".join(f"{c}: {', '.join(candidates[c])}" for c in unclear))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}; there are: {', '.join(df.columns)}")
    renamed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))  # so that names differing by case alone stay apart
    at = {c: i for i, c in enumerate(df.columns)}
    frame = renamed.select(*(F.col(f"_{at[name]}").alias(canon) for canon, name in found.items()))
    return ColumnMapping(frame, found, {"explicit": sorted(explicit), "resolved": len(found)}, candidates)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


@dataclass(frozen=True)
class Measurements:
    """Checks, in order: the time column, the units, that there are rows. ``checked`` False skips the emptiness job."""

    frame: DataFrame
    time_col: str = "datetime"
    units: Mapping[str, Unit | str] | None = None
    metadata: Mapping = field(default_factory=dict)
    mapping: Mapping[str, str] = field(default_factory=dict)
    checked: bool = True

    def __post_init__(self) -> None:
        if self.time_col not in self.frame.columns:
            raise SchemaError(f"time column {self.time_col!r} isn't there")
        if self.units is not None:
            if gone := [c for c in self.units if c not in self.frame.columns]:
                raise SchemaError(f"units for columns that aren't there: {', '.join(gone)}")
            object.__setattr__(self, "units", validate_units_schema(dict(self.units)))
        object.__setattr__(self, "frame", nan_to_null(self.frame))
        object.__setattr__(self, "metadata", dict(self.metadata) | ({"column_units": self.units} if self.units else {}))
        if self.checked and self.is_empty():
            raise DataValidationError("there are no rows")

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf, **more) -> Measurements:
        return cls(spark.createDataFrame(pdf), **more)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table, **more) -> Measurements:
        return cls(spark.createDataFrame(table), **more)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, **more) -> Measurements:
        return cls(spark.read.parquet(path), **more)

    @property
    def column_units(self):
        return self.units

    @property
    def schema(self) -> dict[str, str]:
        return dict(self.frame.dtypes)

    @cached_property
    def n_rows(self) -> int:
        return self.frame.count()

    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    def get_column(self, name: str) -> DataFrame:
        if name not in self.frame.columns:
            raise KeyError(name)
        return self.frame.select(f"`{name}`")

    def get_dataset_id(self):
        return self.metadata.get("dataset_id")

    def to_pandas(self):
        return self.frame.toPandas()

    def to_arrow(self):
        return self.frame.toArrow()
