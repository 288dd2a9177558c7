"""Run-once analysis jobs: settings, validation, one computation, provenance, a dashboard payload and a text report.

A job's result is one lazy frame for each operation, collected once, when the run ends: results are small (keys x statistics),
and both reports work on them alone.
"""

from __future__ import annotations

import math
import time
from collections.abc import Mapping
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame

from .. import __version__
from ..errors import ConfigurationError, DataValidationError, UnitError
from ..functions.units import TimeUnit, Unit
from ..operators import correlate, describe, timeops, trend
from ..sources.series import Measurements, map_columns
from .provenance import get_logger, make_provenance


class Domain(str, Enum):
    """What a job may belong to."""

    QC = "qc"
    SOURCE_APPORTIONMENT = "source_apportionment"
    HEALTH = "health"
    VISUALIZATION = "visualization"
    STATISTICS = "statistics"


class Job:
    """Subclasses name their settings and say how to compute, and what their reports add."""

    Config: type[Enum]
    #: Keys that metadata may have.
    Metadata: type[Enum] = Enum("Metadata", {"TITLE": "title", "DESCRIPTION": "description", "AUTHOR": "author"})
    name = "job"
    domain = Domain.STATISTICS
    schema_version = "1.0.0"
    synonyms: Mapping[str, list[str]] = {}

    def __init__(self, dataset: Measurements, config: Mapping | None = None, metadata: Mapping | None = None, mapping=None) -> None:
        for k in config or {}:
            if not isinstance(k, self.Config):
                raise ConfigurationError(f"setting {k!r} isn't a {self.Config.__name__}")
        for k in metadata or {}:
            if not isinstance(k, self.Metadata):
                raise ConfigurationError(f"metadata key {k!r} isn't a {self.Metadata.__name__}")
        self.log = get_logger(f"tidemark.{self.name}", domain=self.domain.value)
        self.dataset, self.config, self.metadata, self.mapping = dataset, dict(config or {}), dict(metadata or {}), mapping
        self.validate_config()
        self.results: dict = {}
        self.provenance = None

    @classmethod
    def from_dataset(cls, dataset: Measurements, *, config=None, metadata=None):
        return cls(dataset, config, metadata)

    @classmethod
    def from_dataframe(cls, df: DataFrame, *, config=None, column_mapping=None, metadata=None, required=None, units=None):
        """Columns resolve onto canonical names; ``units`` goes to the dataset."""
        found = map_columns(df, required=list(required or cls.synonyms), synonyms=cls.synonyms, explicit=column_mapping)
        return cls(Measurements(found.frame, units=units, mapping=found.mapping), config, metadata, found)

    def setting(self, name: str, default=None):
        return self.config.get(self.Config[name], default)

    def validate_config(self) -> None:
        pass

    def validate_dataset(self) -> None:
        """Checks before the run; subclasses call this one first."""
        if self.dataset.is_empty():
            raise DataValidationError(f"{self.name}: there are no rows")

    def compute(self, operations) -> dict:
        raise NotImplementedError

    def post_process(self) -> None:
        """Called once the results are there, before provenance is kept."""

    def run(self, operations=None):
        if self.provenance:
            raise RuntimeError("this job has run")
        self.validate_dataset()
        began = time.perf_counter()
        self.results = self.compute(operations)
        self.post_process()
        took = time.perf_counter() - began
        self.provenance = make_provenance(self.name, self.domain, self.dataset.get_dataset_id(), self.config, __version__, {"elapsed_seconds": took})
        self.log.info("run ended after %.3f s", took)
        return self

    def _ran(self) -> None:
        if not self.provenance:
            raise RuntimeError("run the job first")

    def metrics(self) -> dict:
        return {k: v if not hasattr(v, "to_dict") else [{c: _json(x) for c, x in r.items()} for r in v.to_dict("records")] for k, v in self.results.items()}

    def report_dashboard(self) -> dict:
        self._ran()
        return {"module": self.name, "domain": self.domain.value, "schema_version": self.schema_version, "provenance": self.provenance.to_dict(), "metrics": self.metrics()}

    def report_cli(self) -> str:
        self._ran()
        lines = [f"== {self.name} ({self.domain.value}) ==", f"Rows: {self.dataset.n_rows}", f"Columns: {', '.join(self.dataset.schema)}"]
        if self.mapping:
            lines.append("Mapping: " + ", ".join(f"{c} <- {o}" for c, o in self.mapping.mapping.items()))
        lines += self.body()
        return "\n".join([*lines, f"Config hash: {self.provenance.config_hash}", f"Run at: {self.provenance.run_timestamp}"])

    def body(self) -> list[str]:
        return [f"{k}:\n{v.to_string(index=False) if hasattr(v, 'to_string') else v}" for k, v in self.results.items()]


def _json(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return x.isoformat() if hasattr(x, "isoformat") else x.item() if hasattr(x, "item") else x


class RowCountJob(Job):
    class Config(Enum):
        pass

    name, domain = "row_count", Domain.QC

    def compute(self, operations) -> dict:
        return {"row_count": self.dataset.n_rows, "is_empty": self.dataset.n_rows == 0}


class DescriptiveJob(Job):
    class Config(Enum):
        GROUP_BY = "group_by"
        VALUE_COLS = "value_cols"
        CATEGORY_COL = "category_col"
        FLAG_COL = "flag_col"
        STATS = "stats"
        QUANTILES = "quantiles"
        OUTPUT_FORMAT = "output_format"

    name = "descriptive_stats"
    synonyms = {"datetime": ["timestamp", "ts"], "site_id": ["site"], "pollutant": ["species_id"], "conc": ["value", "concentration"]}

    def validate_config(self) -> None:
        for q in self.setting("QUANTILES", describe.QUANTILES):
            if not 0 <= q <= 1:
                raise ConfigurationError(f"quantile {q} isn't between 0 and 1")

    def compute(self, operations) -> dict:
        out = describe.describe(self.dataset.frame, self.setting("VALUE_COLS", ["conc"]), self.setting("GROUP_BY"), self.setting("CATEGORY_COL", "pollutant"), self.setting("FLAG_COL", "flag"), self.setting("OUTPUT_FORMAT", "tidy"), operations or self.setting("STATS"), tuple(self.setting("QUANTILES", describe.QUANTILES)))
        return {"statistics": out.toPandas(), "time_bounds": timeops.time_bounds(self.dataset.frame, self.dataset.time_col)}

    def totals(self) -> dict:
        """Counts over each group and value column once, whatever the number of statistics."""
        t = self.results["statistics"]
        keys = [c for c in t.columns if c not in ("stat", "value", *(s.value for s in describe.Stat)) and not c.startswith("q")]
        once = t[keys].drop_duplicates()
        return {c: int(once[c].sum()) for c in ("n_total", "n_valid", "n_missing")}

    def body(self) -> list[str]:
        b, t = self.results["time_bounds"], self.totals()
        lines = [f"Period: {b.start.isoformat()} to {b.end.isoformat()}", f"Rows: {t['n_total']}, valid {t['n_valid']}, missing {t['n_missing']}"]
        return [*lines, self.results["statistics"].to_string(index=False)]

    def metrics(self) -> dict:
        b = self.results["time_bounds"]
        rows = [{c: _json(x) for c, x in r.items()} for r in self.results["statistics"].to_dict("records")]
        return {"statistics": rows, "totals": self.totals(), "time_bounds": {"start": b.start.isoformat(), "end": b.end.isoformat()}}


class CorrelationJob(Job):
    class Config(Enum):
        GROUP_BY = "group_by"
        VALUE_COLS = "value_cols"
        CATEGORY_COL = "category_col"
        FLAG_COL = "flag_col"
        ORDER_BY = "order_by"
        MIN_SAMPLES = "min_samples"
        ALLOW_MISSING_UNITS = "allow_missing_units"
        OUTPUT_FORMAT = "output_format"

    name = "correlation"

    def validate_config(self) -> None:
        n = self.setting("MIN_SAMPLES", correlate.MIN_SAMPLES)
        if not isinstance(n, int) or n < 2:
            raise ValueError("min_samples must be a whole number of at least 2")

    def units_status(self) -> str:
        cols = self._cols()
        known = self.dataset.units or {}
        return "present" if all(c in known for c in cols) else "overridden" if self.setting("ALLOW_MISSING_UNITS", False) else "missing"

    def _cols(self) -> list[str]:
        cols = self.setting("VALUE_COLS", "conc")
        return [cols] if isinstance(cols, str) else list(cols)

    def compute(self, operations) -> dict:
        allow, units = self.setting("ALLOW_MISSING_UNITS", False), self.dataset.units or {}
        families = {Unit.parse(units[c]).family for c in self._cols() if c in units}
        if len(families) > 1 and not allow:
            raise UnitError("the value columns' units are of several families")
        out = {}
        for m in operations or [correlate.Method.PEARSON]:
            m = correlate.Method(m)
            found = correlate.correlate(self.dataset.frame, self.setting("ORDER_BY", [self.dataset.time_col]), self.setting("GROUP_BY"), m, self.setting("CATEGORY_COL", "pollutant"), self._cols(), self.setting("FLAG_COL", "flag"), self.setting("MIN_SAMPLES", correlate.MIN_SAMPLES), units, allow, self.setting("OUTPUT_FORMAT", "tidy") == "wide")
            out[m.value] = found.toPandas()
        return out | {"units_status": self.units_status()}

    def body(self) -> list[str]:
        """For each method a matrix and its extremes; with groups, a table for each of them."""
        groups, lines = list(self.setting("GROUP_BY") or []), [f"Units: {self.results['units_status']}"]
        for method, found in ((k, v) for k, v in self.results.items() if k != "units_status"):
            lines.append(f"{method}:")
            if "var_y" not in found.columns:
                lines.append(found.to_string(index=False))
            elif groups:
                for values, part in found.groupby(groups, dropna=False, sort=True):
                    lines += [", ".join(f"{c}={v}" for c, v in zip(groups, values)), part.drop(columns=groups).to_string(index=False)]
            else:
                for name, part in found.groupby("value_col_name"):
                    lines += [f"[{name}]", matrix(part).to_string(float_format="{:6.3f}".format), *extremes(part)]
        return lines


def matrix(tidy: pd.DataFrame) -> pd.DataFrame:
    """Both halves of the pairs as a square, with 1 on its diagonal."""
    names = sorted({*tidy["var_x"], *tidy["var_y"]})
    out = pd.DataFrame(float("nan"), index=names, columns=names)
    for x, y, r in zip(tidy["var_x"], tidy["var_y"], tidy["correlation"]):
        out.loc[x, y] = out.loc[y, x] = 1.0 if x == y else r
    return out


def extremes(tidy: pd.DataFrame, k: int = 3) -> list[str]:
    """The k most positive and most negative pairs of different categories."""
    pairs = tidy[(tidy["var_x"] != tidy["var_y"]) & tidy["correlation"].notna()].sort_values(["correlation", "var_x", "var_y"])
    lines = []
    for title, part in (("Strongest positive:", pairs.iloc[::-1].head(k)), ("Strongest negative:", pairs.head(k))):
        lines.append(title)
        lines += [f"  {x} - {y}: {r:.3f} (n={n})" for x, y, r, n in zip(part["var_x"], part["var_y"], part["correlation"], part["n"])]
    return lines


class TrendJob(Job):
    class Config(Enum):
        GROUP_BY = "group_by"
        VALUE_COL = "value_col"
        CATEGORY_COL = "category_col"
        FLAG_COL = "flag_col"
        TIME_UNIT = "time_unit"
        MIN_SAMPLES = "min_samples"
        MIN_DURATION_YEARS = "min_duration_years"
        ALLOW_MISSING_UNITS = "allow_missing_units"

    name = "trend"

    def validate_config(self) -> None:
        unit = self.setting("TIME_UNIT", TimeUnit.DAY)
        if not isinstance(unit, (str, TimeUnit)):
            raise TypeError(f"the time unit must be a TimeUnit or its name, not {type(unit).__name__}")
        TimeUnit(unit)
        n = self.setting("MIN_SAMPLES", 3)
        if not isinstance(n, int) or n < 2:
            raise ValueError("min_samples must be a whole number of at least 2")

    def compute(self, operations) -> dict:
        unit = TimeUnit(self.setting("TIME_UNIT", TimeUnit.DAY))
        found = trend.linear_trend(self.dataset.frame, unit, self.setting("CATEGORY_COL", "pollutant"), self.dataset.time_col, self.setting("VALUE_COL", "concentration"), self.setting("FLAG_COL", "flag"), self.setting("GROUP_BY"), self.setting("MIN_SAMPLES", 3), self.setting("MIN_DURATION_YEARS", 1.0), self.dataset.units, self.setting("ALLOW_MISSING_UNITS", False))
        return {"linear_trend": found.toPandas()}

    def body(self) -> list[str]:
        """A line for each series; an r squared that isn't there is shown as such."""
        found = self.results["linear_trend"]
        keys = list(found.columns[: list(found.columns).index("slope")])
        lines = ["linear_trend:"]
        for row in found.to_dict("records"):
            r2 = "none" if _json(row["r_squared"]) is None else f"{row['r_squared']:.4f}"
            flags = ", ".join(c for c in ("short_duration_flag", "low_n_flag") if row[c])
            lines.append(f"{', '.join(f'{k}={row[k]}' for k in keys)}: slope {row['slope']:.6g} {row['slope_units']}, intercept {row['intercept']:.6g}, r2 {r2}, n {row['n']}{f' ({flags})' if flags else ''}")
        return lines
