"""tidemark: measurement analytics on PySpark, planned by Catalyst end to end."""

__version__ = "0.1.0"

from .functions.units import Unit, can_convert, convert_values, get_factor, round_for_reporting, validate_units_schema  # noqa: E402
from .operators.timeops import TimeBounds, ensure_timezone_aware, resample_mean, rolling_window_mean, to_utc  # noqa: E402
from .operators.timeops import time_bounds as compute_time_bounds  # noqa: E402


def hello() -> str:
    return "Hello from tidemark!"


__all__ = [
    "TimeBounds",
    "Unit",
    "__version__",
    "can_convert",
    "compute_time_bounds",
    "convert_values",
    "ensure_timezone_aware",
    "get_factor",
    "hello",
    "resample_mean",
    "rolling_window_mean",
    "round_for_reporting",
    "to_utc",
    "validate_units_schema",
]
