"""Errors that the library raises."""


class SchemaError(Exception):
    """A column is missing or ambiguous."""


class DataValidationError(Exception):
    """The data can't be used: empty, or of the wrong type."""


class InputValidationError(Exception):
    """An argument isn't what it should be."""


class UnitError(Exception):
    """An unknown unit, or units that don't go together."""


class TimeError(Exception):
    """A time that can't be used."""


class AlgorithmConvergenceError(Exception):
    """An iteration didn't converge."""


class ConfigurationError(Exception):
    """A setting that isn't known or allowed."""


class PerformanceWarning(Warning):
    """Something works but will be slow."""
