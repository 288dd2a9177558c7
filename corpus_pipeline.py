"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from tidemark.llm.stages import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
