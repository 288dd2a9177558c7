"""Where intermediate tables go: the folder that the cluster shares, named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this process where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and any executor can read it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(docs: DataFrame, column: str, run, fields: dict[str, str]) -> DataFrame:
    """The rows with new columns from ``run``, which gets Arrow batches of (kept, t) and gives (kept, *fields). Whatever the
    other columns are called they pass through; those named like a new one are replaced."""
    keep = [c for c in docs.columns if c not in fields] or [column]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{column}`").alias("t"))
    schema = rows.select("kept").schema
    for name, kind in fields.items():
        schema = schema.add(f"new_{name}", kind)
    found = rows.mapInArrow(run, schema)
    kept = [F.col(f"kept.`{c}`") for c in keep if c not in fields]
    return found.select(*kept, *(F.col(f"`new_{c}`").alias(c) for c in fields))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once an application: they need not share the driver's folders."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        with zipfile.ZipFile(file := f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark-src.zip", "w") as z:
            for p in sorted((root / "tidemark").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(file)
        _shipped.add(sc.applicationId)
