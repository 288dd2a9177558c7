"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

Defined cases, beside those of the operators: null and empty texts fail the base rules and go in the first stage; rows of one
id are one document, of which the duplicate stage keeps one row (that with the smallest hash of its text); rows without an
id are in no class and stay; an empty table gives an empty result; columns of any other name pass through up to the last
stage, but a column ``_q`` is dropped by the first and ``_n``, ``_spans``, ``_items``, ``_near``, ``_units``, ``_removed``, ``_runs``
and ``_kept`` are filled anew by the stages that use them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontaminate, jaccard, packing, quality_rules, repeats
from .scratch import shared_dir, ship, written


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole."""
    return quality_rules.judged(docs).where("_q.kept").drop("_q")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id, once; rows without an id stay."""
    ship(spark)
    gone = jaccard.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")  # dealt by id already
    taken = f"_{max(map(len, docs.columns)) * '_'}"
    named = named.withColumn(taken, F.row_number().over(again)).where(F.col(taken) == 1)
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a passage of an earlier document; n_chars follows. Untouched texts keep their form."""
    ship(spark)
    found = repeats.covered_text(docs, repeats.Words(13), keep=docs.columns)
    text = F.when(F.col("_removed") > 0, F.col("_kept").cast("string")).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return found.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, in its words' order or near one another."""
    ship(spark)
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where((F.coalesce(F.size("_items"), F.lit(0)) <= 0) & (F.coalesce(F.size("_near"), F.lit(0)) <= 0)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    ship(spark)
    import public_tokenizers

    return packing.pack(written(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [
    ("quality_rules", rules_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
