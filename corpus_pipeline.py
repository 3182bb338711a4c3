"""From raw documents to packed token ids, in five stages that each call one operator.

run(spark, sf_dir) applies them to ``documents``: each stage's rows are written
to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import decontaminate, mixing, near_dedup, packing, quality
from starfold.llm.common import load, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts go, repeated rows are judged alike, none of none is none."""
    return quality.judge(docs, filtering=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, its least doc_id.

    Rows without doc_id stay, and so do null and empty texts.  Rows that repeat a
    doc_id stay or go together.
    """
    gone = near_dedup.near_duplicates(docs).filter("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's windows; n_chars follows the text.  Null and empty texts stay, repeated rows lose the same, very long ones are scanned whole.  Other columns of whatever names stay."""
    clean = decontaminate.strip(docs, load(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it, at most twice; null sources are one, null and empty texts count 0 words.  Columns of whatever names stay."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed id matrices; null and empty texts are one end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
#: SQL can express neither the near-duplicate components nor BPE and packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
