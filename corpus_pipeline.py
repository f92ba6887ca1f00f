"""Raw documents to packed sequences: quality, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import exact, packing, quality, simhash
from strandlog.llm.common import staged

#: Each takes (spark, what the stage before kept, sf_dir); the first takes documents.
STAGES = [
    ("op1_quality_classifier", quality.keep_good),
    ("op5_exact_dedup", exact.keep_one),
    ("op10_simhash", simhash.keep_one),
    ("op8_packing", packing.stage),
]

#: SQL has neither the classifier's fit nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; what each other keeps is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        df = staged(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
