"""The corpus pipeline: each stage reads what its predecessor wrote and works on all of it.

Documents in, token ids out: quality rules drop outliers, line dedup deletes repeated runs (and the documents of which nothing is left),
near duplicates leave one document of each group, contaminated documents go, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gneiss.llm import op02_mcd, op03_simhash, op06_decontaminate, op07_bpe, op09_winnow
from gneiss.llm.common import materialise, tidy, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_mcd.keep_inliers(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_winnow.drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), op06_decontaminate.LeakParams(every=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of each document, with its token ids and their number."""
    return op07_bpe.encode(docs.select("doc_id", "lang", "source", "text")).drop("text")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("BPE encoding", encode)]

#: Covariance estimates, SimHash and BPE are beyond SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = written()
        out = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        tidy(out, before, docs)
        docs = out
    return docs
