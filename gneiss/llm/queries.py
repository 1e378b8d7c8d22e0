"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import op01_warc, op02_mcd, op03_simhash, op04_trie, op05_html, op06_decontaminate, op07_bpe, op08_ppm, op09_winnow, op10_sharding
from .common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    files = op01_warc.pages_to_monolithic(_table(spark, sf_dir, "pages"), f"{folder}/whole")
    return op01_warc.write_index(op01_warc.normalise(spark, files, f"{folder}/members"), f"{folder}/index")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, through whole-stream files, their normalisation and a range read of each record by the index."""
    x = op01_warc.read_records(_normalised(spark, sf_dir))
    return x.selectExpr(
        "CAST(regexp_extract(record_id, '([0-9]+)>', 1) AS BIGINT) AS page_id", "target_uri AS url", "body_length", "body_sha256",
        "CAST(body AS STRING) AS html", "sha2(body, 256) = body_sha256 AS read_back", "error",
    )


def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality rule keeps, with their distances (null: no group large enough)."""
    x = op02_mcd.mahalanobis(_table(spark, sf_dir, "documents"), columns=["doc_id", "lang", "source"])
    return x.where("NOT d2_outlier").select("doc_id", "lang", "source", "d2")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op04_trie.score(docs, op04_trie.train(docs)).drop("text")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_html.extract_text(_table(spark, sf_dir, "pages"))


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), op06_decontaminate.LeakParams(every=True))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and whether decoding them gives the text back."""
    x = op07_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = op07_bpe.decode(x, "token_ids", "decoded")
    return x.selectExpr("doc_id", "token_ids", "n_tokens", "decoded = text AS round_trip")


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return op08_ppm.identify(docs, op08_ppm.train(docs)).drop("text")


def op9_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later repeated runs."""
    return op09_winnow.drop_repeated_lines(_table(spark, sf_dir, "documents"), drop_emptied=False).select("doc_id", "text")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding.shard(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_mcd_outliers,
        op3_simhash_groups,
        op4_lm_scores,
        op5_html_text,
        op6_leaks,
        op7_bpe,
        op8_ppm_language,
        op9_winnow_lines,
        op10_shards,
        pipeline,
    )
}
ORACLE_SQL = {
    "op1_warc": """SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS body_length, sha256(coalesce(html, '')) AS body_sha256,
        coalesce(html, '') AS html, true AS read_back, CAST(NULL AS VARCHAR) AS error FROM pages""",
    "op4_lm_scores": op04_trie.oracle(),
    "op10_shards": op10_sharding.oracle(),
}
