"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity -> exact dedup -> SimHash near-dedup -> suffix-array dedup -> best-fit packing. Each stage
takes (spark, docs, sf_dir); all but the last return the columns of documents. Rows that repeat an
id and a text count as copies of one another, and one of them stays. Null texts count as empty ones, of
which one row stays, and have no repeats; null ids lose to others among equal texts. Very long texts pass
whole through every stage. Extra columns of documents are carried up to the last stage; a table without rows stays one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanframe.llm import simhash, suffix_dedup, toxicity
from gleanframe.llm.common import made, release, scratch_path, written
from gleanframe.llm.exact_dedup import DigestIndex, exact_dedup
from gleanframe.llm.packing import pack


#: Families of fingerprints of the near-duplicate stage.
FAMILIES = 16


def _only(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The rows of docs that kept (doc_id, key) names, one for each; texts are shuffled once."""
    named = docs.withColumn("_key", key)
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("key").alias("_kept")).hint("merge")
    rows = named.join(kept, (F.col("_key") == F.col("_kept")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    one = Window.partitionBy("_key", "doc_id").orderBy(F.lit(0))
    return rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    found = exact_dedup(docs, DigestIndex(spark, scratch_path(spark, "index"))).where("kept")
    return _only(docs, found.select("doc_id", F.col("text_sha256").alias("key")), F.sha2(F.coalesce("text", F.lit("")), 256))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints link the one with the least id stays.

    Shingles have five words. Texts of similarity 0.8 differ in about 10 of 64 bits, which no tree can
    search for, so documents link if in any of FAMILIES families they differ in 4 bits at most.
    """
    found = simhash.near_duplicates(docs, shingle=5, families=FAMILIES).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return _only(docs, found.select("doc_id", F.col("text_key").alias("key")), F.xxhash64(F.coalesce("text", F.lit(""))))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go, so that passages of over 50 words are found; a character of which bytes went goes with them; n_chars follows."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = suffix_dedup.dedup_spans(docs, window=200, carry=others)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    columns |= {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("suffix_array_dedup", suffix_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained scores and byte strings have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written; what was written on the way to it, and the output before it, go."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, begun, path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
