"""Image metric tables made from the driver's tables, which hold no images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sign_hash(vector: str) -> Column:
    """64 bits, most significant first: which of 64 numbers lie above their median."""
    bits = F.transform(F.col(vector), lambda x: (x > F.sort_array(vector)[31]).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per embedding, with the columns that image kernels would have made."""
    v = F.col("vec_id")
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".webp", ".txt"))), (v % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        v.alias("ord"),
        F.concat(F.lit("person"), F.col("label").cast("string"), F.lit("/s"), (v % 3).cast("string"), F.lit("/img_"), (v % 50).cast("string"), F.lit("_"), F.floor(v / 50).cast("string"), suffix).alias("rel_path"),
        (256 + (v * 37) % 1800).cast("int").alias("width"),
        (256 + (v * 91) % 1500).cast("int").alias("height"),
        (((v * 7919) % 100000) / F.lit(100.0)).alias("sharpness"),
        (((v * 104729) % 10001) / F.lit(10000.0)).alias("artifact_score"),
        sign_hash("embedding").alias("hash"),
        (v % 4).cast("int").alias("face_count"),
        ((v * 53) % 181 - 90).cast("double").alias("yaw"),
        "label", "embedding",
    )


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns for every row of lineitem, for timing."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        k.alias("ord"), k.cast("string").alias("rel_path"), (256 + (k * 37) % 1800).cast("int").alias("width"), (256 + (k * 91) % 1500).cast("int").alias("height"),
        (((k * 7919) % 100000) / F.lit(100.0)).alias("sharpness"), (((k * 104729) % 10001) / F.lit(10000.0)).alias("artifact_score"), (k % 4).cast("int").alias("face_count"),
    )


#: The same tables for DuckDB.
METRICS_SQL = """
WITH raw AS (SELECT *, list_sort(embedding) AS sorted FROM embeddings),
bits AS (SELECT *, list_transform(embedding, lambda x: CASE WHEN x > sorted[32] THEN 1 ELSE 0 END) AS b FROM raw),
metrics AS (
  SELECT vec_id AS ord,
    'person' || label || '/s' || (vec_id % 3) || '/img_' || (vec_id % 50) || '_' || (vec_id // 50) || ['.jpg', '.PNG', '.webp', '.txt'][vec_id % 4 + 1] AS rel_path,
    (256 + (vec_id * 37) % 1800)::INTEGER AS width, (256 + (vec_id * 91) % 1500)::INTEGER AS height,
    ((vec_id * 7919) % 100000) / 100.0::DOUBLE AS sharpness, ((vec_id * 104729) % 10001) / 10000.0::DOUBLE AS artifact_score,
    array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', (1 + 8 * b[4 * k + 1] + 4 * b[4 * k + 2] + 2 * b[4 * k + 3] + b[4 * k + 4])::BIGINT, 1)), '') AS phash,
    list_reduce(list_prepend(0::HUGEINT, list_transform(b, lambda x: x::HUGEINT)), lambda a, x: a * 2 + x)::UBIGINT AS hash,
    (vec_id % 4)::INTEGER AS face_count, ((vec_id * 53) % 181 - 90)::DOUBLE AS yaw, label, embedding
  FROM bits)
"""
VOLUME_SQL = """
WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem),
metrics AS (SELECT k AS ord, k::VARCHAR AS rel_path, (256 + (k * 37) % 1800)::INTEGER AS width, (256 + (k * 91) % 1500)::INTEGER AS height,
  ((k * 7919) % 100000) / 100.0::DOUBLE AS sharpness, ((k * 104729) % 10001) / 10000.0::DOUBLE AS artifact_score, (k % 4)::INTEGER AS face_count FROM k)
"""
