"""Row numbers over a global order without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there, so rounds and row numbers are computed once.

    A table, where DataFrame.checkpoint() would compute df twice.
    """
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{tag}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a folder of our own only on a single machine without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanframe-"))


#: Rows that are numbered in one task, after they have been counted.
FEW = 50_000


def with_row_number(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Numbers rows by `order`: range-partitioned sort, a number within each partition, and the sum of the
    partitions before it. Only one count per partition meets in one place. At most FEW rows are numbered by
    a plain window."""
    cols = df.columns
    df = checkpointed(df)
    if df.count() <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") + (start - 1))
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.select("_part", "_before")), "_part").select(*cols, (F.col("_row") + F.col("_before") + start).cast("bigint").alias(name))
