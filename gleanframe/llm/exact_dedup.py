"""Exact dedup by a persistent digest index, bucketed and sorted by digest. [native]

Nulls: a null text counts as empty, a null id is kept as null and loses to any other id.
Empty tables give empty results; repeated rows are members of one group like any other rows. A very
long text is hashed whole and travels as its digest. In a later batch the row that the index already
has stays, whatever the new ids are, and group_size counts the rows of all batches up to this one.
Only the id and the text are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, remember


class DigestIndex:
    """A table (sha256, keep_id, group_size, first) in `buckets` buckets, each sorted by sha256.

    New digests are found by a sort-merge anti-join that reads the index in place (its side has
    no exchange, being bucketed by the join key) and are appended; those it knows are appended as
    further counts (first is false). An index without a name is scratch. A batch is reduced to one row per digest by a combined aggregate
    before it meets the index, so a group of copies of any size adds one row to the join.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (sha256 STRING, keep_id BIGINT, group_size BIGINT, first BOOLEAN) USING parquet "
            f"CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

        if name is None:
            remember(table=self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha256"))

    @staticmethod
    def batch(digests: DataFrame) -> DataFrame:
        """One row per digest; of equal new texts the largest id is kept."""
        return digests.groupBy("sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    def append(self, batch: DataFrame) -> None:
        known = self.table().where("first").select("sha256").hint("merge")
        if not self.table().isEmpty():
            self._write(batch.join(known, "sha256", "left_semi").select("sha256", F.lit(None).cast("bigint").alias("keep_id"), "group_size", F.lit(False).alias("first")))
        self._write(batch.join(known, "sha256", "left_anti").select("sha256", "keep_id", "group_size", F.lit(True).alias("first")))

    def _write(self, rows: DataFrame) -> None:
        # the join has dealt the rows as the table's buckets are, so each task writes one bucket
        rows.write.bucketBy(self.buckets, "sha256").sortBy("sha256").format("parquet").option("path", self.path).mode("append").saveAsTable(self.name)

    def resolve(self, digests: DataFrame, batch: DataFrame, hot_share: int = 1024) -> DataFrame:
        """Every row of digests with the row of the index that stands for its text.

        Digests with more than 1/hot_share of the rows of this batch number below hot_share, so they
        are broadcast and their rows take a key of their own; the others meet the bucketed index in a
        sort-merge join in which no key has more than that share.
        """
        index = self.table().groupBy("sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        total = batch.agg(F.sum("group_size")).first()[0] or 0
        often = batch.where(F.col("group_size") > max(1, total // hot_share)).select("sha256")
        hot = index.join(F.broadcast(often), "sha256", "left_semi").select("sha256", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
        marked = digests.join(F.broadcast(hot), "sha256", "left").withColumn(
            "key", F.when(F.col("hot_size").isNull(), F.col("sha256")).otherwise(F.concat(F.lit("hot "), F.xxhash64("doc_id").cast("string")))
        )
        cold = index.select(F.col("sha256").alias("key"), "keep_id", "group_size").hint("merge")
        keep, size = F.coalesce("hot_id", "keep_id"), F.coalesce("hot_size", "group_size")
        return marked.join(cold, "key", "left").select(
            "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256")
        )


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append docs' digests to the index; one row per row of docs says which row stands for its text.

    Rows that repeat an id and a text agree on keep_id and are all marked kept.
    """
    digests = materialise(DigestIndex.digests(docs, id_col, text_col), "digests")
    batch = materialise(DigestIndex.batch(digests), "batch")
    index.append(batch)
    return index.resolve(digests, batch)
