"""Reference blocks: documents stored once, in blocks of a few hundred, with content-chosen anchors.

A window of W symbols contains W - K + 1 runs of K symbols; the run with the least hash is its
anchor. Equal windows have equal anchors, wherever they stand, so windows whose anchor stands
nowhere else need not be looked at again. Few runs are anchors (about 2 in W - K + 2), so only a
small part of the positions is ever shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remember, scratch_path

ROWS_PER_BLOCK = 512
#: Bytes of a text from which on it is a block of its own, so that a block has ROWS_PER_BLOCK times as many at most, or one text.
OWN_BLOCK = 1 << 16
#: Stands for a null id, so that it is larger than any other.
NO_ID = (1 << 63) - 1


def write_blocks(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, row, slot, doc_id, text, rest), written once to a table bucketed by block, without a shuffle.

    Blocks are runs of ROWS_PER_BLOCK rows of a scan partition, but for long texts, which are blocks of their own;
    slot is a row's number in its block. The later passes group and cogroup by block on
    the buckets as they lie, so texts never go through an exchange. rest has the carried columns.
    """
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest.alias("rest"), F.monotonically_increasing_id().alias("row"))
    long = F.octet_length("text") >= OWN_BLOCK
    rows = rows.select(
        F.when(long, -1 - F.col("row")).otherwise(F.floor(F.col("row") / ROWS_PER_BLOCK).cast("bigint")).alias("block"), "row",
        F.when(long, F.lit(0)).otherwise(F.col("row") % ROWS_PER_BLOCK).cast("int").alias("slot"), "doc_id", "text", "rest",
    )
    rows.write.bucketBy(buckets, "block").format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    remember(table=name)
    return spark.table(name)


def enough_buckets(table: DataFrame) -> int:
    """Groups that keys are dealt into: one for about 512 documents, and four for each partition, so that common keys
    that fall into one partition are few."""
    return max(4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // 512)


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def found(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among sorted_keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool), np.zeros(len(x), int)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x, at


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:-1]) > 0
