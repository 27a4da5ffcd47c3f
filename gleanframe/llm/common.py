"""What the training-data operators share: scratch tables, text clean-up, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a single-machine session without that setting (as in tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gleanframe-")
        sc.setCheckpointDir(root)
    return root


#: What this driver has written besides results, in order: folders and tables.
_MADE: list[tuple[str | None, str | None]] = []


def remember(path: str | None = None, table: str | None = None) -> None:
    _MADE.append((path, table))


def made() -> int:
    """How many things have been written so far, for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes the folders and tables written after the first `since`, but for the folder `keep`.

    Results are lazy: call it only when all that was made of them has been written elsewhere.
    """
    gone, _MADE[since:] = _MADE[since:], [m for m in _MADE[since:] if m[0] and m[0] == keep]
    jvm = spark._jvm
    for path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        elif path != keep:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    remember(path)
    return path


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back, and where."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, tag)[0]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is dropped before any shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tidy() -> None:
    """Gives what a Python worker has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidily(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with a tidy() when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


#: Edges that one task unites.
FEW_EDGES = 20_000


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the least node reachable.

    At most FEW_EDGES edges are united by one task, which gives the same result as the rounds.

    Alternating large-star and small-star rounds (Kiveris et al., SOCC 2014). Every round is a
    min-aggregate, which is combined before the shuffle, and an equi-join; no neighbour list is ever
    gathered. The minima are written before they are joined: both sides of the join then come
    straight from exchanges, and AQE can split a hub's rows. So are the edges after each round.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "cc")
    if e.count() <= FEW_EDGES:
        return materialise(_united(e), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-min")
        large = (
            both.join(least.hint("merge"), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = materialise(large, "cc-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = large.join(least.hint("merge"), "u")
        e = materialise(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v").where("u <> v").distinct(),
            "cc",
        )
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
