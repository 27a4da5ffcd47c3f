"""Finished scans as a Parquet table partitioned by scan, beside a table of their summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import scan_key
from ..operators.summary import page, rows_as_dicts


class ScanStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.summaries = f"{path}/_summaries"

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _has(self, table: str, scan_id: str) -> bool:
        files, jvm = self._files()
        return files.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/scan_id={scan_key(scan_id)}"))

    def _write(self, rows: DataFrame, scan_id: str, table: str) -> None:
        rows = rows.withColumn("scan_id", F.lit(scan_key(scan_id)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(table)

    def save(self, scan_id: str, images: DataFrame, summary: dict | None = None) -> None:
        """Replaces this scan's partition and leaves the others; summary is anything that JSON can hold."""
        self._write(images, scan_id, self.path)
        self._write(self.spark.createDataFrame([(json.dumps(summary or {}),)], "summary string"), scan_id, self.summaries)

    def load(self, scan_id: str) -> DataFrame | None:
        """One partition is read; null if there is none."""
        if not self._has(self.path, scan_id):
            return None
        return self.spark.read.parquet(f"{self.path}/scan_id={scan_key(scan_id)}")

    def load_summary(self, scan_id: str) -> dict | None:
        if not self._has(self.summaries, scan_id):
            return None
        return json.loads(self.spark.read.parquet(f"{self.summaries}/scan_id={scan_key(scan_id)}").first()["summary"])

    def load_page(self, scan_id: str, offset: int = 0, limit: int | None = None) -> DataFrame | None:
        rows = self.load(scan_id)
        return None if rows is None else page(rows, offset, limit)

    def page_with_totals(self, scan_id: str, offset: int = 0, limit: int | None = None) -> dict | None:
        """The stored summary, whose totals stay those of the whole scan, with a page of results."""
        rows = self.load_page(scan_id, offset, limit)
        if rows is None:
            return None
        found = rows_as_dicts(rows)
        return (self.load_summary(scan_id) or {}) | {"offset": offset, "limit": limit, "returned": len(found), "results": found}

    def scan_ids(self) -> list[str]:
        files, jvm = self._files()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(n.removeprefix("scan_id=") for n in names if n.startswith("scan_id="))

    def delete(self, scan_id: str) -> bool:
        files, jvm = self._files()
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.summaries}/scan_id={scan_key(scan_id)}"), True)
        return files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/scan_id={scan_key(scan_id)}"), True)
