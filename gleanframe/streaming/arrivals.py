"""Scores of metric rows as they arrive: gates and scores are row-local, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..config import ScanConfig, TargetProfile
from ..functions.scoring import with_gates, with_score


def scored_stream(spark: SparkSession, path: str, schema: StructType, profile: TargetProfile = TargetProfile(), cfg: ScanConfig = ScanConfig(), faces_known: bool = True) -> DataFrame:
    """A streaming DataFrame of scored rows from Parquet files dropped into a folder."""
    return with_score(with_gates(spark.readStream.schema(schema).parquet(path), cfg), profile, cfg, faces_known)
