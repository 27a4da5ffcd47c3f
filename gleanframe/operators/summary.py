"""Counts, tallies, orders and pages of scans."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import reject_key


def counts(images: DataFrame) -> DataFrame:
    def n(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), 1))

    return images.agg(F.count("*").alias("total"), n("passed").alias("passed"), n("not passed").alias("rejected"), n("passed and is_duplicate").alias("duplicates"))


def reject_tally(images: DataFrame) -> DataFrame:
    """(reason, n) by falling count, then first appearance."""
    out = images.where("not passed").groupBy(reject_key(F.col("reject_reason")).alias("reason")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return out.orderBy(F.col("n").desc(), "first_ord")


def pose_distribution(images: DataFrame) -> DataFrame:
    return images.where("primary_face_pose is not null").groupBy("primary_face_pose").agg(F.count("*").alias("n")).orderBy("primary_face_pose")


def rows_as_dicts(rows: DataFrame) -> list[dict]:
    """Rows of a page as JSON objects, in their order, with their nulls."""
    return [json.loads(r.value) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect()]


def page(images: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of results in collection order; past the end it is empty."""
    if offset < 0 or (limit is not None and limit < 1):
        raise ValueError("offset must be 0 or more and limit 1 or more")
    rows = images.orderBy("ord").offset(offset)
    return rows if limit is None else rows.limit(limit)
