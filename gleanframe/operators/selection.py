"""Which images an export takes, and why the others are left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExportRequest
from .ordering import with_row_number

FARTHEST = 64.0


def with_gate_reasons(images: DataFrame, req: ExportRequest) -> DataFrame:
    """Adds keep_reason: why a row is out, or null where it may be chosen."""
    reason = F.when(F.col("score") < req.min_score, "below-score")
    if not req.include_rejected:
        reason = reason.when(~F.col("passed"), F.when(F.coalesce("reject_reason", F.lit("")) == "", "rejected").otherwise(F.col("reject_reason")))
    if not req.keep_similar:
        reason = reason.when(F.col("is_duplicate"), F.concat(F.lit("similar-to:"), "duplicate_of"))
    # a null is never in a filter
    if req.face_clusters:
        reason = reason.when(~F.coalesce(F.col("primary_face_cluster").isin(*req.face_clusters), F.lit(False)), "face-cluster-excluded")
    if req.face_poses:
        reason = reason.when(~F.coalesce(F.col("primary_face_pose").isin(*req.face_poses), F.lit(False)), "face-pose-excluded")
    return images.withColumn("keep_reason", reason)


def inline_selection(images: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Adds keep_reason for a list of paths given outright: the list alone decides."""
    chosen = images.sparkSession.createDataFrame([(p, True) for p in sorted(set(paths))], "rel_path string, _in boolean")
    rows = images.join(chosen, "rel_path", "left")
    return rows.withColumn("keep_reason", F.when(F.col("_in"), "").otherwise("not-selected")).drop("_in").select(*images.columns, "keep_reason")


def top_by_score(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), "ord").limit(n)


def diverse_picks(rows: DataFrame, n: int, weight: float) -> DataFrame:
    """(ord, pick_no): n picks, each the row with the best blend of score and distance to the picks so far.

    Every pick depends on all before it, so the picking itself is one task over (ord, score, hash).
    Of rows with equal hashes only the n best can ever be picked: after the first the others'
    distance is nothing, so they come by score and ord. The cut is made before the exchange (a
    limited window), and a running least distance makes a pick one pass over arrays.
    """
    top = rows.agg(F.max("score")).first()[0] or 1.0
    slim = rows.select("ord", "score", "hash")
    best = Window.partitionBy("hash").orderBy(F.col("score").desc(), "ord")
    slim = slim.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n).drop("_k")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord").reset_index(drop=True)
        hashed = part["hash"].notna().to_numpy()
        bits = part["hash"].fillna(0).astype("int64").to_numpy()
        gain = part["score"].to_numpy() / top * (1.0 - weight)
        away = np.full(len(part), FARTHEST)
        free = np.ones(len(part), bool)
        some, out = False, []
        for _ in range(min(n, len(part))):
            spread = np.where(hashed & some, away / FARTHEST, 1.0)
            k = int(np.argmax(np.where(free, gain + spread * weight, -np.inf)))
            free[k] = False
            out.append(int(part["ord"].iat[k]))
            if hashed[k]:
                away = np.minimum(away, np.bitwise_count((bits ^ bits[k]).view(np.uint64)).astype(float))
                some = True
        return pd.DataFrame({"ord": out, "pick_no": range(1, len(out) + 1)})

    typed = slim.select("ord", "score", F.col("hash").cast("decimal(20,0)").cast("string").alias("hash"))

    def parse(part: pd.DataFrame) -> pd.DataFrame:
        return pick(part.assign(hash=pd.array([None if h is None else int(h) for h in part["hash"]], dtype="Int64")))

    return typed.groupBy(F.lit(0).alias("_all")).applyInPandas(parse, "ord bigint, pick_no int")


def decide(images: DataFrame, req: ExportRequest, diversity_weight: float) -> DataFrame:
    """Adds keep_reason: empty for what is chosen, a reason for everything else; and pick_no, the order of the
    picks where a cap made some (null elsewhere)."""
    unordered = F.lit(None).cast("int").alias("pick_no")
    if req.selection is not None:
        return inline_selection(images, req.selection).select("*", unordered)
    gated = with_gate_reasons(images, req)
    free = F.col("keep_reason").isNull()
    if req.max_keep is None or gated.where(free).count() <= req.max_keep:
        return gated.withColumn("keep_reason", F.coalesce("keep_reason", F.lit(""))).select("*", unordered)
    eligible = gated.where(free)
    if diversity_weight <= 0:
        # the order of the picks is that of the scores; they are as many as the caller keeps
        picks = with_row_number(top_by_score(eligible, req.max_keep).select("ord", "score"), [F.col("score").desc(), "ord"], "pick_no", 1).select("ord", F.col("pick_no").cast("int"))
    else:
        picks = diverse_picks(eligible, req.max_keep, diversity_weight)
    marked = gated.join(picks, "ord", "left")
    reason = F.coalesce("keep_reason", F.when(F.col("pick_no").isNotNull(), F.lit("")).otherwise(F.lit("diversity-trimmed")))
    return marked.withColumn("keep_reason", reason).select(*images.columns, "keep_reason", "pick_no")
