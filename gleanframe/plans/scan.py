"""A scan and an export as whole plans over metric tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExportRequest, FaceConfig, ScanConfig, TargetProfile
from ..functions.scoring import with_gates, with_score
from ..operators import dedup, faces, selection
from ..operators.ordering import checkpointed
from ..sources import images as folder_source


def scan(metrics: DataFrame, profile: TargetProfile = TargetProfile(), cfg: ScanConfig = ScanConfig(), face_cfg: FaceConfig = FaceConfig(), detections: DataFrame | None = None) -> DataFrame:
    """The results of scan_with_faces()."""
    return scan_with_faces(metrics, profile, cfg, face_cfg, detections)[0]


def scan_with_faces(
    metrics: DataFrame, profile: TargetProfile = TargetProfile(), cfg: ScanConfig = ScanConfig(), face_cfg: FaceConfig = FaceConfig(), detections: DataFrame | None = None, progress: Callable[[str, int, int], None] = lambda *_: None
) -> tuple[DataFrame, DataFrame | None]:
    """Scan results and, where faces were looked for, the table of identities.

    metrics(ord, rel_path, width, height, sharpness, artifact_score, hash[, decode_error]).
    Faces come before near-duplicates: they change scores, and scores choose representatives. Paths
    must be unique.
    """
    if metrics.groupBy("rel_path").count().where("count > 1").limit(1).count():
        raise ValueError("rel_path must be unique")
    rows = with_gates(metrics.withColumns({"face_count": F.lit(0), "abs_path": F.col("abs_path") if "abs_path" in metrics.columns else F.col("rel_path")}), cfg)
    clusters = None
    none = {c: F.lit(None).cast(t) for c, t in (("primary_face_cluster", "string"), ("primary_face_pose", "string"), ("primary_face_yaw", "double"))}
    if face_cfg.enabled and detections is not None:
        found = faces.valid_faces(detections.join(rows.where("passed").select("rel_path"), "rel_path", "left_semi"), face_cfg)
        labelled = checkpointed(faces.identities(found, face_cfg.cluster_eps))
        names = checkpointed(faces.named_clusters(labelled))
        clusters = faces.cluster_table(names)
        named = labelled.join(names.select("label", "cluster_id"), "label")
        per_image = faces.primary_faces(named).join(faces.faces_per_image(named), "rel_path")
        rows = rows.drop("face_count").join(per_image, "rel_path", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)))
    else:
        rows = rows.withColumns(none | {"faces": F.lit(None).cast(faces.FACES_TYPE)})
    rows = rows.withColumns({"faces": F.coalesce(F.col("faces"), F.array().cast(faces.FACES_TYPE)), "phash": F.coalesce(dedup.hex_hash(F.col("hash")), F.lit(""))})
    scored = checkpointed(with_score(rows, profile, cfg, face_cfg.enabled and detections is not None))
    total = scored.count()
    progress("clustering", 0, total)
    results = checkpointed(dedup.with_groups(dedup.greedy_leaders(scored, cfg.cluster_distance)))
    progress("clustering", total, total)
    return results, clusters


def measured(files: DataFrame, pixels: DataFrame, cfg: ScanConfig) -> DataFrame:
    """files(ord, rel_path, abs_path) with the metrics of their pixels, which are read once and never shuffled."""
    rows = files.join(folder_source.measure(pixels, cfg), "rel_path", "left").withColumns({
        "decode_error": F.when(F.col("width").isNull(), "unreadable image").otherwise(F.col("decode_error")), **{c: F.coalesce(c, F.lit(0)) for c in ("width", "height")},
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("sharpness_raw", "sharpness", "artifact_score")},
    })
    return checkpointed(rows)


def scan_folder(spark: SparkSession, root: str, profile: TargetProfile = TargetProfile(), cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Scan results of an image folder."""
    return scan(measured(folder_source.collect_images(spark, root), folder_source.read_pixels(spark, root), cfg), profile, cfg)


def export_plan(results: DataFrame, req: ExportRequest, cfg: ScanConfig = ScanConfig()) -> DataFrame:
    """Scan results with keep_reason, empty for what is chosen."""
    return selection.decide(results, req, cfg.diversity_weight)
