"""Scan a folder, keep the result, export a selection: the calls that most callers need."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MANIFEST_VERSION, ExportRequest, FaceConfig, ScanConfig, TargetProfile
from .operators import dedup, detection, export, summary
from .operators.ordering import checkpointed
from .plans import scan as plans
from .sources import images
from .sources.images import within
from .service import post_manifest, watched
from .sources.store import ScanStore

Progress = Callable[[str, int, int], None]
#: The files of an export.
MANIFEST_NAME, REPORT_NAME = "manifest.jsonl", "curation_report.csv"


def _teller(progress: Progress | None) -> Progress:
    """Progress of a scan is news only: what a listener raises doesn't stop the work."""

    def tell(phase: str, done: int, total: int) -> None:
        if progress:
            try:
                progress(phase, done, total)
            except Exception:  # noqa: BLE001
                pass

    return tell


@dataclass(frozen=True)
class Scan:
    """Results of a scan and what describes them."""

    scan_id: str
    folder: str
    profile: TargetProfile
    config: ScanConfig
    results: DataFrame
    face_config: FaceConfig = field(default_factory=FaceConfig)
    face_clusters: DataFrame | None = None

    def summary(self) -> dict:
        """Counts, the reject tally, identities and the settings, ready for JSON."""
        counts = summary.counts(self.results).first().asDict()
        counts["similar_clusters"] = dedup.multi_member_groups(self.results).first()[0]
        tally = {r.reason: r.n for r in summary.reject_tally(self.results).collect()}
        identities = [r.asDict() for r in self.face_clusters.collect()] if self.face_clusters is not None else []
        settings = {"target_profile": asdict(self.profile), "config": asdict(self.config), "faces_config": asdict(self.face_config)}
        return {"scan_id": self.scan_id, "folder": self.folder, **settings, **counts, "reject_reasons": tally, "face_clusters": identities}

    def page(self, offset: int = 0, limit: int | None = None) -> dict:
        """The summary with one page of results; the counts stay those of the whole scan."""
        rows = summary.rows_as_dicts(summary.page(self.results, offset, limit))
        return self.summary() | {"offset": offset, "limit": limit, "returned": len(rows), "results": rows}


def _scan(files: DataFrame, pixels: DataFrame, profile, config, face_config, folder, scan_id, detector, detections, tell: Progress) -> Scan:
    total = files.count()
    with watched(files.sparkSession, tell, "scoring", total):
        metrics = plans.measured(files, pixels, config)
    if face_config.enabled and detections is None:
        # only images that pass the gates are looked at
        gated = plans.with_gates(metrics, config).where("passed").select("rel_path")
        seen = pixels.join(gated, "rel_path", "left_semi")
        with watched(files.sparkSession, tell, "faces", gated.count()):
            detections = checkpointed(detection.detect(seen, files.select("rel_path", "ord"), detector or detection.default_detector(face_config)))
    results, clusters = plans.scan_with_faces(metrics, profile, config, face_config, detections, tell)
    return Scan(scan_id or uuid.uuid4().hex, folder, profile, config, results, face_config, clusters)


def scan_folder(
    spark: SparkSession, folder: str, profile: TargetProfile = TargetProfile(), config: ScanConfig = ScanConfig(), scan_id: str | None = None, progress: Progress | None = None,
    face_config: FaceConfig = FaceConfig(), detector: detection.Detector | None = None, detections: DataFrame | None = None,
) -> Scan:
    """progress is called with (phase, done, total) of the phases collecting, scoring, faces and clustering, as Spark's jobs end.

    Faces are found by detector, or given as a table; see operators/detection.py and valid_faces().
    """
    tell = _teller(progress)
    tell("collecting", 0, 0)
    files = images.collect_images(spark, folder)
    n = files.count()
    tell("collecting", n, n)
    return _scan(files, images.read_pixels(spark, folder), profile, config, face_config, os.path.realpath(folder), scan_id, detector, detections, tell)


def scan_items(
    items: DataFrame, profile: TargetProfile = TargetProfile(), config: ScanConfig = ScanConfig(), scan_id: str | None = None, progress: Progress | None = None, folder: str = "",
    face_config: FaceConfig = FaceConfig(), detector: detection.Detector | None = None, detections: DataFrame | None = None,
) -> Scan:
    """A scan of images in memory: items(rel_path, abs_path, content[, ord]), in the order of ord or else of paths."""
    rows = items if "ord" in items.columns else images.in_walk_order(items)
    files = checkpointed(rows.select("ord", "rel_path", "abs_path"))
    return _scan(files, images.pixels_of(items), profile, config, face_config, folder, scan_id, detector, detections, _teller(progress))


def scan_metrics(metrics: DataFrame, profile: TargetProfile = TargetProfile(), config: ScanConfig = ScanConfig(), face_config: FaceConfig = FaceConfig(), detections: DataFrame | None = None, scan_id: str = "scan") -> Scan:
    """A scan of images that were measured elsewhere."""
    results, clusters = plans.scan_with_faces(metrics, profile, config, face_config, detections)
    return Scan(scan_id, "", profile, config, results, face_config, clusters)


def inside(root: str, path: str) -> str:
    """path below root, resolved; anything that leads out of root is refused."""
    return within(root, path)


def export_selection(scan: Scan, request: ExportRequest, destination: str, root: str | None = None, report_only: bool = False, progress: Progress | None = None) -> dict:
    """Chooses, transfers, and writes manifest.jsonl and curation_report.csv; a failed file is skipped.

    The choice is written down before any file is touched, so a move can't change it. Executors copy
    and link; the driver does where progress is listened to, and it alone moves.
    """
    target = os.path.realpath(inside(root, destination) if root else destination)
    decided = checkpointed(plans.export_plan(scan.results, request, scan.config))
    chosen = decided.where("keep_reason = ''")
    paths = [r.rel_path for r in export.selected_paths(decided).orderBy("place").toLocalIterator()]
    result = {"manifest_version": MANIFEST_VERSION, "manifest_path": None, "dest": target, "mode": request.mode, "selected_rel_paths": paths, "captioned": False}
    if report_only:
        Path(target).mkdir(parents=True, exist_ok=True)
        export.write_report(export.report(decided, None), f"{target}/{REPORT_NAME}")
        return result | {"selected": len(paths), "exported": 0, "copied": 0, "skipped": 0, "exported_paths": {}, "exported_abs_paths": {}}
    plan = checkpointed(chosen.select("ord", "pick_no", "rel_path", "abs_path").join(export.destinations(chosen, request.flatten), "rel_path"))
    # each file's progress can only be told, and moves made once, by the driver
    alone = progress is not None or request.mode == "move"
    done = export.transfer(plan, target, request.mode, progress) if alone else export.transfer_spread(plan, target, request.mode)
    there = [(rel, dest) for rel, dest, error in done if not error]
    exported = decided.sparkSession.createDataFrame(there, "rel_path string, dest string")
    if request.write_manifest:
        Path(target).mkdir(parents=True, exist_ok=True)
        rows = export.manifest(decided, exported, scan.profile, target, request.mode == "move")
        with open(f"{target}/{MANIFEST_NAME}", "w", encoding="utf-8") as f:
            f.writelines(r.value + "\n" for r in export.manifest_lines(rows).toLocalIterator())
        export.write_report(export.report(decided, exported), f"{target}/{REPORT_NAME}")
        result["manifest_path"] = f"{target}/{MANIFEST_NAME}"
        result["captioned"] = bool(request.caption_url) and post_manifest(result["manifest_path"], request.caption_url)
    counts = export.export_result(decided, exported, len(done) - len(there)).first().asDict()
    return result | counts | {"copied": len(there), "exported_paths": dict(sorted(there)), "exported_abs_paths": {rel: f"{target}/{dest}" for rel, dest in sorted(there)}}


def check_export(store: ScanStore, request: ExportRequest, source_root: str | None, export_root: str | None, destination: str, allow_move: bool = False) -> dict:
    """What a service checks before an export reads any image, in this order: that a scan is named, known and lies below the
    source root; that a move is allowed; that there is an export root; that the destination lies below it. Returns the summary."""
    if request.scan_id is None:
        raise ValueError("name the scan by scan_id; a selection only narrows it" if request.selection is not None else "scan_id is missing")
    found = store.load_summary(request.scan_id)
    if found is None:
        raise LookupError(f"no scan {request.scan_id!r}")
    if source_root is not None and found.get("folder"):
        inside(source_root, found["folder"])
    if request.mode == "move" and not allow_move:
        raise PermissionError("moving needs allow_move")
    if not export_root:
        raise ValueError("no export root is set")
    inside(export_root, destination)
    return found


def save(store: ScanStore, scan: Scan) -> None:
    """Results and summary, so that the scan can be paged and exported later."""
    store.save(scan.scan_id, scan.results, scan.summary())


def load(store: ScanStore, scan_id: str) -> Scan | None:
    """A stored scan, ready for an export."""
    results, about = store.load(scan_id), store.load_summary(scan_id)
    if results is None or not about:
        return None
    rows = [(c["cluster_id"], c["size"], c["representative_rel_path"], c["representative_bbox"]) for c in about["face_clusters"]]
    clusters = store.spark.createDataFrame(rows, "cluster_id string, size bigint, representative_rel_path string, representative_bbox array<double>")
    return Scan(about["scan_id"], about["folder"], TargetProfile(**about["target_profile"]), ScanConfig(**about["config"]), results, FaceConfig(**about["faces_config"]), clusters)


def health() -> dict:
    """Whether the engine answers, and what it finds installed."""
    return {"status": "ok", "manifest_version": MANIFEST_VERSION, "detectors": detection.available()}


def pose_counts(scan: Scan) -> dict[str, int]:
    return {r.primary_face_pose: r.n for r in summary.pose_distribution(scan.results).collect()}


def listing(scan: Scan) -> DataFrame:
    """(score, similar_group, group_size, is_representative, rel_path, primary_face_cluster, primary_face_pose), grouped by likeness."""
    rows = scan.results.orderBy("similar_group", F.col("score").desc(), "ord")
    return rows.select("score", "similar_group", "group_size", "is_representative", "rel_path", "primary_face_cluster", "primary_face_pose")
