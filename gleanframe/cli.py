"""Command line: scan a folder and export what is chosen; report detectors; write or check the wire schema."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import api, wire
from .config import CATEGORIES, DEVICES, POSES, STYLES, ExportRequest, FaceConfig, ScanConfig, TargetProfile
from .operators import detection, export
from .sources.store import ScanStore

SCHEMA_PATH = os.path.join("schema", "wire.schema.json")


def _listed(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def scan_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanframe", description=__doc__, epilog="gleanframe detectors: which face libraries there are. gleanframe schema [--output FILE] [--check]: the wire schema.")
    p.add_argument("folder")
    p.add_argument("--target-style", "--style", dest="style", choices=STYLES, default="photo")
    p.add_argument("--target-backend", default="sdxl")
    p.add_argument("--checkpoint")
    p.add_argument("--target-category", "--category", dest="category", choices=CATEGORIES, default="identity")
    p.add_argument("--min-short-side", type=int, default=512)
    p.add_argument("--max-aspect-ratio", type=float, default=3.0)
    p.add_argument("--blur-threshold", type=float, default=100.0)
    p.add_argument("--cluster-distance", type=int, default=10)
    p.add_argument("--no-cluster", action="store_true", help="group no near-duplicates")
    p.add_argument("--diversity-weight", type=float, default=0.40, help="0 scores only, 1 spread only")
    p.add_argument("--max-workers", type=int, default=4, help="kept in the settings; Spark decides how many tasks run at once")
    p.add_argument("--min-score", type=float, default=0.6)
    p.add_argument("--max-keep", type=int)
    p.add_argument("--include-rejected", action="store_true")
    p.add_argument("--keep-similar", action="store_true")
    p.add_argument("--faces", action="store_true", help="find faces and group them into identities")
    p.add_argument("--faces-model", default="buffalo_l")
    p.add_argument("--min-det-score", type=float, default=0.5)
    p.add_argument("--cluster-eps", type=float, default=0.5)
    p.add_argument("--device", choices=DEVICES, default="auto")
    p.add_argument("--face-clusters", type=_listed, default=(), help="identities to export, separated by commas")
    p.add_argument("--pose", type=_listed, default=(), help=f"poses to export, separated by commas: {', '.join(POSES)}")
    p.add_argument("--flatten", action="store_true")
    p.add_argument("--csv", metavar="FILE", help="write the report of all images")
    p.add_argument("--json", metavar="FILE", help="write the summary with all results")
    p.add_argument("--store", metavar="DIR", help="keep the scan in this store")
    p.add_argument("--verbose", "-v", action="store_true", help="list all images")
    to = p.add_mutually_exclusive_group()
    for mode in ("copy", "symlink", "move"):
        to.add_argument(f"--{mode}-to", metavar="DIR")
    to.add_argument("--report-to", metavar="DIR", help="write the report only")
    return p


def _scan(argv: list[str], spark: SparkSession | None, detector: detection.Detector | None) -> int:
    a = scan_parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    config = ScanConfig(
        min_short_side=a.min_short_side, max_aspect_ratio=a.max_aspect_ratio, blur_threshold=a.blur_threshold, cluster_distance=-1 if a.no_cluster else a.cluster_distance, diversity_weight=a.diversity_weight, max_workers=a.max_workers,
    )
    faces = FaceConfig(enabled=a.faces, model=a.faces_model, device=a.device, min_det_score=a.min_det_score, cluster_eps=a.cluster_eps)
    scan = api.scan_folder(spark, a.folder, TargetProfile(a.style, a.target_backend, a.checkpoint, a.category), config, face_config=faces, detector=detector)
    about = scan.summary()
    print(json.dumps(about | {"poses": api.pose_counts(scan)}, indent=2, sort_keys=True))
    if a.verbose:
        for r in api.listing(scan).toLocalIterator():
            mark = f"g{r.similar_group}" + "*" * (r.is_representative and r.group_size > 1)
            face = f" [{' '.join(x for x in (r.primary_face_cluster, r.primary_face_pose) if x)}]" if r.primary_face_cluster else ""
            print(f"{r.score:.3f} {mark:>5}  {r.rel_path}{face}")
    if a.store:
        api.save(ScanStore(spark, a.store), scan)
    if a.json:
        with open(a.json, "w", encoding="utf-8") as f:
            json.dump(scan.page(), f, indent=2)
    mode = next((m for m in ("move", "copy", "symlink") if getattr(a, f"{m}_to")), None)
    request = ExportRequest(
        min_score=a.min_score, max_keep=a.max_keep, include_rejected=a.include_rejected, keep_similar=a.keep_similar, face_clusters=a.face_clusters, face_poses=a.pose, flatten=a.flatten, mode=mode or "copy", allow_move=mode == "move",
    )
    result = None
    if mode or a.report_to:
        result = api.export_selection(scan, request, getattr(a, f"{mode}_to") if mode else a.report_to, report_only=mode is None)
        print(json.dumps(result, indent=2, sort_keys=True))
    if a.csv:
        decided = api.plans.export_plan(scan.results, request, config)
        there = list(result["exported_paths"].items()) if result else []
        export.write_report(export.report(decided, spark.createDataFrame(there, "rel_path string, dest string")), a.csv)
    return 0


def _schema(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="gleanframe schema")
    p.add_argument("--output", "-o", default=SCHEMA_PATH)
    p.add_argument("--check", action="store_true", help="only tell whether the file is what the types say")
    a = p.parse_args(argv)
    if a.check:
        stale = wire.is_stale(a.output)
        print(f"{a.output} is {'stale' if stale else 'up to date'}")
        return int(stale)
    os.makedirs(os.path.dirname(a.output) or ".", exist_ok=True)
    with open(a.output, "w", encoding="utf-8") as f:
        f.write(wire.rendered())
    print(f"wrote {a.output}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, detector: detection.Detector | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["schema"]:
        return _schema(argv[1:])
    if argv[:1] == ["detectors"]:
        for name, there in detection.available().items():
            print(f"[{'+' if there else '-'}] {name}")
        return 0
    return _scan(argv, spark, detector)


if __name__ == "__main__":
    raise SystemExit(main())
