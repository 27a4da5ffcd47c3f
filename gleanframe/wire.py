"""What callers and stored files exchange, as one JSON Schema made from the types below and in config.py."""

from __future__ import annotations

import json
import types
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Literal

from . import config
from .config import MANIFEST_VERSION, FaceConfig, ScanConfig, TargetProfile


@dataclass
class FaceDetection:
    bbox: list[float]
    det_score: float
    cluster_id: str | None = None
    primary: bool = False
    yaw: float | None = None
    pitch: float | None = None
    pose: str | None = None


@dataclass
class ImageResult:
    rel_path: str
    abs_path: str
    score: float = 0.0
    passed: bool = False
    reject_reason: str | None = None
    similar_group: int = 0
    group_size: int = 1
    is_representative: bool = True
    is_duplicate: bool = False
    duplicate_of: str | None = None
    sharpness: float = 0.0
    artifact_score: float = 0.0
    width: int = 0
    height: int = 0
    faces: list[FaceDetection] = field(default_factory=list)
    face_count: int = 0
    primary_face_cluster: str | None = None
    primary_face_pose: str | None = None
    primary_face_yaw: float | None = None
    phash: str = ""
    score_breakdown: dict[str, float] = field(default_factory=dict)


@dataclass
class FaceCluster:
    cluster_id: str
    size: int
    representative_rel_path: str
    representative_bbox: list[float] | None = None


@dataclass
class ScanRequest:
    folder: str
    target_profile: TargetProfile = field(default_factory=TargetProfile)
    config: ScanConfig = field(default_factory=ScanConfig)
    faces: FaceConfig = field(default_factory=FaceConfig)


@dataclass
class ScanSummary:
    scan_id: str
    folder: str
    target_profile: TargetProfile
    config: ScanConfig
    faces_config: FaceConfig
    total: int
    passed: int
    rejected: int
    duplicates: int
    similar_clusters: int
    reject_reasons: dict[str, int] = field(default_factory=dict)
    face_clusters: list[FaceCluster] = field(default_factory=list)
    results: list[ImageResult] = field(default_factory=list)
    offset: int = 0
    limit: int | None = None
    returned: int = 0


@dataclass
class ManifestRow:
    rel_path: str
    abs_path: str
    exported_path: str
    exported_abs_path: str
    target_profile: TargetProfile
    score: float
    similar_group: int
    manifest_version: str = MANIFEST_VERSION
    primary_face_cluster: str | None = None
    primary_face_pose: str | None = None


@dataclass
class ExportResult:
    copied: int
    skipped: int
    dest: str
    mode: str
    manifest_version: str = MANIFEST_VERSION
    manifest_path: str | None = None
    selected_rel_paths: list[str] = field(default_factory=list)
    exported_paths: dict[str, str] = field(default_factory=dict)
    exported_abs_paths: dict[str, str] = field(default_factory=dict)
    captioned: bool = False


ROOTS = (ScanRequest, ScanSummary, config.ExportRequest, ExportResult, ManifestRow)
PLAIN = {str: "string", int: "integer", float: "number", bool: "boolean", type(None): "null"}
WORDS = {
    "target_style": config.STYLES, "target_category": config.CATEGORIES, "device": config.DEVICES, "mode": config.TRANSFER_MODES, "pose": config.POSES, "primary_face_pose": config.POSES, "face_poses": config.POSES,
}


def _of(kind, known: dict, words: tuple[str, ...] | None = None) -> dict:
    if is_dataclass(kind):
        _define(kind, known)
        return {"$ref": f"#/$defs/{kind.__name__}"}
    origin, parts = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        return {"anyOf": [_of(p, known, words) for p in parts]}
    if origin in (list, tuple):
        return {"type": "array", "items": _of(parts[0], known, words)}
    if origin is dict:
        return {"type": "object", "additionalProperties": _of(parts[1], known)}
    if origin is Literal:
        return {"enum": list(parts)}
    return {"type": PLAIN[kind]} | ({"enum": list(words)} if words and kind is str else {})


def _define(model: type, known: dict) -> None:
    if model.__name__ in known:
        return
    known[model.__name__] = out = {"type": "object", "title": model.__name__, "properties": {}}
    hints = typing.get_type_hints(model)
    for f in fields(model):
        entry = _of(hints[f.name], known, WORDS.get(f.name))
        if f.default is not MISSING:
            entry = entry | {"default": list(f.default) if isinstance(f.default, tuple) else f.default}
        out["properties"][f.name] = entry
    out["required"] = [f.name for f in fields(model) if f.default is MISSING and f.default_factory is MISSING]


def schema() -> dict:
    known: dict = {}
    for model in ROOTS:
        _define(model, known)
    return {"title": "gleanframe wire schema", "$defs": known, "anyOf": [{"$ref": f"#/$defs/{m.__name__}"} for m in ROOTS]}


def rendered() -> str:
    return json.dumps(schema(), indent=2, sort_keys=True) + "\n"


def is_stale(path: str) -> bool:
    """Whether the file at path isn't what the types say."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read() != rendered()
    except FileNotFoundError:
        return True
