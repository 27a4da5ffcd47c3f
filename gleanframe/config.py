"""Settings of a scan and an export, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

# The words and limits that callers and stored scans use.
STYLES = ("photo", "anime")
CATEGORIES = ("identity", "wardrobe", "pose_composition", "setting")
POSES = ("frontal", "three_quarter", "profile")
DEVICES = ("auto", "cpu", "cuda")
TRANSFER_MODES = ("copy", "symlink", "move")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
MANIFEST_VERSION = "2.1"


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class TargetProfile:
    target_style: str = "photo"
    target_backend: str | None = "sdxl"
    checkpoint: str | None = None
    target_category: str = "identity"

    def __post_init__(self):
        _one_of("target_style", self.target_style, STYLES)
        _one_of("target_category", self.target_category, CATEGORIES)


@dataclass(frozen=True)
class ScanConfig:
    min_short_side: int = 512
    max_aspect_ratio: float = 3.0
    blur_threshold: float = 100.0
    cluster_distance: int = 10
    weight_sharpness: float = 0.35
    weight_resolution: float = 0.30
    weight_artifact: float = 0.15
    #: Kept for stored settings; no score reads it.
    weight_subject: float = 0.20
    sharpness_ref: float = 800.0
    resolution_ref: int = 1024
    diversity_weight: float = 0.40
    #: Kept for stored settings; Spark decides how many tasks run at once.
    max_workers: int = 4


@dataclass(frozen=True)
class FaceConfig:
    enabled: bool = False
    model: str = "buffalo_l"
    device: str = "auto"
    min_det_score: float = 0.5
    cluster_eps: float = 0.5
    frontal_max_yaw: float = 15.0
    three_quarter_max_yaw: float = 45.0

    def __post_init__(self):
        _one_of("device", self.device, DEVICES)


@dataclass(frozen=True)
class ExportRequest:
    min_score: float = 0.6
    include_rejected: bool = False
    keep_similar: bool = False
    face_clusters: tuple[str, ...] = ()
    face_poses: tuple[str, ...] = ()
    max_keep: int | None = None
    selection: tuple[str, ...] | None = None
    flatten: bool = False
    mode: str = "copy"
    allow_move: bool = False
    write_manifest: bool = True
    #: Where the manifest is sent once it is written.
    caption_url: str | None = None
    #: Which stored scan the export is of.
    scan_id: str | None = None

    def __post_init__(self):
        _one_of("mode", self.mode, TRANSFER_MODES)
        for pose in self.face_poses:
            _one_of("face_poses", pose, POSES)
        if self.max_keep is not None and self.max_keep < 0:
            raise ValueError("max_keep must not be negative")
        if self.mode == "move" and not self.allow_move:
            raise PermissionError("moving needs allow_move")
