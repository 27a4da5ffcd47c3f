"""Faces in pixels, by a detector that the caller plugs in.

A detector is called with the pixels of an image (height, width, 3; blue first) and returns its faces
as dictionaries: bbox (x1, y1, x2, y2), det_score, embedding, and pose (pitch, yaw, roll) where it is known.
"""

from __future__ import annotations

import importlib.util
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FaceConfig

Detector = Callable[[np.ndarray], list[dict]]
DETECT_SIZE = (640, 640)  # fixed value: the side of the detector's input
DETECTIONS = "rel_path string, face_no int, x1 double, y1 double, x2 double, y2 double, det_score double, yaw double, pitch double, embedding array<double>"
FACES_OF_AN_IMAGE = 1 << 20
_LOADED: dict[tuple[str, str], object] = {}
log = logging.getLogger(__name__)


def available() -> dict[str, bool]:
    """Which of the libraries that a detector may need are installed."""
    return {name: importlib.util.find_spec(name) is not None for name in ("insightface", "onnxruntime")}


def providers(device: str, known: list[str]) -> list[str]:
    """The runtime's providers for a device, first choice first; cpu is always the last."""
    wanted = {"cpu": [], "cuda": ["CUDAExecutionProvider"], "auto": ["CUDAExecutionProvider"]}[device]
    return [*[p for p in wanted if device == "cuda" or p in known], "CPUExecutionProvider"]


def pose_of(pose) -> tuple[float | None, float | None]:
    """(yaw, pitch) of (pitch, yaw, roll), or nothing of anything else."""
    try:
        pitch, yaw, _ = (float(v) for v in pose)
    except (TypeError, ValueError):
        return None, None
    return yaw, pitch


def default_detector(cfg: FaceConfig) -> Detector:
    """The detector of the installed face library; each worker loads its model once."""
    if not available()["insightface"]:
        raise ImportError("no face detector is installed: pass one, or a table of detections")
    model, device = cfg.model, cfg.device

    def detect_(pixels: np.ndarray) -> list[dict]:
        from insightface.app import FaceAnalysis

        if (model, device) not in _LOADED:
            import onnxruntime

            app = FaceAnalysis(name=model, providers=providers(device, onnxruntime.get_available_providers()))
            app.prepare(ctx_id=-1 if device == "cpu" else 0, det_size=DETECT_SIZE)
            _LOADED[model, device] = app
        found = _LOADED[model, device].get(pixels)
        return [{"bbox": f.bbox, "det_score": f.det_score, "embedding": getattr(f, "embedding", None), "pose": getattr(f, "pose", None)} for f in found]

    return detect_


def detect(pixels: DataFrame, order: DataFrame, detector: Detector) -> DataFrame:
    """pixels(rel_path, width, height, channels, data) and order(rel_path, ord) to a table for valid_faces().

    face_id is the face's place in the order of images. An image on which the detector fails has no faces.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for rel, w, h, channels, data in part[["rel_path", "width", "height", "channels", "data"]].itertuples(index=False):
                if data is None:
                    continue
                flat = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                image = np.ascontiguousarray(flat[..., :3]) if channels >= 3 else np.repeat(flat[..., :1], 3, axis=2)
                try:
                    found = detector(image)
                except Exception as e:  # noqa: BLE001  one image must not stop the others
                    log.warning("no faces looked for in %s: %s", rel, e)
                    continue
                for k, face in enumerate(found):
                    yaw, pitch = pose_of(face.get("pose"))
                    vector = face.get("embedding")
                    rows.append((rel, k, *map(float, face["bbox"]), float(face["det_score"]), yaw, pitch, None if vector is None else [float(v) for v in vector]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    faces = pixels.mapInPandas(run, DETECTIONS).join(order, "rel_path")
    return faces.withColumn("face_id", F.col("ord") * FACES_OF_AN_IMAGE + F.col("face_no")).drop("ord")
