"""Folders of images and in-memory images as metric tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IMAGE_SUFFIXES, ScanConfig
from ..functions import decoding, kernels
from ..operators.ordering import with_row_number

COUNT_CAP = 5000  # fixed value: a folder's image count is shown up to this


def is_image(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(name).rlike(r"^.+(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")


def path_order(path: Column) -> Column:
    """Orders paths component by component, as a sorted walk does."""
    return F.split(path, "/")


def relative(path: Column, root: str) -> Column:
    """A file source's path below root, whatever scheme it is written with."""
    bare = F.regexp_replace(path, "^[a-z]+:/+", "/")
    return F.substring(bare, F.lit(len(os.path.abspath(root)) + 2), F.length(bare))


def _hidden(root: str) -> list[str]:
    """Images below root that file sources skip: a part of their path begins with a dot or an underscore."""
    found = []
    for folder, _, names in os.walk(root):
        inside = os.path.relpath(folder, root)
        parts = [] if inside == "." else inside.split(os.sep)
        under = any(p[0] in "._" for p in parts)
        for name in names:
            stem, suffix = os.path.splitext(name)
            if (under or name[0] in "._") and stem and suffix.lower() in IMAGE_SUFFIXES:
                found.append("/".join([*parts, name]))
    return found


def collect_images(spark: SparkSession, root: str) -> DataFrame:
    """(ord, rel_path, abs_path): image files below root in walk order; contents are not read."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rows = files.select(relative(F.col("path"), root).alias("rel_path"), F.regexp_replace("path", "^[a-z]+:/+", "/").alias("abs_path")).where(is_image(F.col("rel_path")))
    if hidden := _hidden(root):
        base = os.path.abspath(root)
        rows = rows.unionByName(spark.createDataFrame([(p, f"{base}/{p}") for p in hidden], "rel_path string, abs_path string"))
    return in_walk_order(rows).select("ord", "rel_path", "abs_path")


def in_walk_order(rows: DataFrame) -> DataFrame:
    """Adds ord: the place of rel_path in a sorted walk."""
    return with_row_number(rows, [path_order(F.col("rel_path"))], "ord")


def browse(paths: DataFrame) -> DataFrame:
    """(folder, n): images below each top-level folder, shown up to COUNT_CAP; '' are those at the top."""
    parts = F.split("rel_path", "/")
    folder = F.when(F.size(parts) > 1, parts[0]).otherwise("")
    out = paths.where(is_image(F.col("rel_path"))).groupBy(folder.alias("folder")).agg(F.least(F.count("*"), F.lit(COUNT_CAP)).alias("n"))
    return out.where("folder = '' or not startswith(folder, '.')").orderBy(F.lower("folder"))


def browse_folder(root: str, inside: str = "") -> dict:
    """A folder below root: its parent, the images right in it, and its folders with all images below each, up to COUNT_CAP.

    Folders whose name begins with a dot are not listed, but what lies in them counts.
    """
    base = within(root, inside)
    if not os.path.isdir(base):
        raise NotADirectoryError(inside or ".")

    def image(name: str) -> bool:
        stem, suffix = os.path.splitext(name)
        return bool(stem) and suffix.lower() in IMAGE_SUFFIXES

    def count(folder: str) -> int:
        n = 0
        for _, _, names in os.walk(folder):
            n += sum(map(image, names))
            if n >= COUNT_CAP:
                return COUNT_CAP
        return n

    with os.scandir(base) as entries:
        listed = sorted(entries, key=lambda e: e.name.lower())
    folders = [
        {"name": e.name, "rel_path": f"{inside}/{e.name}" if inside else e.name, "abs_path": os.path.realpath(e.path), "image_count": count(e.path),
         "subfolder_count": sum(x.is_dir() and not x.name.startswith(".") for x in os.scandir(e.path))}
        for e in listed if e.is_dir() and not e.name.startswith(".")
    ]
    return {
        "root": os.path.realpath(root), "path": inside, "abs_path": base, "parent": os.path.dirname(inside) if inside else None,
        "direct_image_count": sum(e.is_file() and image(e.name) for e in listed), "folders": folders,
    }


def within(root: str, path: str) -> str:
    """path below root, resolved; anything that leads out of root is refused."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise PermissionError(f"{path!r} leads out of {root!r}")
    return str(full)


PIXELS = "rel_path string, width int, height int, channels int, data binary"


def read_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, width, height, channels, data) by the JVM's image reader; data is null where it can't decode.

    Files that Spark's reader skips are opened by the executors, which must see root.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root).select("image.*")
    ok = F.col("width") > 0
    rows = rows.select(relative(F.col("origin"), root).alias("rel_path"), F.when(ok, F.col("width")).otherwise(0).alias("width"), F.when(ok, F.col("height")).otherwise(0).alias("height"), F.col("nChannels").alias("channels"), F.when(ok, F.col("data")).alias("data"))
    hidden = _hidden(root)
    if not hidden:
        return rows
    base = os.path.abspath(root)

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            contents = []
            for p in part["rel_path"]:
                try:
                    with open(f"{base}/{p}", "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield pd.DataFrame({"rel_path": part["rel_path"], "content": contents})

    paths = spark.createDataFrame([(p,) for p in hidden], "rel_path string").repartition(min(len(hidden), 64))
    return rows.unionByName(pixels_of(paths.mapInPandas(opened, "rel_path string, content binary")))


def pixels_of(items: DataFrame) -> DataFrame:
    """The same of images in memory: items(rel_path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for rel, content in zip(part["rel_path"], part["content"]):
                pixels = decoding.decode(content)
                h, w, channels = pixels.shape if pixels is not None else (0, 0, 0)
                rows.append((rel, w, h, channels, pixels.tobytes() if pixels is not None else None))
            yield pd.DataFrame(rows, columns=["rel_path", "width", "height", "channels", "data"])

    return items.select("rel_path", "content").mapInPandas(run, PIXELS)


METRICS = "rel_path string, width int, height int, decode_error string, hash bigint, sharpness_raw double, sharpness double, artifact_score double"


def measure(pixels: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Metrics of decoded pixels, in one pass; the costly ones only for rows that pass the cheap gates."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for rel, w, h, channels, data in part[["rel_path", "width", "height", "channels", "data"]].itertuples(index=False):
                if data is None:
                    rows.append((rel, 0, 0, "unreadable image", None, 0.0, 0.0, 0.0))
                    continue
                flat = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                luma = flat[..., 0] if channels == 1 else kernels.grey(flat[..., 2::-1])
                bits = kernels.perceptual_hash(luma)
                sharp = art = 0.0
                short, long = min(w, h), max(w, h)
                if short >= cfg.min_short_side and long / short <= cfg.max_aspect_ratio:
                    sharp = kernels.sharpness(luma)
                    art = kernels.artifact_score(luma) if sharp >= cfg.blur_threshold else 0.0
                rows.append((rel, w, h, None, bits - (1 << 64) if bits >> 63 else bits, sharp, round(sharp, 2), round(art, 4)))
            out = pd.DataFrame(rows, columns=["rel_path", "width", "height", "decode_error", "hash", "sharpness_raw", "sharpness", "artifact_score"])
            # a missing hash must not make the others floating-point numbers
            yield out.assign(hash=pd.array([r[4] for r in rows], dtype="Int64"))

    return pixels.mapInPandas(run, METRICS)
