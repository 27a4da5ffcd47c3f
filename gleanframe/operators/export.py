"""Where chosen images go, and what is written about them."""

from __future__ import annotations

import csv
import os
import shutil
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import MANIFEST_VERSION, TargetProfile
from ..functions.scoring import suffixed_name
from .ordering import checkpointed, with_row_number


@F.pandas_udf(StringType())
def collision_key(names: pd.Series) -> pd.Series:
    """Names that some file system takes for the same: composed form, case folded."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


def destinations(chosen: DataFrame, flatten: bool) -> DataFrame:
    """(rel_path, dest). Kept structure maps a path to itself; flattened files of one name all get a
    suffix made of their path's hash, longer while one that has a suffix still clashes. Plain names stay.
    """
    rows = chosen.select("rel_path")
    if not flatten:
        return rows.withColumn("dest", F.col("rel_path"))
    rows = rows.withColumn("name", F.element_at(F.split("rel_path", "/"), -1)).withColumn("key", collision_key("name"))
    sizes = rows.groupBy("key").agg((F.count("*") > 1).alias("many"))
    plan = rows.join(sizes, "key").select("rel_path", "name", F.when(F.col("many"), 8).otherwise(0).alias("digits"))
    for _ in range(6):
        named = plan.withColumn("dest", F.when(F.col("digits") == 0, F.col("name")).otherwise(_suffixed(F.col("rel_path"), F.col("digits"))))
        named = checkpointed(named.withColumn("key", collision_key("dest")))
        clash = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        if clash.limit(1).count() == 0:
            return named.select("rel_path", "dest")
        hit = named.join(clash, "key", "left")
        if hit.where("n > 1 and digits between 8 and 39").limit(1).count() == 0:
            break
        plan = hit.select("rel_path", "name", F.when((F.col("n") > 1) & (F.col("digits") > 0), F.least(F.col("digits") + 8, F.lit(40))).otherwise(F.col("digits")).alias("digits"))
    raise ValueError("destinations clash whatever the suffix")


def _suffixed(path: Column, digits: Column) -> Column:
    out = F.lit(None).cast("string")
    for n in (8, 16, 24, 32, 40):
        out = F.when(digits == n, suffixed_name(path, n)).otherwise(out)
    return out


def transfer(plan: DataFrame, root: str, mode: str, progress: Callable[[str, int, int], None] | None = None) -> list[tuple[str, str, str]]:
    """Copies, links or moves on the driver, once: (rel_path, dest, error) each. Needs (rel_path, abs_path, dest).

    Files go in the order of selection. A progress listener that raises stops the transfer; its last
    call says that all are done.
    """
    done, of = [], plan.count() if progress else 0
    if progress:
        progress("transferring", 0, of)
    ranked = [c for c in ("pick_no", "ord") if c in plan.columns]
    for row in plan.orderBy(*ranked, "rel_path").select("rel_path", "abs_path", "dest").toLocalIterator():
        done.append((row["rel_path"], row["dest"], _place(row["abs_path"], Path(root) / row["dest"], mode)))
        if progress:
            progress("transferring", len(done), of)
    return done


def transfer_spread(plan: DataFrame, root: str, mode: str) -> list[tuple[str, str, str]]:
    """The same for copies and links, by the executors, which must see both places. What a task that is run again
    does again leaves the same files; a move would not find its source, so moves stay with transfer()."""
    if mode not in ("copy", "symlink"):
        raise ValueError("only copies and links can be made twice")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r.rel_path, r.dest, _place(r.abs_path, Path(root) / r.dest, mode)) for r in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["rel_path", "dest", "error"])

    done = checkpointed(plan.select("rel_path", "abs_path", "dest").mapInPandas(run, "rel_path string, dest string, error string"))
    return [tuple(r) for r in done.orderBy("rel_path").toLocalIterator()]


def _place(source: str, target: Path, mode: str) -> str:
    """Puts one file there; what went wrong, or nothing."""
    try:
        if not os.path.isfile(source):
            raise FileNotFoundError(source)
        target.parent.mkdir(parents=True, exist_ok=True)
        if mode == "symlink":
            target.unlink(missing_ok=True)
            target.symlink_to(os.path.realpath(source))
        else:
            (shutil.move if mode == "move" else shutil.copy2)(source, target)
        return ""
    except OSError as e:
        return str(e)


def manifest(images: DataFrame, exported: DataFrame, profile: TargetProfile, root: str, moved: bool = False) -> DataFrame:
    """One row per file that arrived, in the order of selection: that of the picks under a cap, else of collection. exported has (rel_path, dest)."""
    there = F.concat(F.lit(root.rstrip("/") + "/"), "dest")
    target = F.struct(*[F.lit(getattr(profile, k)).cast("string").alias(k) for k in ("target_style", "target_backend", "checkpoint", "target_category")])
    order = ["pick_no", "ord"] if "pick_no" in images.columns else ["ord"]
    return images.join(exported, "rel_path").orderBy(*order).select(
        F.lit(MANIFEST_VERSION).alias("manifest_version"), "rel_path", (there if moved else F.col("abs_path")).alias("abs_path"), F.col("dest").alias("exported_path"),
        there.alias("exported_abs_path"), target.alias("target_profile"), "primary_face_cluster", "primary_face_pose", F.round("score", 4).alias("score"), "similar_group",
    )


def manifest_lines(rows: DataFrame) -> DataFrame:
    """JSON lines that keep their nulls."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


# The columns of the report, in order.
REPORT = [
    "rel_path", "score", "keep", "keep_reason", "exported_path", "similar_group", "group_size", "is_representative", "passed", "reject_reason", "is_duplicate", "duplicate_of",
    "sharpness", "artifact_score", "face_count", "primary_face_cluster", "primary_face_pose", "primary_face_yaw", "width", "height", "abs_path",
]


def report(decided: DataFrame, exported: DataFrame | None) -> DataFrame:
    """A row for every image of a decided scan, grouped by likeness; exported has (rel_path, dest)."""
    rows = decided.withColumn("keep", F.col("keep_reason") == "")
    if exported is None:
        rows = rows.withColumn("exported_path", F.lit(""))
    else:
        rows = rows.join(exported.select("rel_path", F.col("dest").alias("exported_path")), "rel_path", "left").withColumn("exported_path", F.coalesce("exported_path", F.lit("")))
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("reject_reason", "duplicate_of", "primary_face_cluster", "primary_face_pose")}
    rows = rows.withColumns(texts | {"score": F.round("score", 4), "sharpness": F.round("sharpness", 2), "artifact_score": F.round("artifact_score", 4), "primary_face_yaw": F.round("primary_face_yaw", 1)})
    return rows.orderBy("similar_group", F.col("score").desc(), "ord").select(*REPORT)


def write_report(rows: DataFrame, path: str) -> None:
    """One CSV file, streamed through the driver a partition at a time."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(REPORT)
        for row in rows.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def exported_maps(exported: DataFrame, root: str) -> DataFrame:
    """(rel_path, exported_path, exported_abs_path): the two maps of an export result as a table."""
    base = str(PurePosixPath(root))
    return exported.select("rel_path", F.col("dest").alias("exported_path"), F.concat(F.lit(base + "/"), "dest").alias("exported_abs_path"))


def selected_paths(decided: DataFrame) -> DataFrame:
    """(rel_path, place): what was chosen, in the order of paths as texts, numbered from 0."""
    return with_row_number(decided.where("keep_reason = ''").select("rel_path"), ["rel_path"], "place")


def export_result(decided: DataFrame, exported: DataFrame, skipped: int = 0) -> DataFrame:
    """One row of counts; selected_paths() has the chosen paths."""
    rows = decided.join(exported.select("rel_path", F.lit(True).alias("_there")), "rel_path", "left")
    return rows.agg(
        F.count(F.when(F.col("keep_reason") == "", 1)).alias("selected"), F.count(F.when(F.col("keep_reason") != "", 1)).alias("excluded"), F.count("_there").alias("exported")
    ).withColumns({"skipped": F.lit(skipped), "manifest_version": F.lit(MANIFEST_VERSION)})
