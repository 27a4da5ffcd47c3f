"""Gates and scores of single images as Catalyst expressions; nothing here shuffles or runs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FaceConfig, ScanConfig, TargetProfile
from .rounding import exact_round

# What each kind of target rewards, in the order in which the terms are summed. A term
# is (bonus, condition); a list of terms is a ladder of which the first that holds counts. o is the
# width over the height, n the number of faces where faces are known, s the short side.
BONUS_TERMS = {
    "identity": [[(0.08, "n = 1")], [(0.03, "n >= 1")], [(0.03, "o >= 0.7D and o <= 1.35D")]],
    "wardrobe": [[(0.06, "n >= 1")], [(0.08, "o <= 0.8D"), (0.04, "o <= 1.0D")], [(0.02, "n = 1")]],
    "pose_composition": [[(0.04, "n >= 1")], [(0.07, "o <= 0.82D or o >= 1.18D"), (0.03, "o <= 0.95D or o >= 1.05D")]],
    "setting": [[(0.08, "o >= 1.15D"), (0.03, "o >= 1.0D")], [(0.03, "s >= 921")]],
}
ANIME_TERMS = {c: ([[(0.01, "true")]] if c in ("identity", "wardrobe") else []) + [[(0.01, "artifact_score >= 0.85D")]] for c in BONUS_TERMS}
BONUS_CAP = 0.15
# Factor for no face, and for two or more.
FACE_FACTORS = {"identity": (0.5, 0.4), "wardrobe": (0.75, 0.6), "pose_composition": (0.85, 0.7), "setting": (1.0, 0.85)}


def with_gates(images: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Adds passed and reject_reason; rows that fail keep their size and hash but lose their metrics."""
    short, long = F.least("width", "height"), F.greatest("width", "height")
    aspect = F.when(short > 0, long / short).otherwise(F.lit(0.0))
    sharp = F.col("sharpness_raw") if "sharpness_raw" in images.columns else F.col("sharpness")
    reason = (
        F.when(short < cfg.min_short_side, F.format_string("resolution too low (%dpx short side)", short))
        .when(aspect > cfg.max_aspect_ratio, F.format_string(f"aspect ratio %.2f > {cfg.max_aspect_ratio}", exact_round(aspect, 2)))
        .when(sharp < cfg.blur_threshold, F.format_string(f"blurry (sharpness=%.1f < {cfg.blur_threshold})", exact_round(sharp, 1)))
    )
    if "decode_error" in images.columns:
        reason = F.when(F.col("decode_error").isNotNull(), F.concat(F.lit("cannot open: "), "decode_error")).otherwise(reason)
    out = images.withColumn("reject_reason", reason).withColumn("passed", F.col("reject_reason").isNull())
    return out.withColumns({c: F.when(F.col("passed"), F.col(c)).otherwise(F.lit(0.0)) for c in ("sharpness", "artifact_score")})


def _ladder(terms: list[tuple[float, str]], faces_known: bool) -> Column | None:
    usable = [(b, c) for b, c in terms if faces_known or not c.startswith("n ")]
    if not usable:
        return None
    return reduce(lambda w, t: w.when(F.expr(t[1]), F.lit(t[0])), usable[1:], F.when(F.expr(usable[0][1]), F.lit(usable[0][0]))).otherwise(F.lit(0.0))


def with_score(images: DataFrame, profile: TargetProfile, cfg: ScanConfig, faces_known: bool) -> DataFrame:
    """Adds score and score_breakdown to the rows that passed; the others get 0 and an empty map."""
    kind = profile.target_category
    terms = BONUS_TERMS[kind] + (ANIME_TERMS[kind] if profile.target_style == "anime" else [])
    rows = images.withColumns({"o": F.col("width") / F.greatest("height", F.lit(1)), "n": F.col("face_count"), "s": F.least("width", "height")})

    def share(value: Column, ref: float) -> Column:
        return F.least(F.lit(1.0), value / F.lit(float(ref))) if ref else F.lit(0.0)

    parts = {
        "sharpness": cfg.weight_sharpness * share(F.col("sharpness"), cfg.sharpness_ref),
        "resolution": cfg.weight_resolution * share(F.col("s"), cfg.resolution_ref),
        "artifact": cfg.weight_artifact * F.col("artifact_score"),
    }
    total = cfg.weight_sharpness + cfg.weight_resolution + cfg.weight_artifact
    ladders = [x for x in (_ladder(t, faces_known) for t in terms) if x is not None]
    parts["target_bonus"] = F.least(F.lit(BONUS_CAP), reduce(lambda a, b: a + b, ladders, F.lit(0.0)))
    if faces_known:
        none, many = FACE_FACTORS[kind]
        parts["face_penalty"] = F.when(F.col("n") == 0, F.lit(none)).when(F.col("n") >= 2, F.lit(many)).otherwise(F.lit(1.0))
    # parts and sum are columns of their own: rounding names each several times
    rows = rows.withColumns({f"_{k}": v for k, v in parts.items()})
    raw = (F.col("_sharpness") + F.col("_resolution") + F.col("_artifact")) / F.lit(total or 1.0) + F.col("_target_bonus")
    rows = rows.withColumn("_raw", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * F.col("_face_penalty") if faces_known else raw)))
    entries = F.create_map(*[x for k in parts for x in (F.lit(k), exact_round(F.col(f"_{k}"), 4))])
    rows = rows.withColumns({
        "score": F.when(F.col("passed"), exact_round(F.col("_raw"), 4)).otherwise(F.lit(0.0)),
        "score_breakdown": F.when(F.col("passed"), entries).otherwise(F.create_map().cast("map<string,double>")),
    })
    return rows.drop("o", "n", "s", "_raw", *[f"_{k}" for k in parts])


def pose_bucket(yaw: Column, cfg: FaceConfig) -> Column:
    return F.when(yaw.isNotNull(), F.when(F.abs(yaw) <= cfg.frontal_max_yaw, "frontal").when(F.abs(yaw) <= cfg.three_quarter_max_yaw, "three_quarter").otherwise("profile"))


def reject_key(reason: Column) -> Column:
    """What stands before the first bracket; nothing counts as unknown."""
    return F.trim(F.split_part(F.when(F.coalesce(reason, F.lit("")) == "", "unknown").otherwise(reason), F.lit("("), F.lit(1)))


def suffixed_name(path: Column, digits: int) -> Column:
    """Base name with the first digits of the path's SHA-1 before its suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*[^.])?$", 1), F.regexp_extract(name, r"^.+?(\.[^.]*[^.])?$", 1)
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(path), 1, digits), suffix)


def scan_key(scan_id: str) -> str:
    for bad in ("/", "\\", ".."):
        scan_id = scan_id.replace(bad, "_")
    return scan_id
