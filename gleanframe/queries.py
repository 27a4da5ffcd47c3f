"""Harness queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ExportRequest, FaceConfig, ScanConfig, TargetProfile
from .functions import scoring
from .operators import dedup, export, faces, selection, summary
from .operators.ordering import checkpointed, shared_path, with_row_number
from .sources import adapter, images
from .sources.store import ScanStore

CFG = ScanConfig(cluster_distance=20)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_METRICS = adapter.METRICS_SQL.strip().removeprefix("WITH ")
_VOLUME = adapter.VOLUME_SQL.strip().removeprefix("WITH ")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the scan in SQL -------------------------------------------------------------------------
_GATED = """
gated AS (SELECT *, CASE
    WHEN least(width, height) < 512 THEN 'resolution too low (' || least(width, height) || 'px short side)'
    WHEN greatest(width, height) / least(width, height) > 3.0 THEN 'aspect ratio ' || format('{:.2f}', greatest(width, height) / least(width, height)) || ' > 3.0'
    WHEN sharpness < 100.0 THEN 'blurry (sharpness=' || format('{:.1f}', sharpness) || ' < 100.0)' END AS reject_reason FROM metrics),
passing AS (SELECT * EXCLUDE (sharpness, artifact_score), reject_reason IS NULL AS passed,
    CASE WHEN reject_reason IS NULL THEN sharpness ELSE 0.0::DOUBLE END AS sharpness, CASE WHEN reject_reason IS NULL THEN artifact_score ELSE 0.0::DOUBLE END AS artifact_score,
    width / greatest(height, 1) AS o, least(width, height) AS s FROM gated)
"""
_BONUS = {
    "identity": "(CASE WHEN face_count = 1 THEN 0.08::DOUBLE ELSE 0 END) + (CASE WHEN face_count >= 1 THEN 0.03::DOUBLE ELSE 0 END) + (CASE WHEN o BETWEEN 0.7 AND 1.35 THEN 0.03::DOUBLE ELSE 0 END)",
    "wardrobe": "(CASE WHEN face_count >= 1 THEN 0.06::DOUBLE ELSE 0 END) + (CASE WHEN o <= 0.8 THEN 0.08::DOUBLE WHEN o <= 1.0 THEN 0.04::DOUBLE ELSE 0 END) + (CASE WHEN face_count = 1 THEN 0.02::DOUBLE ELSE 0 END)",
    "pose_composition": "(CASE WHEN face_count >= 1 THEN 0.04::DOUBLE ELSE 0 END) + (CASE WHEN o <= 0.82 OR o >= 1.18 THEN 0.07::DOUBLE WHEN o <= 0.95 OR o >= 1.05 THEN 0.03::DOUBLE ELSE 0 END)",
    "setting": "(CASE WHEN o >= 1.15 THEN 0.08::DOUBLE WHEN o >= 1.0 THEN 0.03::DOUBLE ELSE 0 END) + (CASE WHEN s >= 921 THEN 0.03::DOUBLE ELSE 0 END)",
}


def _scored_sql(category: str = "identity", anime: bool = False) -> str:
    bonus = _BONUS[category]
    if anime:
        bonus += (" + 0.01::DOUBLE" if category in ("identity", "wardrobe") else "") + " + (CASE WHEN artifact_score >= 0.85 THEN 0.01::DOUBLE ELSE 0 END)"
    none, many = {"identity": (0.5, 0.4), "wardrobe": (0.75, 0.6), "pose_composition": (0.85, 0.7), "setting": (1.0, 0.85)}[category]
    return f"""{_GATED},
terms AS (SELECT *, 0.35::DOUBLE * least(1.0::DOUBLE, sharpness / 800.0::DOUBLE) AS t1, 0.3::DOUBLE * least(1.0::DOUBLE, s / 1024.0::DOUBLE) AS t2, 0.15::DOUBLE * artifact_score AS t3,
    least(0.15::DOUBLE, {bonus}) AS bonus, CASE WHEN face_count = 0 THEN {none}::DOUBLE WHEN face_count >= 2 THEN {many}::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM passing),
scored AS (SELECT *, CASE WHEN passed THEN format('{{:.4f}}', least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((t1 + t2 + t3) / (0.35::DOUBLE + 0.3::DOUBLE + 0.15::DOUBLE) + bonus) * penalty)))::DOUBLE ELSE 0.0::DOUBLE END AS score FROM terms)"""


def _scored(spark: SparkSession, sf_dir: str, category: str = "identity", style: str = "photo") -> DataFrame:
    return scoring.with_score(scoring.with_gates(adapter.metrics(spark, sf_dir), CFG), TargetProfile(style, target_category=category), CFG, True)


_PARTS = ("sharpness", "resolution", "artifact", "target_bonus", "face_penalty")


def _add_scores(name: str, category: str, style: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _scored(spark, sf_dir, category, style)
        return rows.select("ord", "passed", "score", *[F.col("score_breakdown")[p].alias(f"part_{p}") for p in _PARTS])

    run.__name__ = name
    parts = ", ".join(f"CASE WHEN passed THEN format('{{:.4f}}', {c})::DOUBLE END AS part_{p}" for c, p in zip(("t1", "t2", "t3", "bonus", "penalty"), _PARTS))
    query(f"WITH {_METRICS}, {_scored_sql(category, style == 'anime')} SELECT ord, passed, score, {parts} FROM scored")(run)


for _category in _BONUS:
    _add_scores(f"c5_score_{_category}", _category, "photo")
_add_scores("c5_score_anime_identity", "identity", "anime")
_add_scores("c5_score_anime_setting", "setting", "anime")


# ---- sources ---------------------------------------------------------------------------------
@query(f"WITH {_METRICS} SELECT rel_path, row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS walk_ord FROM metrics WHERE regexp_matches(lower(rel_path), '[^/]\\.(jpg|jpeg|png|webp)$')")
def a2_collection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.metrics(spark, sf_dir).select("rel_path").where(images.is_image(F.col("rel_path")))
    return with_row_number(rows, [images.path_order(F.col("rel_path"))], "walk_ord")


@query(f"WITH {_METRICS} SELECT split_part(rel_path, '/', 1) AS folder, least(count(*), 5000) AS n FROM metrics WHERE regexp_matches(lower(rel_path), '[^/]\\.(jpg|jpeg|png|webp)$') GROUP BY 1")
def a7_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.browse(adapter.metrics(spark, sf_dir).select("rel_path"))


# ---- gates and scores ------------------------------------------------------------------------
@query(f"WITH {_METRICS}, {_GATED} SELECT ord, passed, reject_reason, sharpness, artifact_score FROM passing")
def c1_hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_gates(adapter.metrics(spark, sf_dir), CFG).select("ord", "passed", "reject_reason", "sharpness", "artifact_score")


@query(f"WITH {_VOLUME}, {_scored_sql()} SELECT passed, count(*) AS n, sum(round(score * 10000)::BIGINT)::BIGINT AS score_sum FROM scored GROUP BY passed")
def c5_score_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_score(scoring.with_gates(adapter.volume(spark, sf_dir), CFG), TargetProfile(), CFG, True)
    return rows.groupBy("passed").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 10000).cast("bigint")).alias("score_sum"))


@query(f"WITH {_METRICS} SELECT ord, CASE WHEN abs(yaw) <= 15 THEN 'frontal' WHEN abs(yaw) <= 45 THEN 'three_quarter' ELSE 'profile' END AS pose FROM metrics")
def c6_pose_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.metrics(spark, sf_dir).select("ord", scoring.pose_bucket(F.col("yaw"), FaceConfig()).alias("pose"))


@query(f"WITH {_METRICS} SELECT ord, regexp_extract(rel_path, '([^/]+)\\.[^.]*$', 1) || '-' || substr(sha1(rel_path), 1, 8) || regexp_extract(rel_path, '\\.[^.]*$') AS name FROM metrics")
def c12_suffixed_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.metrics(spark, sf_dir).select("ord", scoring.suffixed_name(F.col("rel_path"), 8).alias("name"))


# ---- near-duplicates -------------------------------------------------------------------------
@query(f"WITH {_METRICS} SELECT a.ord AS a_ord, b.ord AS b_ord, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM metrics a JOIN metrics b ON a.ord < b.ord AND bit_count(xor(a.hash, b.hash)) <= 20")
def d0_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.metrics(spark, sf_dir).select("ord", "hash")
    pairs = dedup.near_pairs(rows, 20)
    a, b = rows.select(F.col("ord").alias("x"), F.col("hash").alias("a")), rows.select(F.col("ord").alias("y"), F.col("hash").alias("b"))
    # near_pairs has distinct hashes, so rows of one hash meet in a join of their own
    found = pairs.join(a, "a").join(b, "b").where("x <> y").unionByName(a.join(b, F.col("a") == F.col("b")).where("x < y"))
    return found.select(F.least("x", "y").alias("a_ord"), F.greatest("x", "y").alias("b_ord"), dedup.hamming(F.col("a"), F.col("b")).cast("int").alias("distance"))


_LEADERS = """
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rk FROM scored WHERE passed),
walk AS (
  SELECT 0::BIGINT AS rk, NULL::VARCHAR AS rel_path, []::STRUCT(h UBIGINT, p VARCHAR)[] AS reps, NULL::VARCHAR AS duplicate_of
  UNION ALL
  SELECT r.rk, r.rel_path, CASE WHEN len(list_filter(w.reps, lambda x: bit_count(xor(x.h, r.hash)) <= 20)) = 0 THEN list_append(w.reps, struct_pack(h := r.hash, p := r.rel_path)) ELSE w.reps END,
    list_filter(w.reps, lambda x: bit_count(xor(x.h, r.hash)) <= 20)[1].p
  FROM walk w JOIN ranked r ON r.rk = w.rk + 1),
results AS (SELECT s.*, w.duplicate_of, w.duplicate_of IS NOT NULL AS is_duplicate FROM scored s LEFT JOIN walk w ON s.rel_path = w.rel_path)"""
_GROUPS = """
heads AS (SELECT *, coalesce(duplicate_of, rel_path) AS head FROM results),
sizes AS (SELECT head, count(*) AS group_size, row_number() OVER (ORDER BY min(ord)) AS similar_group FROM heads GROUP BY head),
grouped AS (SELECT h.*, group_size, similar_group, NOT is_duplicate AS is_representative,
  CASE WHEN abs(yaw) <= 15 THEN 'frontal' WHEN abs(yaw) <= 45 THEN 'three_quarter' ELSE 'profile' END AS primary_face_pose,
  CASE WHEN label % 3 = 0 THEN NULL ELSE 'face_' || (label % 3) END AS primary_face_cluster FROM heads h JOIN sizes USING (head))"""
_RESULTS = f"WITH RECURSIVE {_METRICS}, {_scored_sql()}, {_LEADERS}"
_ALL = f"{_RESULTS}, {_GROUPS}"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished scan over the adapter, with poses and identities filled in."""
    rows = dedup.with_groups(dedup.greedy_leaders(checkpointed(_scored(spark, sf_dir)), CFG.cluster_distance))
    return rows.withColumns({
        "abs_path": F.concat(F.lit("/data/"), "rel_path"), "primary_face_pose": scoring.pose_bucket(F.col("yaw"), FaceConfig()), "primary_face_yaw": F.col("yaw"),
        "primary_face_cluster": F.when(F.col("label") % 3 != 0, F.concat(F.lit("face_"), (F.col("label") % 3).cast("string"))),
    })


@query(f"{_RESULTS} SELECT ord, is_duplicate, duplicate_of FROM results")
def d1_greedy_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_leaders(checkpointed(_scored(spark, sf_dir)), CFG.cluster_distance).select("ord", "is_duplicate", "duplicate_of")


@query(f"{_ALL} SELECT ord, similar_group, group_size, is_representative FROM grouped")
def d2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("ord", "similar_group", "group_size", "is_representative")


@query(f"{_ALL} SELECT count(*) AS similar_clusters FROM sizes WHERE group_size > 1")
def d3_multi_member_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.multi_member_groups(_results(spark, sf_dir))


# ---- faces -----------------------------------------------------------------------------------
def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    x, y = ((v * 13) % 400).cast("double"), ((v * 17) % 300).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        v.alias("face_id"), F.concat(F.lit("img_"), F.floor(v / 3).cast("string")).alias("rel_path"), x.alias("x1"), y.alias("y1"), (x + (v * 29) % 200 + 1).alias("x2"), (y + (v * 31) % 160 + 1).alias("y2"),
        (((v * 37) % 100) / F.lit(100.0)).alias("det_score"), ((v * 53) % 181 - 90).cast("double").alias("yaw"), ((v * 7) % 61 - 30).cast("double").alias("pitch"), F.when(v % 11 != 0, F.col("embedding")).alias("embedding"),
    )


_FACES = """
faces AS (SELECT vec_id AS face_id, 'img_' || (vec_id // 3) AS rel_path, (vec_id * 13) % 400 * 1.0::DOUBLE AS x, (vec_id * 17) % 300 * 1.0::DOUBLE AS y,
  ((vec_id * 29) % 200 + 1)::DOUBLE AS w, ((vec_id * 31) % 160 + 1)::DOUBLE AS h, ((vec_id * 37) % 100) / 100.0::DOUBLE AS det_score, ((vec_id * 53) % 181 - 90)::DOUBLE AS yaw, embedding
  FROM embeddings WHERE ((vec_id * 37) % 100) / 100.0::DOUBLE >= 0.5 AND vec_id % 11 <> 0),
unit AS (SELECT *, w * h AS area, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z::DOUBLE))) + 1e-9::DOUBLE)) AS v,
  CASE WHEN abs(yaw) <= 15 THEN 'frontal' WHEN abs(yaw) <= 45 THEN 'three_quarter' ELSE 'profile' END AS pose, row_number() OVER (ORDER BY face_id) AS rk FROM faces),
walk AS (
  SELECT 0::BIGINT AS rk, NULL::BIGINT AS face_id, []::STRUCT(i BIGINT, v DOUBLE[])[] AS leaders, NULL::BIGINT AS label
  UNION ALL
  SELECT rk, face_id, CASE WHEN d IS NULL OR d >= 0.72 THEN list_append(leaders, struct_pack(i := face_id, v := v)) ELSE leaders END, CASE WHEN d IS NULL OR d >= 0.72 THEN face_id ELSE near END
  FROM (SELECT u.rk, u.face_id, u.v, w.leaders, list_min(list_transform(w.leaders, lambda l: 1.0::DOUBLE - list_inner_product(l.v, u.v))) AS d,
          list_min(list_transform(w.leaders, lambda l: struct_pack(d := 1.0::DOUBLE - list_inner_product(l.v, u.v), i := l.i))).i AS near
        FROM walk w JOIN unit u ON u.rk = w.rk + 1)),
labelled AS (SELECT u.*, w.label FROM unit u JOIN walk w USING (face_id)),
clusters AS (SELECT label, 'face_' || row_number() OVER (ORDER BY count(*) DESC, label) AS cluster_id, count(*) AS size, arg_max(rel_path, struct_pack(a := det_score * area, b := -face_id)) AS representative FROM labelled GROUP BY label)"""
_EPS = 0.72


def _labelled(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return checkpointed(faces.identities(faces.valid_faces(_detections(spark, sf_dir), FaceConfig()), _EPS, method))


@query(f"WITH RECURSIVE {_FACES} SELECT face_id, rel_path, x, y, w, h, area, pose FROM unit")
def c7_valid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.valid_faces(_detections(spark, sf_dir), FaceConfig()).select("face_id", "rel_path", "x", "y", "w", "h", "area", "pose")


@query(f"WITH RECURSIVE {_FACES} SELECT face_id, label FROM labelled")
def e6_first_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, "leaders").select("face_id", "label")


# distances between clusters, their sizes, and each face's cluster: a step merges the two nearest ones
_LINKAGE = f"""{_FACES.split("walk AS (")[0].rstrip().rstrip(",")},
matrix AS (SELECT a.rk, list(CASE WHEN a.rk = b.rk THEN 'infinity'::DOUBLE ELSE 1.0::DOUBLE - list_inner_product(a.v, b.v) END ORDER BY b.rk) AS r FROM unit a CROSS JOIN unit b GROUP BY a.rk),
linkage AS (
  SELECT 0 AS step, (SELECT list(r ORDER BY rk) FROM matrix) AS d, (SELECT list(1.0::DOUBLE ORDER BY rk) FROM unit) AS size, (SELECT list(rk ORDER BY rk) FROM unit) AS label
  UNION ALL
  SELECT step + 1,
    list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i = b THEN gone WHEN i = a THEN merged ELSE list_transform(d[i], lambda x, j: CASE WHEN j = a THEN merged[i] WHEN j = b THEN 'infinity'::DOUBLE ELSE x END) END),
    list_transform(size, lambda s, j: CASE WHEN j = a THEN size[a] + size[b] ELSE s END), list_transform(label, lambda l: CASE WHEN l = b THEN a ELSE l END)
  FROM (SELECT *, list_transform(d[a], lambda x: 'infinity'::DOUBLE) AS gone,
          list_transform(d[a], lambda x, j: CASE WHEN j = a OR j = b THEN 'infinity'::DOUBLE ELSE (x * size[a] + d[b][j] * size[b]) / (size[a] + size[b]) END) AS merged
        FROM (SELECT *, list_position(d[a], m) AS b FROM (SELECT *, list_position(mins, m) AS a FROM (SELECT *, list_min(mins) AS m FROM (SELECT *, list_transform(d, lambda r: list_min(r)) AS mins FROM linkage))))
        WHERE m < 0.72)),
last AS (SELECT label FROM linkage ORDER BY step DESC LIMIT 1),
found AS (SELECT unnest(label) AS l, unnest(range(1, len(label) + 1)) AS rk FROM last)"""


@query(f"WITH RECURSIVE {_LINKAGE} SELECT u.face_id, f.face_id AS label FROM found JOIN unit u USING (rk) JOIN unit f ON f.rk = found.l")
def e6_average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir, "average").select("face_id", "label")


@query(f"WITH RECURSIVE {_FACES} SELECT cluster_id, size, representative FROM clusters")
def e7_named_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = faces.named_clusters(_labelled(spark, sf_dir, "leaders"))
    return named.select("cluster_id", "size", F.col("representative_rel_path").alias("representative"))


@query(f"WITH RECURSIVE {_FACES} SELECT cluster_id, size, representative, row_number() OVER (ORDER BY size DESC, label) - 1 AS place FROM clusters")
def e10_cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = faces.cluster_table(faces.named_clusters(_labelled(spark, sf_dir, "leaders")))
    numbered = with_row_number(table.withColumn("_at", F.monotonically_increasing_id()), ["_at"], "place")
    return numbered.select("cluster_id", "size", F.col("representative_rel_path").alias("representative"), "place")


@query(f"""WITH RECURSIVE {_FACES} SELECT rel_path, count(*) AS face_count, arg_max(cluster_id, struct_pack(a := area * (0.5::DOUBLE + 0.5::DOUBLE * det_score), b := -face_id)) AS primary_face_cluster,
  arg_max(pose, struct_pack(a := area * (0.5::DOUBLE + 0.5::DOUBLE * det_score), b := -face_id)) AS primary_face_pose FROM labelled JOIN clusters USING (label) GROUP BY rel_path""")
def e9_primary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir, "leaders")
    named = labelled.join(faces.named_clusters(labelled).select("label", "cluster_id"), "label")
    return faces.primary_faces(named).select("rel_path", "face_count", "primary_face_cluster", "primary_face_pose")


@query("""SELECT vec_id AS face_id, greatest(0.0::DOUBLE, 1 - (abs(((vec_id * 13) % 400 + ((vec_id * 29) % 200 + 1) / 2) / 640 - 0.5::DOUBLE) * 2 + abs(((vec_id * 17) % 300 + ((vec_id * 31) % 160 + 1) / 2) / 480 - 0.5::DOUBLE) * 2) / 2) AS centrality FROM embeddings""")
def c8_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _detections(spark, sf_dir)
    return box.select("face_id", faces.centrality(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(640), F.lit(480)).alias("centrality"))


@query(f"""WITH RECURSIVE {_FACES} SELECT rel_path, row_number() OVER (PARTITION BY rel_path ORDER BY face_id) - 1 AS face_no, x, y, w, h, det_score, cluster_id, pose,
  row_number() OVER (PARTITION BY rel_path ORDER BY area * (0.5::DOUBLE + 0.5::DOUBLE * det_score) DESC, face_id) = 1 AS is_primary FROM labelled JOIN clusters USING (label)""")
def e4_faces_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir, "leaders")
    per_image = faces.faces_per_image(labelled.join(faces.named_clusters(labelled).select("label", "cluster_id"), "label"))
    one = per_image.select("rel_path", F.posexplode("faces").alias("face_no", "f"))
    box = {c: F.col("f.bbox")[k] for k, c in enumerate("xywh")}
    return one.select("rel_path", F.col("face_no").cast("bigint").alias("face_no"), *[v.alias(k) for k, v in box.items()], "f.det_score", "f.cluster_id", "f.pose", F.col("f.primary").alias("is_primary"))


# ---- selection -------------------------------------------------------------------------------
REQUEST = ExportRequest(min_score=0.35, face_clusters=("face_1", "face_2"), face_poses=("frontal", "three_quarter"))
_REASONS = """CASE WHEN score < 0.35 THEN 'below-score' WHEN NOT passed THEN reject_reason WHEN is_duplicate THEN 'similar-to:' || duplicate_of
  WHEN primary_face_cluster IS NULL OR primary_face_cluster NOT IN ('face_1', 'face_2') THEN 'face-cluster-excluded' WHEN primary_face_pose NOT IN ('frontal', 'three_quarter') THEN 'face-pose-excluded' END"""
_ELIGIBLE = f"{_ALL}, decided AS (SELECT *, {_REASONS} AS reason FROM grouped), eligible AS (SELECT * FROM decided WHERE reason IS NULL)"
_PICKS = """
picks AS (
  SELECT 0 AS pick_no, NULL::BIGINT AS ord, []::UBIGINT[] AS hs, []::BIGINT[] AS os
  UNION ALL
  SELECT pick_no + 1, ord, list_append(hs, hash), list_append(os, ord) FROM (
    SELECT p.pick_no, c.ord, p.hs, p.os, c.hash, row_number() OVER (ORDER BY c.score / (SELECT max(score) FROM eligible) * (1.0::DOUBLE - 0.4::DOUBLE)
      + (CASE WHEN len(p.hs) = 0 THEN 1.0::DOUBLE ELSE list_min(list_transform(p.hs, lambda x: bit_count(xor(x, c.hash)))) / 64.0::DOUBLE END) * 0.4::DOUBLE DESC, c.ord) AS k
    FROM picks p CROSS JOIN eligible c WHERE p.pick_no < 12 AND NOT list_contains(p.os, c.ord)) WHERE k = 1)"""


@query(f"{_ELIGIBLE} SELECT ord, coalesce(reason, '') AS keep_reason FROM decided")
def f1_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.decide(_results(spark, sf_dir), REQUEST, 0.4).select("ord", "keep_reason")


@query(f"WITH {_METRICS} SELECT ord, CASE WHEN ord IN (3, 40, 77) THEN '' ELSE 'not-selected' END AS keep_reason FROM metrics")
def f4_inline_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.metrics(spark, sf_dir)
    paths = tuple(r[0] for r in rows.where(F.col("ord").isin(3, 40, 77)).select("rel_path").collect())
    return selection.decide(rows, ExportRequest(selection=(*paths, "no/such.png")), 0.4).select("ord", "keep_reason")


@query(f"WITH {_METRICS}, {_scored_sql()} SELECT ord, score FROM scored ORDER BY score DESC, ord LIMIT 25")
def f5_top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_by_score(_scored(spark, sf_dir), 25).select("ord", "score")


@query(f"{_ELIGIBLE}, {_PICKS} SELECT ord, pick_no FROM picks WHERE pick_no > 0")
def f6_diverse_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.with_gate_reasons(_results(spark, sf_dir), REQUEST).where("keep_reason is null")
    return selection.diverse_picks(rows, 12, 0.4)


@query(f"{_ELIGIBLE}, {_PICKS} SELECT ord, coalesce(reason, CASE WHEN ord IN (SELECT ord FROM picks WHERE pick_no > 0) THEN '' ELSE 'diversity-trimmed' END) AS keep_reason FROM decided")
def f7_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = ExportRequest(min_score=0.35, face_clusters=REQUEST.face_clusters, face_poses=REQUEST.face_poses, max_keep=12)
    return selection.decide(_results(spark, sf_dir), req, 0.4).select("ord", "keep_reason")


# ---- counts, orders, pages -------------------------------------------------------------------
@query(f"{_ALL} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS rejected, count(*) FILTER (passed AND is_duplicate) AS duplicates FROM grouped")
def g1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.counts(_results(spark, sf_dir))


@query(f"WITH {_METRICS}, {_GATED} SELECT trim(split_part(reject_reason, '(', 1)) AS reason, count(*) AS n, min(ord) AS first_ord FROM passing WHERE NOT passed GROUP BY 1")
def g2_reject_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.reject_tally(scoring.with_gates(adapter.metrics(spark, sf_dir), CFG))


@query(f"{_ALL} SELECT primary_face_pose, count(*) AS n FROM grouped GROUP BY 1")
def g3_pose_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.pose_distribution(_results(spark, sf_dir))


@query(f"{_ALL} SELECT ord, row_number() OVER (ORDER BY similar_group, score DESC, ord) - 1 AS line FROM grouped")
def g5_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select("ord", "similar_group", "score")
    return with_row_number(rows, ["similar_group", F.col("score").desc(), "ord"], "line").select("ord", "line")


@query(f"{_ALL} SELECT ord, similar_group, score FROM grouped ORDER BY ord LIMIT 20 OFFSET 30")
def g6_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ScanStore(spark, shared_path(spark, "store"))
    store.save("a/b", _results(spark, sf_dir).select("ord", "similar_group", "score"))
    return store.load_page("a/b", 30, 20)


@query(f"""{_ALL}, totals AS (SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS rejected, count(*) FILTER (passed AND is_duplicate) AS duplicates FROM grouped)
SELECT page.*, totals.*, (SELECT count(*) FROM sizes WHERE group_size > 1) AS similar_clusters FROM (SELECT ord, similar_group, score FROM grouped ORDER BY ord LIMIT 20 OFFSET 30) page, totals""")
def g6_page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ScanStore(spark, shared_path(spark, "store"))
    results = checkpointed(_results(spark, sf_dir))
    totals = summary.counts(results).first().asDict() | {"similar_clusters": dedup.multi_member_groups(results).first()[0]}
    store.save("a/b", results.select("ord", "similar_group", "score"), totals)
    page = store.page_with_totals("a/b", 30, 20)
    rows = spark.createDataFrame([(r["ord"], r["similar_group"], r["score"]) for r in page["results"]], "ord bigint, similar_group bigint, score double")
    return rows.withColumns({k: F.lit(page[k]).cast("bigint") for k in totals})


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def g14_label_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("n"))


# ---- exports ---------------------------------------------------------------------------------
def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    number = F.when(v % 7 < 5, v % 75).otherwise(v + 1000)
    name = F.concat(F.when(v % 2 == 0, "img_").otherwise("IMG_"), number.cast("string"), F.lit(".png"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("d"), F.floor(v / 75).cast("string"), F.lit("/"), name).alias("rel_path"))


@query("""WITH p AS (SELECT 'd' || (vec_id // 75) || '/' || CASE WHEN vec_id % 2 = 0 THEN 'img_' ELSE 'IMG_' END || CASE WHEN vec_id % 7 < 5 THEN vec_id % 75 ELSE vec_id + 1000 END || '.png' AS rel_path FROM embeddings),
n AS (SELECT rel_path, split_part(rel_path, '/', 2) AS name FROM p)
SELECT rel_path, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN replace(name, '.png', '') || '-' || substr(sha1(rel_path), 1, 8) || '.png' ELSE name END AS dest FROM n""")
def h1_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.destinations(_flat(spark, sf_dir), True)


def _exported(decided: DataFrame) -> DataFrame:
    return export.destinations(decided.where("keep_reason = ''"), False)


@query(f"""{_ELIGIBLE} SELECT '2.1' AS manifest_version, rel_path, '/data/' || rel_path AS abs_path, rel_path AS exported_path, '/out/' || rel_path AS exported_abs_path, 'identity' AS target_category,
  primary_face_cluster, primary_face_pose, score, similar_group FROM eligible""")
def h3_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = checkpointed(selection.decide(_results(spark, sf_dir), REQUEST, 0.4))
    rows = export.manifest(decided, _exported(decided), TargetProfile(), "/out")
    return rows.withColumn("target_category", F.col("target_profile.target_category")).drop("target_profile")


CAPPED = ExportRequest(min_score=0.35, face_clusters=REQUEST.face_clusters, face_poses=REQUEST.face_poses, max_keep=12)


@query(f"{_ELIGIBLE}, {_PICKS} SELECT e.rel_path, e.score, p.pick_no::BIGINT - 1 AS line FROM picks p JOIN eligible e USING (ord)")
def h3_manifest_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = checkpointed(selection.decide(_results(spark, sf_dir), CAPPED, 0.4))
    rows = export.manifest(decided, _exported(decided), TargetProfile(), "/out")
    return rows.select("rel_path", "score", F.monotonically_increasing_id().alias("_at")).transform(lambda d: with_row_number(d, ["_at"], "line")).drop("_at")


@query(f"{_ELIGIBLE} SELECT rel_path, row_number() OVER (ORDER BY rel_path) - 1 AS place FROM eligible")
def h6_selected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.selected_paths(selection.decide(_results(spark, sf_dir), REQUEST, 0.4))


@query(f"""{_ELIGIBLE} SELECT rel_path, score, reason IS NULL AS keep, coalesce(reason, '') AS keep_reason, CASE WHEN reason IS NULL THEN rel_path ELSE '' END AS exported_path, similar_group, group_size,
  is_representative, passed, coalesce(reject_reason, '') AS reject_reason, is_duplicate, coalesce(duplicate_of, '') AS duplicate_of, round(sharpness, 2) AS sharpness, round(artifact_score, 4) AS artifact_score, face_count,
  coalesce(primary_face_cluster, '') AS primary_face_cluster, primary_face_pose, yaw AS primary_face_yaw, width, height, '/data/' || rel_path AS abs_path FROM decided""")
def h4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = checkpointed(selection.decide(_results(spark, sf_dir), REQUEST, 0.4))
    return export.report(decided, _exported(decided))


@query(f"{_ELIGIBLE} SELECT count(*) FILTER (reason IS NULL) AS selected, count(*) FILTER (reason IS NOT NULL) AS excluded, count(*) FILTER (reason IS NULL) AS exported, 0 AS skipped, '2.1' AS manifest_version FROM decided")
def h6_export_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = checkpointed(selection.decide(_results(spark, sf_dir), REQUEST, 0.4))
    return export.export_result(decided, _exported(decided))


@query(f"{_ELIGIBLE} SELECT rel_path, rel_path AS exported_path, '/out/' || rel_path AS exported_abs_path FROM eligible")
def h5_exported_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = selection.decide(_results(spark, sf_dir), REQUEST, 0.4)
    return export.exported_maps(_exported(decided), "/out")
