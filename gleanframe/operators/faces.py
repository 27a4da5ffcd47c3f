"""Faces of images: validity, poses, identities, and the face that stands for an image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FaceConfig
from ..functions.rounding import exact_round
from ..functions.scoring import pose_bucket
from .ordering import checkpointed, with_row_number


NO_FACE = (1 << 63) - 1
#: Faces up to which average linkage holds the matrix of all pairs.
SMALL = 2048
#: Rows of distances that are held at a time beyond that.
ROWS_AT_ONCE = 64


def valid_faces(detections: DataFrame, cfg: FaceConfig) -> DataFrame:
    """Detections(ord, rel_path, face_no, x1, y1, x2, y2, det_score, yaw, pitch, embedding) worth keeping.

    Adds the box as x, y, w, h to one decimal, its area, the pose and the face's place in input order.
    """
    kept = detections.where((F.col("det_score") >= cfg.min_det_score) & F.col("embedding").isNotNull())
    box = {"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}
    kept = kept.withColumns({k: exact_round(v, 1) for k, v in box.items()})
    return kept.withColumns({"area": F.col("w") * F.col("h"), "pose": pose_bucket(F.col("yaw"), cfg), "yaw": exact_round(F.col("yaw"), 2), "pitch": exact_round(F.col("pitch"), 2)})


def normalised(vector: Column) -> Column:
    """The vector at length one; a vanishing one stays nothing."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.array(length), lambda n: F.transform(vector, lambda x: x.cast("double") / (n + F.lit(1e-9))))[0]


def centrality(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """1 in the middle of the image, 0 in a corner."""
    dx = F.abs((x + w / 2) / width - 0.5) * 2
    dy = F.abs((y + h / 2) / height - 0.5) * 2
    return F.greatest(F.lit(0.0), 1 - (dx + dy) / 2)


def average_linkage(vectors: np.ndarray, eps: float) -> np.ndarray:
    """Labels (by first member) of average-linkage clusters, merged while the least mean cosine distance is below eps.

    At most SMALL faces are merged by a matrix of all distances, any more by the clusters' means.
    """
    n = len(vectors)
    if n > SMALL:
        return linkage_of_means(vectors, eps)
    d = 1.0 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    # each row's nearest neighbour is kept, so a merge costs a row instead of the whole matrix
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    least = d[np.arange(n), near]
    for _ in range(n - 1):
        a = int(np.argmin(least))
        b = int(near[a])
        if not least[a] < eps:
            break
        a, b = min(a, b), max(a, b)
        row = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        d[a, :], d[:, a] = row, row
        d[a, a] = np.inf
        d[b, :], d[:, b] = np.inf, np.inf
        least[b] = np.inf
        label[label == b] = a
        # rows whose neighbour was merged look again; any other can only have come nearer to the merged one
        again = np.nonzero((near == a) | (near == b) | (np.arange(n) == a))[0]
        again = again[again != b]
        near[again] = d[again].argmin(axis=1)
        least[again] = d[again, near[again]]
        closer = d[a] < least
        near[closer], least[closer] = a, d[a][closer]
        ties = (d[a] == least) & (a < near) & np.isfinite(least)
        near[ties] = a
    return label


def linkage_of_means(vectors: np.ndarray, eps: float) -> np.ndarray:
    """The same labels from the clusters' mean vectors, without a matrix of all pairs.

    The mean of the pairs' cosine distances of two clusters is one less the product of their means. A merged cluster
    is no nearer to any other than the nearer of its parts was, so two clusters that are each other's nearest merge
    before either meets a third: all such pairs of a round merge at once. Each row keeps its nearest cluster and a
    bound of all others, and looks again once its nearest has grown further away than that bound. Memory is that of
    the vectors and ROWS_AT_ONCE rows of distances. Of different pairs at equal distance rounding decides which merges first.
    """
    # equal vectors merge first, unless they are so short that they lie apart
    _, first, copy_of, size = np.unique(vectors, axis=0, return_index=True, return_inverse=True, return_counts=True)
    label = np.where(1.0 - np.einsum("ij,ij->i", vectors, vectors) < min(eps, 1e-6), first[copy_of.ravel()], np.arange(len(vectors)))
    name, size = np.unique(label, return_counts=True)
    mean, size, head = vectors[name], size.astype(float), np.arange(len(vectors))
    near, least, second = np.zeros(len(name), np.int64), np.full(len(name), -np.inf), np.full(len(name), -np.inf)
    stale = np.ones(len(name), bool)

    def look(rows: np.ndarray) -> None:
        for at in range(0, len(rows), ROWS_AT_ONCE):
            k = rows[at : at + ROWS_AT_ONCE]
            i = np.arange(len(k))
            d = 1.0 - mean[k] @ mean.T
            d[:, gone] = np.inf
            d[i, k] = np.inf
            near[k] = d.argmin(axis=1)
            least[k] = d[i, near[k]]
            d[i, near[k]] = np.inf
            second[k] = d.min(axis=1)
        stale[rows] = False

    gone = np.zeros(len(name), bool)
    if len(name):
        look(np.arange(len(name)))
    while True:
        # nothing below eps is left for these, now or later
        gone |= least >= eps
        least[gone] = np.inf
        stale |= gone[near]
        if gone.sum() * 4 > len(gone):
            at = np.cumsum(~gone) - 1
            name, mean, size, least, second, stale, near = (x[~gone] for x in (name, mean, size, least, second, stale, at[near]))
            gone = np.zeros(len(name), bool)
        if not len(name) or not np.isfinite(least).any():
            break
        own = np.arange(len(name))
        a = np.nonzero((near[near] == own) & (own < near) & ~stale & ~stale[near] & ~gone)[0]
        if not len(a) and (rows := np.nonzero(stale & ~gone)[0]).size:
            look(rows[np.argsort(least[rows], kind="stable")[:ROWS_AT_ONCE]])
            continue
        if not len(a):  # equal distances that rounding has told apart
            pair = sorted((int(np.argmin(least)), int(near[np.argmin(least)])))
            near[pair] = pair[::-1]
            a = np.array(pair[:1])
        b = near[a]
        both = size[a] + size[b]
        mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / both[:, None]
        size[a] = both
        into = own.copy()
        into[b] = a
        gone[b], least[b] = True, np.inf
        head[name[b]] = name[a]
        merged = np.zeros(len(name), bool)
        merged[a] = merged[b] = True
        k = np.nonzero(merged[near] & ~merged & ~gone & ~stale)[0]
        near[k] = into[near[k]]
        d = 1.0 - np.einsum("ij,ij->i", mean[k], mean[near[k]])
        least[k], stale[k] = np.minimum(d, second[k]), d > second[k]
        look(a)
    while not np.array_equal(head, head[head]):
        head = head[head]
    return head[label]


def first_leaders(vectors: np.ndarray, eps: float) -> np.ndarray:
    """Labels (by first member): each face joins the nearest leader closer than eps, or leads from now on."""
    leaders: list[int] = []
    label = np.empty(len(vectors), np.int64)
    for k in range(len(vectors)):
        near = 1.0 - vectors[leaders] @ vectors[k] if leaders else np.zeros(0)
        best = int(np.argmin(near)) if len(near) else -1
        if best >= 0 and near[best] < eps:
            label[k] = leaders[best]
        else:
            leaders.append(k)
            label[k] = k
    return label


def identities(faces: DataFrame, eps: float, method: str = "average") -> DataFrame:
    """Adds label to faces(face_id, embedding): the face_id of its identity's first member.

    Faces further apart than eps from one another never merge, so the graph of pairs closer than eps
    falls into components that are clustered by themselves, each in one task. Clustering within a
    component takes memory in proportion to its faces and time by their square. Pairs are compared in
    blocks of faces times blocks of faces as matrix products.
    """
    own = checkpointed(faces.select("face_id", normalised(F.col("embedding")).alias("v")))
    blocks = max(1, -(-own.count() // 2048))
    dealt = own.withColumn("b", F.pmod(F.xxhash64("face_id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("o", F.explode(F.sequence(F.col("b"), F.lit(blocks - 1)))).select(F.col("b").alias("i"), F.col("o").alias("j"), "face_id", "v")
    right = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b")))).select(F.col("o").alias("i"), F.col("b").alias("j"), "face_id", "v")

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        u, v = a["face_id"].to_numpy(), b["face_id"].to_numpy()
        close = 1.0 - x @ y.T < eps
        # a star from the least face of each part of the blocks' graph, instead of all its pairs
        least_u, least_v = u.copy(), v.copy()
        while True:
            new_v = np.minimum(least_v, np.where(close, least_u[:, None], NO_FACE).min(axis=0))
            new_u = np.minimum(least_u, np.where(close, new_v[None, :], NO_FACE).min(axis=1))
            if np.array_equal(new_u, least_u) and np.array_equal(new_v, least_v):
                break
            least_u, least_v = new_u, new_v
        ids, roots = np.concatenate((u, v)), np.concatenate((least_u, least_v))
        return pd.DataFrame({"u": roots, "v": ids})[roots != ids]

    edges = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(near, "u bigint, v bigint").distinct()
    parts = components(own.select(F.col("face_id").alias("node")), edges)
    cluster = average_linkage if method == "average" else first_leaders

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("face_id")
        ids = part["face_id"].to_numpy()
        return pd.DataFrame({"face_id": ids, "label": ids[cluster(np.stack(part["v"].to_numpy()), eps)]})

    labels = own.join(parts.withColumnRenamed("node", "face_id"), "face_id").groupBy("component").applyInPandas(label, "face_id bigint, label bigint")
    return faces.join(labels, "face_id")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by rounds of taking the neighbours' least and jumping to its own."""
    both = checkpointed(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    state = checkpointed(nodes.select("node", F.col("node").alias("component")))
    while True:
        least = both.join(state.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        joined = state.join(least, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = joined.select(F.col("node").alias("next"), F.col("next").alias("over"))
        after = checkpointed(joined.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("over", "next")).alias("next")))
        moved = after.where("component <> next").limit(1).count()
        state = after.select("node", F.col("next").alias("component"))
        if not moved:
            return state


def named_clusters(labelled: DataFrame) -> DataFrame:
    """(label, cluster_id, size, representative_*): face_1 is the largest, ties go to the earlier first member.

    The representative has the highest detection score times area; the first of equals.
    """
    best = F.max_by(F.struct("rel_path", "x", "y", "w", "h"), F.struct(F.col("det_score") * F.when(F.col("area") == 0, 1.0).otherwise(F.col("area")), -F.col("face_id")))
    groups = labelled.groupBy("label").agg(F.count("*").alias("size"), best.alias("best"))
    groups = with_row_number(groups, [F.col("size").desc(), "label"], "n", 1)
    return groups.select("label", F.concat(F.lit("face_"), F.col("n").cast("string")).alias("cluster_id"), "size", F.col("best.rel_path").alias("representative_rel_path"), *[F.col(f"best.{c}").alias(f"representative_{c}") for c in "xywh"])


def _presence() -> Column:
    """A face's size times its certainty, which is stored with four decimals."""
    return F.col("area") * (0.5 + 0.5 * exact_round(F.col("det_score"), 4))


def cluster_table(named: DataFrame) -> DataFrame:
    """(cluster_id, size, representative_rel_path, representative_bbox) in order: largest first, then by first member."""
    rows = named.orderBy(F.substring_index("cluster_id", "_", -1).cast("bigint"))
    return rows.select("cluster_id", "size", "representative_rel_path", F.array(*[f"representative_{c}" for c in "xywh"]).alias("representative_bbox"))


FACES_TYPE = "array<struct<bbox:array<double>,det_score:double,cluster_id:string,primary:boolean,yaw:double,pitch:double,pose:string>>"


def primary_faces(named: DataFrame) -> DataFrame:
    """(rel_path, face_count, primary_face_cluster, primary_face_pose, primary_face_yaw) by size and certainty of the face."""
    best = F.max_by(F.struct("cluster_id", "pose", "yaw"), F.struct(_presence(), -F.col("face_id")))
    found = named.groupBy("rel_path").agg(F.count("*").alias("face_count"), best.alias("b"))
    return found.select("rel_path", "face_count", F.col("b.cluster_id").alias("primary_face_cluster"), F.col("b.pose").alias("primary_face_pose"), F.col("b.yaw").alias("primary_face_yaw"))


def faces_per_image(named: DataFrame) -> DataFrame:
    """(rel_path, faces): an array of structs in input order; the primary face is marked."""
    w = Window.partitionBy("rel_path").orderBy(_presence().desc(), "face_id")
    marked = named.withColumn("primary", F.row_number().over(w) == 1).withColumn("det_score", exact_round(F.col("det_score"), 4))
    one = F.struct("face_id", F.array("x", "y", "w", "h").alias("bbox"), "det_score", "cluster_id", "primary", "yaw", "pitch", "pose")
    return marked.groupBy("rel_path").agg(F.transform(F.sort_array(F.collect_list(one)), lambda f: f.dropFields("face_id")).alias("faces"))
