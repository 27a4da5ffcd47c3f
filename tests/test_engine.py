"""Operators of the image engine against sequential restatements."""

import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from gleanframe.config import ExportRequest, FaceConfig, ScanConfig, TargetProfile
from gleanframe.functions import scoring
from gleanframe.functions.rounding import exact_round
from gleanframe.operators import dedup, export, faces, selection, summary
from gleanframe.plans import scan as plans
from gleanframe.sources import images
from gleanframe.sources.store import ScanStore
from pyspark.sql import functions as F

IMAGE = "ord long, rel_path string, score double, hash long, passed boolean"


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b""))


def noise(seed, n=768):
    return np.random.default_rng(seed).integers(0, 255, (n, n, 3), np.uint8)


def test_exact_round_is_pythons(spark):
    rng = random.Random(5)
    values = [rng.uniform(-2, 2) for _ in range(300)] + [k / 32 for k in range(-40, 40)] + [2.675, 5e-5, 0.07125, 31.45, 1.00005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (1, 2, 4):
        for v, r in df.select("x", exact_round(F.col("x"), d)).collect():
            assert r == round(v, d), (v, d)


def leaders(rows, d):
    reps, out = [], {}
    for o, rel, score, h, ok in sorted((r for r in rows if r[4] and r[3] is not None), key=lambda r: (-r[2], r[0])):
        lead = next((p for x, p in reps if bin((x ^ h) & (1 << 64) - 1).count("1") <= d), None)
        if lead is None:
            reps.append((h, rel))
        else:
            out[rel] = lead
    return out


@pytest.mark.parametrize("d, edges", [(-1, 1), (0, 1), (1, 1), (3, 1), (10, 0), (10, 10**6), (64, 10**6)])
def test_greedy_leaders(spark, d, edges, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL_EDGES", edges)
    if d != 64:
        monkeypatch.setattr(dedup, "AT_ONCE", 0)  # not read in order by one task
    rng = random.Random(d)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for k in range(120):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            h ^= 1 << rng.randrange(64)
        rows.append((k, f"p{k}", rng.choice([0.1, 0.5, 0.5, 0.9]), None if k % 17 == 0 else (h - (1 << 64) if h >> 63 else h), k % 13 != 0))
    if d in (0, 1, 3) or d == 10 and edges:
        monkeypatch.setattr(dedup, "SMALL", 10)  # the banded join, or blocks where bands would be narrow
        monkeypatch.setattr(dedup, "BLOCK", 25)
    got = {r.rel_path: r.duplicate_of for r in dedup.greedy_leaders(spark.createDataFrame(rows, IMAGE), d).collect()}
    assert {k: v for k, v in got.items() if v} == (leaders(rows, d) if d >= 0 else {})
    assert len(got) == len(rows)


def test_row_numbers_of_many_rows(spark, monkeypatch):
    from gleanframe.operators import ordering

    rows = [(k * 7919 % 1009, f"r{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "x long, name string").repartition(5)
    want = {name: 3 + k for k, (_, name) in enumerate(sorted(rows))}
    for few in (50_000, 0):
        monkeypatch.setattr(ordering, "FEW", few)
        got = ordering.with_row_number(df, ["x"], "n", 3)
        assert got.columns == ["x", "name", "n"] and {r.name: r.n for r in got.collect()} == want
    assert ordering.with_row_number(df.limit(0), ["x"], "n").count() == 0


def test_leaders_read_in_order(spark):
    rng = random.Random(8)
    rows = [(k, f"p{k}", rng.choice([0.1, 0.5]), None if k % 17 == 0 else rng.getrandbits(12) << 50, k % 13 != 0) for k in range(150)]
    rows = [(a, b, c, h and (h - (1 << 64) if h >> 63 else h), e) for a, b, c, h, e in rows]
    got = {r.rel_path: r.duplicate_of for r in dedup.greedy_leaders(spark.createDataFrame(rows, IMAGE), 2).collect()}
    assert {k: v for k, v in got.items() if v} == leaders(rows, 2) and len(got) == 150


def test_groups_are_numbered_by_first_appearance(spark):
    rows = spark.createDataFrame([(0, "a", "c", True), (1, "b", None, False), (2, "c", None, False)], "ord long, rel_path string, duplicate_of string, is_duplicate boolean")
    got = {r.rel_path: (r.similar_group, r.group_size, r.is_representative) for r in dedup.with_groups(rows).collect()}
    assert got == {"a": (1, 2, False), "c": (1, 2, True), "b": (2, 1, True)}


@pytest.mark.parametrize("weight", [0.0, 0.4, 1.0])
def test_diverse_picks(spark, weight):
    rng = random.Random(2)
    rows = [(k, f"p{k}", rng.choice([0.2, 0.4, 0.9]), None if k % 9 == 0 else rng.choice([0, 1, 255, -1, 4096, rng.getrandbits(60)]), True) for k in range(40)]
    top, left, picked, out = max(r[2] for r in rows), list(range(40)), [], []
    for _ in range(10):
        def value(k):
            h = rows[k][3]
            near = 1.0 if not picked or h is None else min(bin((h ^ x) & (1 << 64) - 1).count("1") for x in picked) / 64.0
            return rows[k][2] / top * (1.0 - weight) + near * weight
        best = max(left, key=lambda k: (value(k), -k))
        left.remove(best)
        out.append(best)
        if rows[best][3] is not None:
            picked.append(rows[best][3])
    got = selection.diverse_picks(spark.createDataFrame(rows, IMAGE), 10, weight).orderBy("pick_no").collect()
    assert [r.ord for r in got] == out


def test_destinations(spark):
    import hashlib

    def sha(p):
        return hashlib.sha1(p.encode()).hexdigest()

    def plan(paths):
        return {r.rel_path: r.dest for r in export.destinations(spark.createDataFrame([(p,) for p in paths], "rel_path string"), True).collect()}

    assert plan(["a/IMG.png", "b/img.png"]) == {"a/IMG.png": f"IMG-{sha('a/IMG.png')[:8]}.png", "b/img.png": f"img-{sha('b/img.png')[:8]}.png"}
    taken = f"old/img-{sha('a/img.png')[:8]}.png"
    got = plan(["a/img.png", "b/img.png", taken])
    assert got[taken] == taken[4:] and got["a/img.png"] == f"img-{sha('a/img.png')[:16]}.png"
    assert plan(["x/straße.png", "y/STRASSE.png"])["x/straße.png"].startswith("straße-")


def test_gate_reasons(spark):
    rows = spark.createDataFrame(
        [(0, "a", 0.9, True, None, False, None, "face_1", "frontal"), (1, "b", 0.1, False, "blurry (x)", False, None, None, None), (2, "c", 0.9, True, None, True, "a", "face_1", "frontal"),
         (3, "d", 0.9, True, None, False, None, None, "frontal"), (4, "e", 0.9, True, None, False, None, "face_1", None)],
        "ord long, rel_path string, score double, passed boolean, reject_reason string, is_duplicate boolean, duplicate_of string, primary_face_cluster string, primary_face_pose string")

    def reasons(**k):
        return [r.keep_reason for r in selection.decide(rows, ExportRequest(**k), 0.4).orderBy("ord").collect()]

    assert reasons(face_clusters=("face_1",), face_poses=("frontal",)) == ["", "below-score", "similar-to:a", "face-cluster-excluded", "face-pose-excluded"]
    assert reasons(min_score=0.0) == ["", "blurry (x)", "similar-to:a", "", ""]
    assert reasons(min_score=0.0, include_rejected=True, keep_similar=True) == [""] * 5
    assert reasons(selection=()) == ["not-selected"] * 5
    with pytest.raises(ValueError):
        ExportRequest(max_keep=-1)
    with pytest.raises(PermissionError):
        ExportRequest(mode="move")


def mean_linkage(x, eps):
    """Labels of clusters as lists of members, whose mean distance is taken anew over all pairs before each merge."""
    d = 1.0 - x @ x.T
    clusters = [[k] for k in range(len(x))]
    while len(clusters) > 1:
        mean, a, b = min((np.mean([d[i, j] for i in p for j in q]), a, b) for a, p in enumerate(clusters) for b, q in enumerate(clusters) if a < b)
        if not mean < eps:
            break
        clusters[a] = clusters[a] + clusters.pop(b)
    label = {k: min(c) for c in clusters for k in c}
    return [label[k] for k in range(len(x))]


def nearest_leaders(x, eps):
    leaders, out = [], []
    for k in range(len(x)):
        near = [(1.0 - float(x[j] @ x[k]), j) for j in leaders]
        d, j = min(near, default=(9.0, -1))
        if d >= eps:
            leaders.append(k)
            j = k
        out.append(j)
    return out


def test_identities(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16))
    vectors = [(centres[k % 4] + 0.3 * rng.normal(size=16)).tolist() for k in range(40)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "face_id long, embedding array<double>")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for method, f in (("average", mean_linkage), ("leaders", nearest_leaders)):
        got = {r.face_id: r.label for r in faces.identities(df, 0.4, method).collect()}
        assert [got[k] for k in range(40)] == f(x, 0.4)
    for eps in (0.1, 0.6, 0.9, 1.1):
        x = rng.normal(size=(60, 5))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert faces.average_linkage(x, eps).tolist() == mean_linkage(x, eps)
    assert faces.identities(df.limit(0), 0.4).count() == 0


def test_average_linkage_of_many_faces(monkeypatch):
    """Beyond SMALL faces the labels are the same, and no matrix of all pairs is held."""
    rng = np.random.default_rng(2)
    cases = []
    for k, spread in enumerate((0.05, 0.3, 1.0)):
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, 60)] + spread * rng.normal(size=(60, 6))
        cases.append(x if k else x[rng.integers(0, 60, 60)])  # with copies
    centres = rng.normal(size=(40, 16))
    many = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (*cases, many)]
    for x in unit[:-1]:
        for eps in (0.1, 0.6, 0.9, 1.1):
            assert faces.linkage_of_means(x, eps).tolist() == mean_linkage(x, eps)
    tracemalloc.start()
    got = faces.average_linkage(unit[-1], 0.6).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 / 4
    monkeypatch.setattr(faces, "SMALL", 3000)
    assert got == faces.average_linkage(unit[-1], 0.6).tolist()
    one = np.array([[1.0, 0.0], [1e-12, 0.0], [1e-12, 0.0]])
    assert faces.linkage_of_means(one[:1], 0.6).tolist() == [0] and faces.linkage_of_means(one, 0.6).tolist() == [0, 1, 2]
    assert faces.linkage_of_means(np.zeros((0, 3)), 0.6).tolist() == []


def test_pose_and_reject_key(spark):
    df = spark.createDataFrame([(0.0, None), (15.0, ""), (-15.0, "blurry (sharpness=1)"), (30.0, "aspect ratio 4 > 3"), (-45.0, "x"), (60.0, "y"), (None, "z")], "yaw double, reason string")
    got = df.select(scoring.pose_bucket(F.col("yaw"), FaceConfig()), scoring.reject_key(F.col("reason"))).collect()
    assert [r[0] for r in got] == ["frontal", "frontal", "frontal", "three_quarter", "three_quarter", "profile", None]
    assert [r[1] for r in got][:4] == ["unknown", "unknown", "blurry", "aspect ratio 4 > 3"]


def test_folder_scan_and_export(spark, tmp_path):
    root = tmp_path / "in"
    first = noise(1)
    twin = first.copy()
    twin[0, 0] = 0
    flat = np.full((768, 768, 3), 120, np.uint8)
    for rel, px in (("personA/s1/img.png", first), ("personA/s1/dup.png", twin), ("personA/s2/img.png", noise(2)), ("personB/blurry.png", flat), ("personB/tiny.png", noise(4, 128))):
        png(root / rel, px)
    (root / "broken.png").write_bytes(b"no image")
    (root / "notes.txt").write_text("no image either")
    results = plans.scan_folder(spark, str(root)).persist()
    counts = summary.counts(results).first()
    assert (counts.total, counts.passed, counts.rejected, counts.duplicates) == (6, 3, 3, 1)
    assert dedup.multi_member_groups(results).first()[0] == 1
    tally = {r.reason: r.n for r in summary.reject_tally(results).collect()}
    assert [r.phash for r in results.orderBy("ord").collect()][0] == "" and all(len(r.phash) == 16 and r.faces == [] for r in results.where("hash is not null").collect())
    assert tally == {"blurry": 1, "resolution too low": 1, "cannot open: unreadable image": 1}
    assert [r.rel_path for r in results.orderBy("ord").collect()][:3] == ["broken.png", "personA/s1/dup.png", "personA/s1/img.png"]
    assert {r.folder: r.n for r in images.browse(results).collect()} == {"": 1, "personA": 3, "personB": 2}

    decided = plans.export_plan(results, ExportRequest(min_score=0.0)).persist()
    chosen = decided.where("keep_reason = ''")
    moves = export.destinations(chosen, True)
    done = export.transfer(chosen.join(moves, "rel_path"), str(tmp_path / "out"), "copy")
    assert len(done) == 2 and all(e == "" for _, _, e in done)
    exported = spark.createDataFrame([(a, b) for a, b, _ in done], "rel_path string, dest string")
    lines = [r.value for r in export.manifest_lines(export.manifest(decided, exported, TargetProfile(), str(tmp_path / "out"))).collect()]
    assert len(lines) == 2 and all('"primary_face_cluster":null' in x for x in lines)
    export.write_report(export.report(decided, exported), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().count("\n") == 7
    assert export.export_result(decided, exported).first().exported == 2

    store = ScanStore(spark, str(tmp_path / "store"))
    store.save("one/two", results)
    store.save("other", results.limit(1))
    assert store.scan_ids() == ["one_two", "other"] and store.load("none") is None
    assert [r.ord for r in store.load_page("one/two", 4, 5).collect()] == [4, 5] and store.load_page("one/two", 9).count() == 0
    assert store.delete("other") and not store.delete("other") and store.load("one/two").count() == 6
    with pytest.raises(NotADirectoryError):
        images.collect_images(spark, str(tmp_path / "missing"))
    assert plans.scan(results.limit(0).select("ord", "rel_path", "width", "height", "sharpness", "artifact_score", "hash")).count() == 0


def test_faces_change_scores(spark):
    metrics = spark.createDataFrame([(k, f"p{k}", 1024, 1024, 800.0, 1.0, k << 20) for k in range(3)], "ord long, rel_path string, width int, height int, sharpness double, artifact_score double, hash long")
    box = [(0, "p0", 0.0, 0.0, 10.0, 10.0, 0.9, 0.0, 0.0, [1.0, 0.0]), (1, "p1", 0.0, 0.0, 9.0, 9.0, 0.9, 60.0, 0.0, [0.99, 0.01]), (2, "p1", 0.0, 0.0, 5.0, 5.0, 0.9, 0.0, 0.0, [0.0, 1.0])]
    found = spark.createDataFrame(box, "face_id long, rel_path string, x1 double, y1 double, x2 double, y2 double, det_score double, yaw double, pitch double, embedding array<double>")
    got = {r.rel_path: r for r in plans.scan(metrics, cfg=ScanConfig(cluster_distance=-1), face_cfg=FaceConfig(enabled=True), detections=found).collect()}
    assert (got["p0"].score, got["p1"].score, got["p2"].score) == (1.0, 0.4240, 0.515)
    assert (got["p1"].primary_face_pose, got["p1"].primary_face_cluster, got["p1"].face_count) == ("profile", "face_1", 2)


def test_stream_scores_arrivals(spark, tmp_path):
    from gleanframe.sources import adapter
    from gleanframe.streaming.arrivals import scored_stream

    rows = adapter.metrics(spark, "/root/testdata/sf0.001").drop("embedding")
    rows.write.parquet(str(tmp_path / "in"))
    stream = scored_stream(spark, str(tmp_path / "in"), rows.schema)
    stream.select("ord", "score").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    batch = scoring.with_score(scoring.with_gates(rows, ScanConfig()), TargetProfile(), ScanConfig(), True)
    assert sorted(spark.table("arrived").collect()) == sorted(batch.select("ord", "score").collect())


def test_command_line(spark, tmp_path, capsys):
    import json

    from gleanframe import api, cli

    for rel, seed in (("a/x.png", 1), ("b/x.png", 2)):
        png(tmp_path / "in" / rel, noise(seed))
    assert cli.main([str(tmp_path / "in"), "--min-score", "0", "--flatten", "--copy-to", str(tmp_path / "out")], spark) == 0
    text = capsys.readouterr().out
    assert '"passed": 2' in text and '"exported": 2' in text
    lines = [json.loads(x) for x in (tmp_path / "out/manifest.jsonl").read_text().splitlines()]
    assert [x["rel_path"] for x in lines] == ["a/x.png", "b/x.png"] and all((tmp_path / "out" / x["exported_path"]).is_file() for x in lines)

    calls = []
    scan = api.scan_folder(spark, str(tmp_path / "in"), progress=lambda *x: calls.append(x) or 1 / 0)
    assert calls and scan.page(1, 5)["returned"] == 1
    moved = api.export_selection(scan, ExportRequest(min_score=0.0, mode="move", allow_move=True), "gone", root=str(tmp_path))
    assert moved["exported"] == 2 and not (tmp_path / "in/a/x.png").exists()
    assert json.loads((tmp_path / "gone/manifest.jsonl").read_text().splitlines()[0])["abs_path"] == str(tmp_path / "gone/a/x.png")
    again = api.export_selection(scan, ExportRequest(min_score=0.0), "copy", root=str(tmp_path))
    assert (again["exported"], again["skipped"]) == (0, 2)
    with pytest.raises(PermissionError):
        api.export_selection(scan, ExportRequest(), "../out", root=str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        api.export_selection(scan, ExportRequest(min_score=0.0), "copy", root=str(tmp_path), progress=lambda *x: 1 / 0)


def test_manifest_is_in_pick_order(spark, tmp_path):
    import json

    from gleanframe import api

    rng = random.Random(3)
    metrics = [(k, f"p{k}.png", f"/nowhere/p{k}.png", 1024, 1024 - k, 300.0 + 10 * k, 0.9, rng.getrandbits(62)) for k in range(12)]
    rows = spark.createDataFrame(metrics, "ord long, rel_path string, abs_path string, width int, height int, sharpness double, artifact_score double, hash long")
    for weight in (0.4, 0.0):
        scan = api.scan_metrics(rows, config=ScanConfig(cluster_distance=-1, diversity_weight=weight))
        decided = plans.export_plan(scan.results, ExportRequest(min_score=0.0, max_keep=5), scan.config).persist()
        eligible = scan.results.collect()
        if weight:
            want = [metrics[r.ord][1] for r in selection.diverse_picks(scan.results, 5, weight).orderBy("pick_no").collect()]
        else:
            want = [r.rel_path for r in sorted(eligible, key=lambda r: (-r.score, r.ord))[:5]]
        exported = decided.where("keep_reason = ''").select("rel_path", F.col("rel_path").alias("dest"))
        got = [json.loads(r.value)["rel_path"] for r in export.manifest_lines(export.manifest(decided, exported, TargetProfile(), "/out")).collect()]
        assert got == want != sorted(want)
        assert [r.rel_path for r in export.selected_paths(decided).orderBy("place").collect()] == sorted(want)
    # files are absent: all are skipped, and no manifest is written if none is wanted
    calls = []
    result = api.export_selection(scan, ExportRequest(min_score=0.0, max_keep=5, write_manifest=False), str(tmp_path / "out"), progress=lambda *x: calls.append(x))
    assert (result["copied"], result["skipped"], result["manifest_path"], result["mode"]) == (0, 5, None, "copy") and result["selected_rel_paths"] == sorted(want)
    assert calls[0] == ("transferring", 0, 5) and calls[-1] == ("transferring", 5, 5) and not (tmp_path / "out").exists()


def test_artifact_score_of_thin_images():
    from gleanframe.functions import kernels

    rng = np.random.default_rng(4)
    for h, w in ((12, 600), (600, 12), (40, 50), (10, 9), (17, 16)):
        x = rng.integers(0, 255, (h, w)).astype(np.float32)
        across = np.mean([abs(x[k] - x[k - 1]).mean() for k in range(8, h, 8)]) if h > 16 else 0.0
        down = np.mean([abs(x[:, k] - x[:, k - 1]).mean() for k in range(8, w, 8)]) if w > 16 else 0.0
        inside = (abs(np.diff(x, axis=0)).mean() + abs(np.diff(x, axis=1)).mean()) / 2
        want = min(1.0, max(0.0, 1 - ((across + down) / 2 / inside - 1) / 0.6))
        assert abs(kernels.artifact_score(x.astype(np.uint8)) - want) < 1e-4, (h, w)
    assert kernels.artifact_score(np.full((50, 50), 7, np.uint8)) == 1.0


def test_hidden_files_and_images_in_memory(spark, tmp_path):
    from gleanframe import api
    from gleanframe.functions import decoding

    root = tmp_path / "in"
    for k, rel in enumerate(("a.png", "_b.png", ".c.png", ".h/d.png", "x/_y/e.png", ".png")):
        png(root / rel, noise(k, 600))
    (root / "_broken.jpg").write_bytes(b"no image")
    want = [".c.png", ".h/d.png", "_b.png", "_broken.jpg", "a.png", "x/_y/e.png"]
    files = images.collect_images(spark, str(root)).orderBy("ord").collect()
    assert [r.rel_path for r in files] == want and all(r.abs_path == f"{root}/{r.rel_path}" for r in files)
    calls = []
    scan = api.scan_folder(spark, str(root), progress=lambda *x: calls.append(x))
    got = {r.rel_path: r for r in scan.results.collect()}
    assert sum(r.passed for r in got.values()) == 5 and got["_broken.jpg"].reject_reason.startswith("cannot open")
    assert list(dict.fromkeys(c[0] for c in calls)) == ["collecting", "scoring", "clustering"] and calls[-1] == ("clustering", 6, 6)
    assert {("collecting", 6, 6), ("scoring", 0, 6), ("scoring", 6, 6), ("clustering", 0, 6)} <= set(calls)
    assert (decoding.decode((root / "_b.png").read_bytes())[..., ::-1] == noise(1, 600)).all()

    rows = [(p, f"/m/{p}", (root / p).read_bytes()) for p in reversed(want)]
    again = api.scan_items(spark.createDataFrame(rows, "rel_path string, abs_path string, content binary"))
    same = ("ord", "rel_path", "score", "phash", "passed", "sharpness", "artifact_score", "width", "similar_group")
    assert sorted(tuple(r[c] for c in same) for r in again.results.collect()) == sorted(tuple(r[c] for c in same) for r in got.values())
    assert api.scan_items(spark.createDataFrame([], "rel_path string, abs_path string, content binary")).summary()["total"] == 0


def test_png_lines_of_every_filter():
    from gleanframe.functions import decoding

    rng = np.random.default_rng(6)
    for samples in (1, 3, 4):
        pixels = rng.integers(0, 255, (10, 7, samples), np.uint8)
        lines, above = b"", np.zeros(7 * samples, np.int64)
        for y in range(10):
            line = pixels[y].ravel().astype(np.int64)
            left = np.concatenate((np.zeros(samples, np.int64), line[:-samples]))
            corner = np.concatenate((np.zeros(samples, np.int64), above[:-samples]))
            guess = left + above - corner
            a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
            kind = y % 5
            lines += bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
            above = line

        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        colour = {1: 0, 3: 2, 4: 6}[samples]
        content = decoding.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        assert (decoding.decode(content) == pixels[..., :3][..., ::-1]).all()
    assert decoding.decode(b"") is None and decoding.decode(content[:60]) is None


def test_detectors_are_plugged_in(spark, tmp_path, capsys):
    import json

    from gleanframe import api, cli
    from gleanframe.operators import detection

    for rel, seed in (("a.png", 1), ("b.png", 2), ("c.png", 3)):
        png(tmp_path / "in" / rel, noise(seed, 600))

    def detector(pixels):
        first = int(pixels[0, 0, 0])
        if first == int(noise(3, 600)[0, 0, 2]):
            raise RuntimeError("no model")
        face = {"bbox": (10, 10, 110.04, 90), "det_score": 0.91234567, "embedding": [1.0, 0.0], "pose": (1.0, 20.0, 3.0)}
        return [face, face | {"bbox": (0, 0, 5, 5), "det_score": 0.2}] if first == int(noise(1, 600)[0, 0, 2]) else [face | {"embedding": [0.99, 0.1], "pose": None}]

    scan = api.scan_folder(spark, str(tmp_path / "in"), face_config=FaceConfig(enabled=True), detector=detector)
    got = {r.rel_path: r for r in scan.results.collect()}
    assert [got[p].face_count for p in ("a.png", "b.png", "c.png")] == [1, 1, 0]
    assert got["a.png"].faces[0].asDict() == {"bbox": [10.0, 10.0, 100.0, 80.0], "det_score": 0.9123, "cluster_id": "face_1", "primary": True, "yaw": 20.0, "pitch": 1.0, "pose": "three_quarter"}
    assert got["b.png"].faces[0].pose is None and got["c.png"].faces == []
    about = scan.summary()
    assert about["face_clusters"] == [{"cluster_id": "face_1", "size": 2, "representative_rel_path": "a.png", "representative_bbox": [10.0, 10.0, 100.0, 80.0]}]
    assert about["faces_config"]["enabled"] and detection.pose_of([1, 2]) == (None, None)
    assert detection.providers("auto", []) == ["CPUExecutionProvider"] and detection.providers("cuda", [])[0].startswith("CUDA")
    if not detection.available()["insightface"]:
        with pytest.raises(ImportError):
            api.scan_folder(spark, str(tmp_path / "in"), face_config=FaceConfig(enabled=True))
    assert cli.main(["detectors"]) == 0 and "insightface" in capsys.readouterr().out

    # stored scans have their summary: totals stay whatever the page
    store = ScanStore(spark, str(tmp_path / "store"))
    api.save(store, scan)
    page = store.page_with_totals(scan.scan_id, 1, 1)
    assert (page["total"], page["returned"], page["offset"], page["limit"], page["results"][0]["rel_path"]) == (3, 1, 1, 1, "b.png")
    assert page["results"] == scan.page(1, 1)["results"] and page["config"]["weight_subject"] == 0.2
    assert store.page_with_totals(scan.scan_id, 9)["returned"] == 0 and store.page_with_totals("none") is None
    assert store.scan_ids() == [scan.scan_id] and api.load(store, scan.scan_id).summary() == about
    request = ExportRequest(scan_id=scan.scan_id)
    assert api.check_export(store, request, str(tmp_path), str(tmp_path), "out")["total"] == 3
    for error, bad in ((ValueError, dict(request=ExportRequest(selection=("a.png",)))), (LookupError, dict(request=ExportRequest(scan_id="x"))), (PermissionError, dict(source_root=str(tmp_path / "other"))),
                       (PermissionError, dict(request=ExportRequest(scan_id=scan.scan_id, mode="move", allow_move=True))), (ValueError, dict(export_root=None)), (PermissionError, dict(destination="../out"))):
        with pytest.raises(error):
            api.check_export(store, **({"request": request, "source_root": str(tmp_path), "export_root": str(tmp_path), "destination": "out"} | bad))

    assert cli.main([str(tmp_path / "in"), "--faces", "--no-cluster", "--face-clusters", "face_1", "--min-score", "0", "--csv", str(tmp_path / "r.csv"), "--json", str(tmp_path / "s.json"), "--store", str(tmp_path / "kept"), "-v", "--copy-to", str(tmp_path / "out")], spark, detector) == 0
    assert (tmp_path / "r.csv").read_text().count("\n") == 4 and len(json.loads((tmp_path / "s.json").read_text())["results"]) == 3
    assert '"exported": 2' in capsys.readouterr().out and len(ScanStore(spark, str(tmp_path / "kept")).scan_ids()) == 1


def test_browse_a_folder(tmp_path):
    for rel in ("top.png", "B/x.png", "B/sub/y.jpg", "B/.hid/z.webp", "a/notes.txt", ".dot/q.png"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(b"")
    got = images.browse_folder(str(tmp_path))
    assert (got["parent"], got["direct_image_count"]) == (None, 1)
    assert [(f["name"], f["image_count"], f["subfolder_count"]) for f in got["folders"]] == [("a", 0, 0), ("B", 3, 1)]
    below = images.browse_folder(str(tmp_path), "B/sub")
    assert (below["parent"], below["direct_image_count"], below["folders"]) == ("B", 1, []) and images.browse_folder(str(tmp_path), "B")["parent"] == ""
    with pytest.raises(PermissionError):
        images.browse_folder(str(tmp_path), "../x")
    with pytest.raises(NotADirectoryError):
        images.browse_folder(str(tmp_path), "top.png")


def test_wire_schema(spark, tmp_path):
    import os

    from gleanframe import api, cli, wire
    from gleanframe.sources import adapter

    golden = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), cli.SCHEMA_PATH)
    assert not wire.is_stale(golden) and cli.main(["schema", "--check", "--output", golden]) == 0
    assert cli.main(["schema", "--output", str(tmp_path / "s.json")]) == 0 and not wire.is_stale(str(tmp_path / "s.json"))
    (tmp_path / "s.json").write_text("{}")
    assert cli.main(["schema", "--check", "--output", str(tmp_path / "s.json")]) == 1 and wire.is_stale(str(tmp_path / "none.json"))
    defs = wire.schema()["$defs"]
    assert {"ScanRequest", "ScanSummary", "ExportRequest", "ExportResult", "ManifestRow"} <= set(defs)
    # what a scan's page holds is what the schema says
    page = api.scan_metrics(adapter.metrics(spark, "/root/testdata/sf0.001").drop("embedding", "face_count", "yaw").limit(5)).page(0, 2)
    assert set(defs["ScanSummary"]["properties"]) == set(page)
    assert set(defs["ImageResult"]["properties"]) <= set(page["results"][0])


def test_service(spark, tmp_path):
    import http.server
    import threading

    from gleanframe import api, service
    from gleanframe.functions import decoding

    def work(progress):
        progress("scoring", 1, 2)
        return {"total": 2}

    assert list(service.events(work)) == [("progress", {"phase": "scoring", "done": 1, "total": 2}), ("complete", {"total": 2})]
    assert list(service.event_frames(lambda p: 1 / 0))[0].startswith('event: error\ndata: {"detail": "ZeroDivisionError')
    calls = []
    with service.watched(spark, lambda *x: calls.append(x), "scoring", 1000, 0.01):
        spark.range(0, 4000, 1, 16).selectExpr("sum(hash(id))").collect()
    done = [c[1] for c in calls]
    assert done == sorted(done) and (done[0], done[-1]) == (0, 1000) and len(calls) <= service.TICKS + 2

    up = service.save_uploads(str(tmp_path), "new/in", [("a/b.png", b"1"), ("b.png", b"2"), ("x.txt", b"3"), ("", b"4"), (".png", b"5")])
    assert (up["folder"], up["saved"], up["skipped"], len(up["errors"])) == ("new/in", 1, ["b.png", "x.txt", ".png"], 1)
    assert (tmp_path / "new/in/b.png").read_bytes() == b"1"
    with pytest.raises(PermissionError):
        service.save_uploads(str(tmp_path), "../out", [])

    png(tmp_path / "wide.png", noise(3, 500)[:100])
    (tmp_path / "bad.png").write_bytes(b"no image")
    small = {r.rel_path: r for r in service.thumbnails(images.read_pixels(spark, str(tmp_path)).where("not startswith(rel_path, 'new')")).collect()}
    assert small["bad.png"].content is None
    if small["wide.png"].media_type == "image/png":
        assert decoding.decode(bytes(small["wide.png"].content)).shape == (77, 384, 3)
    x = noise(5, 60)
    assert (decoding.fitted(x, 30) == np.rint(x.reshape(30, 2, 30, 2, 3).mean(axis=(1, 3)))).all() and decoding.fitted(x, 100).shape == x.shape
    assert (decoding.decode(decoding._as_png(x)) == x[..., ::-1]).all()

    got = []

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(204 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    png(tmp_path / "in/a.png", noise(1, 600))
    scan = api.scan_folder(spark, str(tmp_path / "in"))
    for path, taken in (("/ok", True), ("/bad", False)):
        result = api.export_selection(scan, ExportRequest(min_score=0.0, caption_url=url + path), str(tmp_path / "out"))
        assert result["captioned"] is taken and result["copied"] == 1 and b'"rel_path":"a.png"' in got[-1]
    server.shutdown()
    assert not service.post_manifest(str(tmp_path / "out/manifest.jsonl"), url) and not service.post_manifest("/no/such", url)
    assert api.health()["status"] == "ok"
