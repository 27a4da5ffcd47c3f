"""What a web service around the engine needs, without the web: events of a running scan, uploads, thumbnails, and the
hand-over of a manifest."""

from __future__ import annotations

import json
import os
import queue
import threading
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .config import IMAGE_SUFFIXES
from .functions import decoding
from .sources.images import within

THUMB_SIDE = 384  # fixed value: the longest side of a thumbnail
POST_SECONDS = 30.0  # fixed value: how long a manifest's receiver may take
TICKS = 100  # progress is told so often at most


def events(work: Callable[[Callable[[str, int, int], None]], dict]) -> Iterator[tuple[str, dict]]:
    """("progress", {phase, done, total}) while work(progress) runs in a thread of its own, then one ("complete", its result)
    or one ("error", {detail})."""
    waiting: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            result = work(lambda phase, done, total: waiting.put(("progress", {"phase": phase, "done": done, "total": total})))
            waiting.put(("complete", result))
        except Exception as e:  # noqa: BLE001  the listener is told, whatever it was
            waiting.put(("error", {"detail": f"{type(e).__name__}: {e}"}))

    threading.Thread(target=run, name="gleanframe-events", daemon=True).start()
    while True:
        kind, payload = waiting.get()
        yield kind, payload
        if kind != "progress":
            return


def event_frames(work: Callable[[Callable[[str, int, int], None]], dict]) -> Iterator[str]:
    """The same as frames of a text/event-stream."""
    for kind, payload in events(work):
        yield f"event: {kind}\ndata: {json.dumps(payload)}\n\n"


@contextmanager
def watched(spark: SparkSession, tell: Callable[[str, int, int], None], phase: str, total: int, seconds: float = 0.2) -> Iterator[None]:
    """While the block runs jobs, tells how much of total is done, by the share of its running tasks that have ended.

    Spark reports tasks, not rows, so done is an estimate; it never falls, and is told TICKS times at most.
    """
    tracker, group = spark.sparkContext.statusTracker(), f"gleanframe-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, phase)
    over, most = threading.Event(), 0

    def poll() -> None:
        nonlocal most
        while not over.wait(seconds):
            found = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
            tasks = sum(s.numTasks for s in found if s)
            done = total * sum(s.numCompletedTasks for s in found if s) // tasks if tasks else 0
            if done >= most + max(1, total // TICKS) and done < total:
                most = done
                tell(phase, done, total)

    watcher = threading.Thread(target=poll, name="gleanframe-progress", daemon=True)
    tell(phase, 0, total)
    watcher.start()
    try:
        yield
        over.set()
        watcher.join()
        tell(phase, total, total)
    finally:
        over.set()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def save_uploads(root: str, folder: str, files: Iterable[tuple[str, bytes]]) -> dict:
    """Saves images (name, content) into a folder below root. Of a name only its last part counts; other files than images
    and names that are there already are skipped, and nothing is overwritten."""
    target = within(root, folder)
    os.makedirs(target, exist_ok=True)
    saved, skipped, errors = 0, [], []
    for given, content in files:
        name = os.path.basename((given or "").rstrip("/"))
        stem, suffix = os.path.splitext(name)
        if not name:
            errors.append({"name": given or "", "detail": "missing filename"})
        elif not stem or suffix.lower() not in IMAGE_SUFFIXES:
            skipped.append(name)
        else:
            try:
                with open(os.path.join(target, name), "xb") as f:
                    f.write(content)
                saved += 1
            except FileExistsError:
                skipped.append(name)
            except OSError as e:
                errors.append({"name": name, "detail": f"cannot save: {e}"})
    inside = os.path.relpath(target, os.path.realpath(root))
    return {"folder": "" if inside == "." else inside, "saved": saved, "skipped": skipped, "errors": errors}


def post_manifest(path: str, url: str, seconds: float = POST_SECONDS) -> bool:
    """Sends a manifest as the file of a form; whether it was taken. A receiver that fails doesn't undo an export."""
    mark = uuid.uuid4().hex
    try:
        with open(path, "rb") as f:
            head = f'--{mark}\r\nContent-Disposition: form-data; name="manifest"; filename="{os.path.basename(path)}"\r\nContent-Type: application/x-ndjson\r\n\r\n'
            body = head.encode() + f.read() + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(url, body, {"Content-Type": f"multipart/form-data; boundary={mark}"}, method="POST")
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return 200 <= answer.status < 300
    except (OSError, ValueError):
        return False


def thumbnails(pixels: DataFrame, side: int = THUMB_SIDE) -> DataFrame:
    """pixels(rel_path, width, height, channels, data) to (rel_path, content, media_type): images that fit a square of `side`.

    WebP where Pillow is installed, else PNG; content is null of what can't be decoded.
    """
    import numpy as np

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for rel, w, h, channels, data in part[["rel_path", "width", "height", "channels", "data"]].itertuples(index=False):
                small = None if data is None else decoding.fitted(np.frombuffer(data, np.uint8).reshape(h, w, channels), side)
                content, kind = decoding.encoded(small) if small is not None else (None, None)
                rows.append((rel, content, kind))
            yield pd.DataFrame(rows, columns=["rel_path", "content", "media_type"])

    return pixels.mapInPandas(run, "rel_path string, content binary, media_type string")
