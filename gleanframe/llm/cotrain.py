"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view has shares and ratios of a text's characters, words and lines but not its length,
which is metadata (n_chars); so the views have no input in common.

Null texts count as empty; null metadata, columns that aren't there and numbers that aren't finite
are values of their own; an empty table gives an empty result. A null id is never learnt from. With
labels of one class only, scores are the prior. Very long texts are read whole, one at a time.
Repeated rows are scored each and alike; of equally sure rows a hash of the id decides which are
taught first. Further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidily

#: Labelled documents that the classifiers learn from at most, chosen by a hash of their ids. All unlabelled ones take part.
MAX_LABELLED = 20_000
ROUNDS = 5
#: Share of the unlabelled pool that a view may label in a round, and how sure it must be.
STEP_SHARE = 0.05
SURE = 0.95
#: Sureness is counted in steps of 1/64 nat, from SURE to the bound of a logit.
FINE = 64
LEAST_LOGIT = math.log(SURE / (1 - SURE))
STEPS = int((30 - LEAST_LOGIT) * FINE) + 1
PSEUDO_WEIGHT = 0.5
SLOTS = 128

_KINDS = np.zeros(0x250, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 common mark, 7 sign
for _c in range(0x250):
    _s = chr(_c)
    _KINDS[_c] = 5 if _s == "\n" else 4 if _s.isspace() else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 6 if _s in ".,;:!?'\"()-" else 7 if _c < 128 else 0


def text_features(text: str) -> list[float]:
    """Shape of a whole text; all shares lie in 0 to 1."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(cps))
    kinds = _KINDS[np.minimum(cps, 0x24F)]
    kinds[cps >= 0x250] = 0
    shares = (np.bincount(kinds, minlength=8) / n).tolist()
    same = cps[1:] == cps[:-1] if len(cps) > 1 else np.zeros(0, bool)
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ln = max(1, len(lines))
    pairs = w - 1
    stutter = sum(a == b for a, b in zip(words, words[1:])) / max(1, pairs)
    return [
        *shares, float((same & (kinds[1:] >= 6)).sum()) / n, float((same & (kinds[1:] < 4)).sum()) / n, stutter,
        len(counts) / w, max(counts.values(), default=0) / w, min(1.0, sum(map(len, words)) / w / 20), len(set(lines)) / ln, max(Counter(lines).values(), default=0) / ln,
        sum(x.isalpha() for x in counts) / max(1, len(counts)), sum(x.isupper() and len(x) > 1 for x in counts) / max(1, len(counts)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / ln, math.log1p(w / ln) / 12, float(not words),
    ]


def meta_slots(values: list) -> list[int]:
    """The slot of each value of a metadata row: texts and their null by hash, numbers by their binary order of magnitude."""

    def sign(v) -> str:
        if v is None or isinstance(v, str):
            return "null" if v is None else v
        v = float(v)
        return f"2^{int(math.log2(1 + abs(v)))}" if math.isfinite(v) else str(v)

    keys = (f"{k}={sign(v)}" for k, v in enumerate(values))
    return [zlib.crc32(key.encode()) % SLOTS for key in keys]


def meta_features(slots: list[int] | np.ndarray) -> np.ndarray:
    """Counts in the slots."""
    return np.bincount(np.array(slots, np.int64), minlength=SLOTS).astype(float)


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> Logistic:
    mean, scale = np.average(x, axis=0, weights=n), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate((np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)), axis=1)
    w = np.zeros(z.shape[1])
    pull = np.full(z.shape[1], ridge)
    pull[0] = 1e-3

    def loss(w):
        t = z @ w
        return (n * (np.logaddexp(0, t) - y * t)).sum() + (pull * w * w).sum() / 2

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (n * (p - y)) + pull * w)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if abs(step).max() < 1e-5:
            break
    return Logistic(mean, scale, w)


@dataclass(frozen=True)
class QualityModel:
    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(x)[:, None], self.meta.logit(m)[:, None]
        a, b = self.text_scale.logit(a), self.meta_scale.logit(b)
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, self.both.logit(np.stack((a, b), axis=1))))


class ArrayPool:
    """Unlabelled rows in memory; tie (0 to 1) orders rows that are equally sure."""

    def __init__(self, x: np.ndarray, m: np.ndarray, tie: np.ndarray | None = None):
        self.rows = x, m, np.arange(len(m)), np.random.default_rng(7).permutation(len(x)) / max(1, len(x)) if tie is None else tie
        self.size = len(x)

    def total(self, measure: Callable[..., np.ndarray]) -> np.ndarray:
        return measure(*self.rows)


class TablePool:
    """Unlabelled rows of a table (x, slots, tie). A pass adds up what its tasks measure; no row leaves the executors."""

    #: Tasks that add up before the driver does.
    ADDERS = 8

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width, self.size = rows, width, rows.count()

    def total(self, measure: Callable[..., np.ndarray]) -> np.ndarray:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    x, slots = ([bytes(v) for v in batch.column(k).to_pylist()] for k in (0, 1))
                    kinds = {v: k for k, v in enumerate(dict.fromkeys(slots))}
                    m = np.array([meta_features(np.frombuffer(v, "u1")) for v in kinds])
                    part = measure(np.frombuffer(b"".join(x), np.float32).reshape(-1, width).astype(float), m, np.array([kinds[v] for v in slots]), batch.column(2).to_numpy())
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["task", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # in the order of tasks, so that sums are the same in every run
            parts = sorted((t, bytes(v)) for batch in batches for t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]], pa.int32()), pa.array([sum(np.frombuffer(v) for _, v in parts).tobytes()], pa.binary())], ["task", "part"])

        schema = "task int, part binary"
        parts = self.rows.mapInArrow(tidily(run), schema).repartition(self.ADDERS).mapInArrow(add, schema).collect()
        return sum(np.frombuffer(bytes(v)) for _, v in sorted((r["task"], r["part"]) for r in parts))


#: The rows that a teacher labels 1 and 0 in a round: those above a step of sureness, and of that step those whose tie is below a share.
Bounds = tuple[tuple[int, float], tuple[int, float]]
Lesson = tuple[Logistic, Bounds]


def _steps(logit: np.ndarray) -> np.ndarray:
    """Steps of sureness, below zero where it is less than SURE."""
    return np.floor((logit - LEAST_LOGIT) * FINE).astype(np.int64)


def _told(lessons: list[tuple[Lesson, Lesson]], x: np.ndarray, m: np.ndarray, at: np.ndarray, tie: np.ndarray) -> list[np.ndarray]:
    """What the text view and the metadata view have been told of each row by each other: 1, 0 or -1 for nothing. What is told first stays."""
    out = [np.full(len(x), -1), np.full(len(x), -1)]
    for by_text, by_meta in lessons:
        for learner, (teacher, bounds), logit in ((1, by_text, by_text[0].logit(x)), (0, by_meta, by_meta[0].logit(m)[at])):
            for label, (step, share), sure in ((1, bounds[0], _steps(logit)), (0, bounds[1], _steps(-logit))):
                out[learner][(out[learner] < 0) & (sure >= 0) & ((sure > step) | ((sure == step) & (tie < share)))] = label
    return out


def _sureness(lessons, views: tuple[Logistic, Logistic], x, m, at, tie) -> np.ndarray:
    """For each teacher and label, the rows at each step that its learner hasn't been told of."""
    told, out = _told(lessons, x, m, at, tie), []
    for learner, logit in ((1, views[0].logit(x)), (0, views[1].logit(m)[at])):
        for sure in (_steps(logit), _steps(-logit)):
            out.append(np.bincount(sure[(told[learner] < 0) & (sure >= 0)], minlength=STEPS))
    return np.concatenate(out).astype(float)


def _by_view(lessons, x, m, at, tie) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, labels, counts) of what each view has been told; equal metadata rows count together."""
    told = _told(lessons, x, m, at, tie)
    own = told[0] >= 0
    counts = [np.bincount(at[told[1] == label], minlength=len(m)).astype(float) for label in (0, 1)]
    labels = np.repeat((0.0, 1.0), len(m))
    return [(x[own], told[0][own].astype(float), np.ones(own.sum())), (np.concatenate((m, m)), labels, np.concatenate(counts))]


def _moments(lessons, x, m, at, tie) -> np.ndarray:
    return np.concatenate([np.concatenate(([n.sum()], n @ v, n @ (v * v))) for v, _, n in _by_view(lessons, x, m, at, tie)])


def _slope(view: Logistic, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The loss, its gradient and its second derivatives at a view's weights."""
    x, y, n = x[n > 0], y[n > 0], n[n > 0]
    z = np.concatenate((np.ones((len(x), 1)), np.clip((x - view.mean) / view.scale, -8, 8)), axis=1)
    t = z @ view.weights
    p = 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    return np.concatenate(([(n * (np.logaddexp(0, t) - y * t)).sum()], z.T @ (n * (p - y)), ((z * (n * p * (1 - p))[:, None]).T @ z).ravel()))


def _slopes(lessons, views: dict[int, Logistic], x, m, at, tie) -> np.ndarray:
    rows = _by_view(lessons, x, m, at, tie)
    return np.concatenate([_slope(view, *rows[k]) for k, view in views.items()])


def _fit_views(base: list[np.ndarray], y: np.ndarray, pool, lessons, views: tuple[Logistic, Logistic], ridge: float = 1.0) -> tuple[Logistic, Logistic]:
    """fit_logistic() of both views over the labelled rows and what the pool has been told; one pass over the pool a step."""
    sums, ones, at = pool.total(partial(_moments, lessons)), np.ones(len(y)), 0
    now: dict[int, Logistic] = {}
    for k, x in enumerate(base):
        d = x.shape[1]
        n, first, second = sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + 2 * d]
        at += 1 + 2 * d
        mean = (x.sum(axis=0) + PSEUDO_WEIGHT * first) / (len(x) + PSEUDO_WEIGHT * n)
        plain = (x.sum(axis=0) + first) / (len(x) + n)
        scale = np.maximum(np.sqrt(np.maximum(((x * x).sum(axis=0) + second) / (len(x) + n) - plain**2, 0)), 1e-6)
        # what the view knew, in the new units
        old = views[k].weights
        w = old[1:] * np.clip(scale / views[k].scale, 0, 10)
        now[k] = Logistic(mean, scale, np.concatenate(([old[0] + (old[1:] * np.clip((mean - views[k].mean) / views[k].scale, -8, 8)).sum()], w)))
    done: dict[int, Logistic] = {}
    best: dict[int, tuple[float, np.ndarray]] = {}
    steps: dict[int, np.ndarray] = {}
    for _ in range(60):
        seen, at = pool.total(partial(_slopes, lessons, now)), 0
        for k in list(now):
            d = base[k].shape[1] + 1
            pull, w = np.full(d, ridge), now[k].weights
            pull[0] = 1e-3
            all_ = PSEUDO_WEIGHT * seen[at : at + 1 + d + d * d] + _slope(now[k], base[k], y, ones)
            at += 1 + d + d * d
            loss = all_[0] + (pull * w * w).sum() / 2
            if k not in best or loss <= best[k][0] or abs(steps[k]).max() <= 1e-9:
                best[k] = loss, w
                steps[k] = np.linalg.solve(all_[1 + d :].reshape(d, d) + np.diag(pull), all_[1 : 1 + d] + pull * w)
                # a step so small is taken without looking again
                small = abs(steps[k]).max() < 1e-4
            else:
                steps[k], small = steps[k] / 2, False
            now[k] = Logistic(now[k].mean, now[k].scale, best[k][1] - steps[k])
            if small:
                done[k] = now.pop(k)
        if not now:
            break
    return tuple((done | now)[k] for k in (0, 1))


def _bound(counts: np.ndarray, most: int) -> tuple[int, float]:
    above = np.cumsum(counts[::-1])
    k = int(np.searchsorted(above, most))
    if k >= len(counts):
        return 0, 1.0
    step = len(counts) - 1 - k
    return step, float((most - (above[k] - counts[step])) / max(1.0, counts[step]))


def cotrain(x: np.ndarray, m: np.ndarray, y: np.ndarray, ux: np.ndarray, um: np.ndarray, rounds: int = ROUNDS, tie: np.ndarray | None = None) -> QualityModel:
    """Over unlabelled rows in memory; see cotrain_over."""
    return cotrain_over(x, m, y, ArrayPool(ux, um, tie), rounds)


def cotrain_over(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool: ArrayPool | TablePool, rounds: int = ROUNDS) -> QualityModel:
    """y: 0 or 1. A fifth of the labelled rows is kept for the calibration of both views and their sum.

    Each round scores the whole pool. What a view has been told follows from the teachers and bounds
    of the rounds so far, so the pool is only read; passes bring home counts and sums of fixed size.
    """
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        kept[:] = False
    base_x, base_m, base_y = x[~kept], m[~kept], y[~kept]
    ones = np.ones(len(base_y))
    text, meta = fit_logistic(base_x, base_y, ones), fit_logistic(base_m, base_y, ones)
    lessons: list[tuple[Lesson, Lesson]] = []
    share = base_y.mean()
    for _ in range(rounds if pool.size else 0):
        counts = pool.total(partial(_sureness, lessons, (text, meta))).reshape(2, 2, STEPS)
        most = [int(STEP_SHARE * part * pool.size) + 1 for part in (share, 1 - share)]
        bounds = [tuple(_bound(counts[t, k], most[k]) for k in (0, 1)) for t in (0, 1)]
        lessons = [*lessons, ((text, bounds[0]), (meta, bounds[1]))]
        text, meta = _fit_views([base_x, base_m], base_y, pool, lessons, (text, meta))
    cx, cm, cy = (x[kept], m[kept], y[kept]) if kept.any() else (x, m, y)
    ones = np.ones(len(cy))
    a, b = text.logit(cx)[:, None], meta.logit(cm)[:, None]
    text_scale, meta_scale = fit_logistic(a, cy, ones), fit_logistic(b, cy, ones)
    both = fit_logistic(np.stack((text_scale.logit(a), meta_scale.logit(b)), axis=1), cy, ones)
    return QualityModel(text, meta, text_scale, meta_scale, both)


def _views(texts: list, metas: list[list]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([text_features(t or "") for t in texts]), np.array([meta_features(meta_slots(list(v))) for v in zip(*metas)] if metas else [meta_features([])] * len(texts))


def _metadata(docs: DataFrame, meta_cols: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(f"_m{k}") for k, c in enumerate(meta_cols)]


def tie(id_col: str) -> Column:
    """A number from 0 to 1 that orders equally sure rows."""
    return F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> QualityModel | float:
    """A model, or the prior where labels have one class only. At most max_labelled labelled rows are learnt from, chosen by a hash of their ids; unlabelled ones are not bounded.

    Features are taken of each text once and joined with the labels without the text; only those
    of the labelled rows go to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    usable = known.where(~held_out(id_col)).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    columns = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *_metadata(docs, meta_cols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, *metas = (batch.column(k).to_pylist() for k in range(1, batch.num_columns))
            x = [np.array(text_features(t or ""), np.float32).tobytes() for t in texts]
            slots = [bytes(meta_slots(list(v))) for v in zip(*metas)] if metas else [b""] * len(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.binary()), pa.array(slots, pa.binary())], ["id", "x", "slots"])

    features = docs.select(*columns).where("_id is not null").mapInArrow(tidily(run), "id bigint, x binary, slots binary")
    labelled = known.select(F.col(id_col).cast("bigint").alias("id"), F.lit(True).alias("labelled"))
    features = materialise(features.join(labelled, "id", "left"), "quality")
    seen = features.where("labelled").join(F.broadcast(usable.select(F.col(id_col).cast("bigint").alias("id"), "_label")), "id").select("id", "x", "slots", "_label").collect()
    seen.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["_label"], bytes(r["x"])))
    y = np.array([float(r["_label"] > 0) for r in seen])
    if len(set(y)) < 2:
        return float((y.sum() + 0.5) / (len(y) + 1))
    width = len(text_features(""))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in seen), np.float32).reshape(-1, width).astype(float)
    m = np.array([meta_features(np.frombuffer(bytes(r["slots"]), "u1")) for r in seen])
    return cotrain_over(x, m, y, TablePool(features.where("labelled is null").select("x", "slots", tie("id").alias("tie")), width))


def score(docs: DataFrame, model: QualityModel | float, meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_score, meta_score, score): one pass over whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            if isinstance(model, float):
                out = (np.full(batch.num_rows, model),) * 3
            else:
                out = model.scores(*_views(columns[0], columns[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, pa.float64()) for v in out)], ["doc_id", "text_score", "meta_score", "score"])

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *_metadata(docs, meta_cols)]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double")
