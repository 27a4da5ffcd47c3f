"""Toxicity: disguised words are restored by a noisy-channel decoder, then the restored text is scored.

Null texts count as empty; an empty text has a score like any other (that of no evidence). A null
id is never learnt from. Without a labelled toxic row every score is the prior; an empty table gives
an empty result. Very long texts are read whole, tokens of over LONGEST characters in overlapping
pieces. Equal texts have equal scores, repeated rows are scored each; of readings that cost the same
the first one offered is taken. Labels, languages, sources, ids and any further columns are never
inputs of a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, tidily

#: Labelled documents that the classifier is fitted on at most, chosen by a hash of their ids.
MAX_LABELLED = 20_000
#: Twice the log-likelihood ratio from which a word counts as evidence.
LEAST_EVIDENCE = 24.0
#: Words with doubled letters are usual, and left as they are, from this share of all such words on; fewer than 4,096 can be.
USUAL = 1 / 4096
PREFIXES = (4, 5, 6, 7, 8)
#: Smallest odds that a mark gives, as a logarithm.
LEAST_WEIGHT = 1.5

# What a disguised character can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
}
SEPARATORS = " .-_*~,/\\'"
TRIM = ".,;:?\"'()[]{}<>#%&*$!|~`^-_=+/\\…«»“”‘’¿¡"
HIDDEN = re.compile("[­​-‏⁠﻿]")
TWICE = re.compile(r"(.)\1")
THRICE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<![^\s])(?:[^\s][ .\-_*~,/]){2,}[^\s](?=[.,;:!?\"')]*(?:\s|$))")
#: The same with any number of separators, tabs and line ends among them.
WIDE = re.compile(r"(?<!\S)(?:\S[\s.\-_*~,/]++){2,}\S(?=[.,;:!?\"')]*(?:\s|$))")
LETTER = re.compile(r"[^\W\d_]")
SIGNS = re.compile("[" + re.escape("".join(LEET)) + re.escape("*.-_~/") + "]")
#: Costs of the channel, in nats.
KEEP_SIGN, SWAP, FILL, DROP, COLLAPSE, JOIN = 9.0, 0.7, 2.0, 1.0, 0.5, 0.2
#: Characters that are decoded at a time; longer tokens are decoded in overlapping pieces.
LONGEST = 40

CLASSES = 28  # 0: between words, 1-26: a-z, 27: any other letter
_CLASS = np.array([27 if chr(c).isalpha() else 0 for c in range(0x250)], np.int64)
_CLASS[97:123] = np.arange(1, 27)


def char_counts(docs: DataFrame, text_col: str = "text") -> dict[int | str, int]:
    """How often each three classes of characters follow one another, over all whole texts, and the usual words with doubled letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        doubled: Counter = Counter()

        def told() -> pa.RecordBatch:
            seen = np.nonzero(total)[0]
            codes, words = seen.tolist() + [None] * len(doubled), [None] * len(seen) + list(doubled)
            out = pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(words, pa.string()), pa.array(total[seen].tolist() + list(doubled.values()), pa.int64())], ["code", "word", "n"])
            total[:] = 0
            doubled.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = text.lower()
                cps = np.frombuffer(f"  {low} ".encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.where(cps < 0x250, _CLASS[np.minimum(cps, 0x24F)], 27)
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
                doubled.update([w for t in low.split() if TWICE.search(t) and (w := t.strip(TRIM)).isalpha() and TWICE.search(w) and not THRICE.search(w)])
                if len(doubled) > 100_000:
                    yield told()
        yield told()

    found = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(tidily(run), "code bigint, word string, n bigint")
    found = materialise(found.groupBy("code", "word").agg(F.sum("n").alias("n")), "chars")
    counts: dict[int | str, int] = {r["code"]: r["n"] for r in found.where("word is null").collect()}
    words = found.where("word is not null")
    total = words.agg(F.sum("n")).first()[0] or 0
    return counts | {r["word"]: r["n"] for r in words.where(F.col("n") > total * USUAL).collect()}


class CharModel:
    """Costs (negative logarithms) of a class after two others, smoothed by shorter contexts, and the usual words with doubled letters."""

    def __init__(self, counts: dict[int | str, int]):
        tri = np.zeros(CLASSES**3)
        self.usual = {code for code in counts if isinstance(code, str)}
        for code, n in counts.items():
            if code not in self.usual:
                tri[code] = n
        tri = tri.reshape(CLASSES, CLASSES, CLASSES)
        bi, uni = tri.sum(0), tri.sum((0, 1)) + 1
        p1 = uni / uni.sum()
        p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).tolist()


def _class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < 0x250 else 27


def lattice(token: str, split: bool = True) -> list[list[tuple[str, float]]]:
    """For each run of one character, and for each star, the strings it can stand for, with their costs in the channel.

    split: a separator may also stand for the end of a word.
    """
    out, at = [], 0
    while at < len(token):
        c = token[at]
        n = 1
        while c != "*" and at + n < len(token) and token[at + n] == c:
            n += 1
        inner = 0 < at and at + n < len(token)
        if c.isalpha() and c not in LEET:
            arcs = [(c * n, 0.0 if n < 3 else KEEP_SIGN)]
            if n > 1:
                arcs += [(c, COLLAPSE)] + ([(c * 2, COLLAPSE)] if n > 2 else [])
        else:
            arcs = [(c * n, KEEP_SIGN * n)]
            for letter in LEET.get(c, ""):
                arcs += [(letter, SWAP)] + ([(letter * 2, SWAP + COLLAPSE)] if n > 1 else [])
            if c in SEPARATORS and inner:
                arcs += [("", JOIN), (" ", DROP)] if split else [("", JOIN)]
            if c == "*":
                arcs += [(chr(97 + k), FILL) for k in range(26)]
        out.append(arcs)
        at += n
    return out


def restore(token: str, model: CharModel, split: bool = True) -> str:
    """The likeliest text behind token: Viterbi over its lattice, states are the last two classes, all of which are kept."""
    cost = model.cost
    # a text is kept as its last string and what was before, so that long tokens take linear time
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for arcs in lattice(token, split):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (total, text) in states.items():
            for string, price in arcs:
                x, y, sum_ = a, b, total + price
                for c in string:
                    k = _class(c)
                    sum_ += cost[x][y][k]
                    x, y = y, k
                if (x, y) not in after or sum_ < after[x, y][0]:
                    after[x, y] = (sum_, (text, string))
        states = after
    text = min(((total + cost[a][b][0], text) for (a, b), (total, text) in states.items()), key=lambda s: s[0])[1]
    parts = []
    while text:
        text, string = text
        parts.append(string)
    return "".join(reversed(parts))


def pieces(token: str, longest: int = LONGEST) -> list[str]:
    """token, or overlapping pieces of it of at most `longest` characters.

    Pieces begin and end at separators, or at every half of `longest` where there are none. What
    lies between two such places and has at most half of `longest` is whole in one of the pieces.
    """
    if len(token) <= longest:
        return [token]
    cuts = [0]
    for at in [k + 1 for k, c in enumerate(token) if c in SEPARATORS] + [len(token)]:
        if at - cuts[-1] > longest:
            cuts.extend(range(cuts[-1] + longest // 2, at, longest // 2))
        if at > cuts[-1]:
            cuts.append(at)
    out, k = [], 0
    while True:
        end = bisect_right(cuts, cuts[k] + longest) - 1
        out.append(token[cuts[k] : cuts[end]])
        if cuts[end] == len(token):
            return out
        k = max(k + 1, bisect_right(cuts, cuts[k] + longest // 2) - 1)


@dataclass
class Reader:
    """Words of a text as they stand and as they are restored; remembers what it restored."""

    model: CharModel
    memo: dict[str, list[str]] = field(default_factory=dict)

    def restored(self, token: str) -> list[str]:
        out = self.memo.get(token)
        if out is None:
            if len(self.memo) > 40_000:
                self.memo.clear()
            out = [w for split in (True, False)[: 1 + any(c in SEPARATORS for c in token)] for w in restore(token, self.model, split).split() if w.isalpha() and w != token]
            if len(token) <= 4 * LONGEST:
                self.memo[token] = out
        return out

    def words(self, text: str) -> set[str]:
        low = HIDDEN.sub("", text.lower())
        out, odd = set(), set()
        for token in set(low.split()):
            word = token.strip(TRIM)
            if word.isalpha():
                out.add(word)
                if TWICE.search(word) and word not in self.model.usual:
                    odd.add(word)
                elif not word.isascii() and any(c in LEET for c in word):
                    odd.add(word)
            elif len(token) > 2 and LETTER.search(token):
                # signs at the ends may be letters in disguise or mere decoration
                for form in {word, token.strip(".,;:?\"'")}:
                    bounded = {p for c in SEPARATORS if c in form for p in form.split(c)} if len(form) > LONGEST else ()
                    for piece in (*pieces(form), *(p for p in bounded if len(p) <= LONGEST)):
                        if len(piece) > 2 and LETTER.search(piece) and SIGNS.search(piece) and not THRICE.fullmatch(piece):
                            odd.add(piece)
                out.update(p for p in re.split(r"[\W\d_]+", word) if len(p) > 2)
        odd.update(" ".join(m.group().split()) for spaced in (SPACED, WIDE) for m in spaced.finditer(low))
        for token in odd:
            out.update(self.restored(token))
        return out


def features(words: set[str]) -> set[str]:
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """(weight, trust) of the marks, and the logistic curve over a text's evidence."""

    counts: dict[int | str, int]
    marks: dict[str, tuple[float, float]]
    curve: tuple[float, float, float]

    def __post_init__(self):
        object.__setattr__(self, "heads", {m[:4] for m in self.marks})

    def evidence(self, words: set[str]) -> tuple[float, float]:
        """Sum of the words' weights, and the highest trust; a word and its beginnings are one piece of evidence."""
        marks, heads, total, most = self.marks, self.heads, 0.0, 0.0
        for w in words:
            if w[:4] not in heads:
                continue
            found = [x for x in [marks.get(w), *[marks.get(w[:n] + "-") for n in PREFIXES if len(w) > n]] if x]
            if found:
                total += max(found)[0]
                most = max(most, max(x[1] for x in found))
        return min(total, 20.0), most

    def score(self, evidence: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * evidence[0] + self.curve[2] * evidence[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _evidence(t: Column, c: Column, n_t: float, n_c: float) -> Column:
    """Twice the log-likelihood ratio of a mark's counts in toxic and other documents against equal rates."""

    def within(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))

    rate = within((t + c) / F.lit(n_t + n_c))

    def part(k: Column, n: float) -> Column:
        p = within(k / F.lit(n))
        return k * F.ln(p / rate) + (F.lit(n) - k) * F.ln((1 - p) / (1 - rate))

    return 2 * (part(t, n_t) + part(c, n_c))


def _weight(t: Column, c: Column, n_t: float, n_c: float) -> Column:
    """How much likelier a mark is in toxic documents than in others, as a logarithm."""
    return F.ln((t + 0.5) / F.lit(n_t + 1)) - F.ln((c + 0.5) / F.lit(n_c + 1))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Character counts of all texts, marks and curve of at most max_labelled labelled ones that aren't held out."""
    counts = char_counts(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(known), id_col).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(counts))
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = seen[int(label > 0)]
                own.update(features(reader.words(text)))
                own[""] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["mark", "toxic", "other"])

    counted = rows.mapInArrow(tidily(count), "mark string, toxic bigint, other bigint").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counted = materialise(counted, "marks")
    total = counted.where("mark = ''").first()
    n_t, n_c = (float(total["toxic"]), float(total["other"])) if total else (0.0, 0.0)
    prior = math.log((n_t + 0.5) / (n_c + 0.5))
    # all marks of enough evidence; their number is bounded by the labelled rows'
    strong = (_evidence(F.col("toxic"), F.col("other"), n_t, n_c) >= LEAST_EVIDENCE) & (_weight(F.col("toxic"), F.col("other"), n_t, n_c) >= LEAST_WEIGHT)
    marks = counted.where("mark <> '' and toxic > 0").where(strong).orderBy("mark").collect() if n_t and n_c else []
    if not marks:
        return ToxicityModel(counts, {}, (prior, 0.0, 0.0))
    t, c = np.array([r["toxic"] for r in marks], float), np.array([r["other"] for r in marks], float)
    weight = np.log((t + 0.5) / (n_t + 1)) - np.log((c + 0.5) / (n_c + 1))
    # the odds at the lower end of Wilson's interval for the share of toxic documents among those with the mark
    n, share = t + c, t / (t + c)
    low = (share + 2 / n - 2 * np.sqrt(share * (1 - share) / n + 1 / n**2)) / (1 + 4 / n)
    trust = np.maximum(0.0, np.log(np.maximum(low, 1e-6) / (1 - low)))
    model = ToxicityModel(counts, {r["mark"]: (float(weight[k]), float(trust[k])) for k, r in enumerate(marks)}, (prior, 0.0, 0.0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(counts))
        for batch in batches:
            e = [model.evidence(reader.words(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([x[0] for x in e], pa.float64()), pa.array([x[1] for x in e], pa.float64())], ["label", "total", "most"])

    seen = rows.mapInArrow(tidily(read), "label int, total double, most double").select("label", F.round("total", 1).alias("total"), F.round("most", 1).alias("most")).groupBy("label", "total", "most").count().collect()
    x = np.array([[1.0, r["total"], r["most"]] for r in seen])
    y = np.array([float(r["label"] > 0) for r in seen])
    n = np.array([float(r["count"]) for r in seen])
    start, pull = np.array([prior, 0.0, 0.0]), np.array([0.01, 0.01, 0.01])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + (pull * (w - start) ** 2).sum() / 2)

    w = start.copy()
    for _ in range(100):  # Newton's method with halved steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + pull * (w - start)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
        while loss(w - step) > loss(w) and abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return ToxicityModel(counts, model.marks, (float(w[0]), float(max(w[1], 0.0)), float(max(w[2], 0.0))))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one pass over whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(model.counts))
        for batch in batches:
            scores = [model.score(model.evidence(reader.words(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(tidily(run), "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; the rows pass through one task as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(CharModel(model.counts))
        for batch in batches:
            keep = [model.score(model.evidence(reader.words(x or ""))) < threshold for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidily(run), docs.schema)
