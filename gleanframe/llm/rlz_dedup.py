"""Substring dedup on words by relative Lempel-Ziv parsing against blocks of reference documents.

The reference of a document is every block's documents with smaller ids. Each block is indexed by
its phrases: the text around each anchor (see blocks) that also stands in another document. A phrase
goes to the task of its anchor, where phrases of all blocks meet and are compared word by word; there
each window of `window` words finds its source, the place in the document of the least id that has it.
A document is then parsed greedily: a factor begins where a window has a source in a smaller id and
runs on as long as the next window's source is the next place of the same document. The windows
around the ends of a factor have been looked up whole like all others, so one that crosses from one
factor into the next is removed only if it stands in the reference itself. Factors have `window` words
at least, and their words go.

Null texts have no words; a null id counts as larger than any other; equal ids are not smaller than one
another, so rows that repeat an id leave each other alone; an empty table gives an empty result. Very
long texts are hashed in overlapping pieces and lie in blocks of their own. Hashes only choose which
phrases meet; equal hashes of different words change nothing. Only the id and the text are read, so
clashing names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import NO_ID, covered, enough_buckets, found, mixed, runs, window_min, write_blocks
from .common import tidy

ANCHOR_WORDS = 5
#: Words that are hashed at a time; longer texts are taken in overlapping pieces.
LOT = 1 << 20
#: Phrases of an anchor beyond which its windows go out one by one, dealt by their own words.
HOT = 1024
_B = np.uint64(0x9E3779B97F4A7C15)
#: A place is a document's slot in its block and the number of a word.
PLACE_BITS = 40

RESULT = "doc_id bigint, kept string, n_words bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, factors array<struct<start:bigint,stop:bigint,source_id:bigint,source_start:bigint>>"
PHRASE = "bucket int, key bigint, phrase binary, block bigint, low bigint, high bigint, places array<bigint>"


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x) - k + 1
    out = x[:n].copy()
    for j in range(1, k):
        out *= _B
        out += x[j : j + n]
    return mixed(out)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _lots(texts: list[list[bytes]], window: int, piece: int, hash_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, document, start) of neighbouring words: of several documents, or of a piece of a long one."""
    held: list[np.ndarray] = []
    docs: list[tuple[int, int, int]] = []
    size = 0
    digest, kept = xxhash.xxh64_intdigest, np.uint64((1 << hash_bits) - 1)

    def out():
        nonlocal held, docs, size
        if held:
            doc = np.repeat([d for d, _, _ in docs], [n for _, _, n in docs])
            at = np.concatenate([np.arange(a, a + n) for _, a, n in docs])
            yield np.concatenate(held), doc, at
        held, docs, size = [], [], 0

    for k, words in enumerate(texts):
        if len(words) < window:
            continue
        x = np.array([digest(w) for w in words], dtype=np.uint64) & kept
        for a in range(0, len(x) - window + 1, piece):
            part = x[a : a + piece + window - 1]
            if size + len(part) > piece + window:
                yield from out()
            held.append(part)
            docs.append((k, a, len(part)))
            size += len(part)
    yield from out()


class _Phrases:
    """Runs of neighbouring windows with the same anchor: their anchors, documents, and first and last windows' starts."""

    def __init__(self, lot, window: int, anchor: int):
        x, doc, at = lot
        n = len(x) - window + 1
        inside = np.nonzero((doc[:n] == doc[window - 1 :]) & (at[:n] + window - 1 == at[window - 1 :]))[0]
        anchors = window_min(_rolled(x, anchor), window - anchor + 1)[inside]
        self.windows, self.starts = _rolled(x, window)[inside], at[inside]
        owner = doc[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        self.first = np.nonzero(new)[0]
        self.last = np.concatenate((self.first[1:], [len(inside)]))[: len(self.first)] - 1
        self.anchor, self.doc = anchors[self.first], owner[self.first]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _sources(phrases: dict[bytes, tuple[int, int, int]], window: int) -> dict[bytes, list[tuple[int, int, tuple[int, int, int]]]]:
    """For phrases, each with its first (id, block, place), runs of windows (from, to, source of the first) whose sources follow one another."""
    if len(phrases) == 1:
        ((phrase, own),) = phrases.items()
        return {phrase: [(0, phrase.count(b" ") - window + 2, own)]}
    least: dict[bytes, tuple[int, int, int]] = {}
    cut: dict[bytes, list[bytes]] = {}
    for phrase, (low, block, place) in phrases.items():
        at = [0, *accumulate(len(w) + 1 for w in phrase.split(b" "))]
        cut[phrase] = own = [phrase[at[s] : at[s + window] - 1] for s in range(len(at) - window)]
        for s, w in enumerate(own):
            source, known = (low, block, place + s), least.get(w)
            if known is None or source < known:
                least[w] = source
    out: dict[bytes, list[tuple[int, int, tuple[int, int, int]]]] = {}
    for phrase, own in cut.items():
        parts: list[tuple[int, int, tuple[int, int, int]]] = []
        for s, w in enumerate(own):
            source = least[w]
            if parts and source == (parts[-1][2][0], parts[-1][2][1], parts[-1][2][2] + s - parts[-1][0]):
                parts[-1] = (parts[-1][0], s + 1, parts[-1][2])
            else:
                parts.append((s, s + 1, source))
        out[phrase] = parts
    return out


def _hits(table: pa.Table, ids: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(slot, start, stop, source's id, block and place) of the runs of windows that have a source in a smaller id, in order."""
    if not len(table):
        return (np.zeros(0, np.int64),) * 6
    flat = [np.concatenate([c.flatten().to_numpy() for c in table.column(n).chunks]) for n in ("places", "runs")]
    n, m = (pc.list_value_length(table.column(c)).to_numpy() for c in ("places", "runs"))
    m = m // 5
    run_rows = flat[1].reshape(-1, 5)
    owner = np.repeat(np.arange(len(n)), n)
    many = m[owner]
    at = np.repeat(flat[0], many)
    run = run_rows[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(m) - m)[owner], many)]
    slot, start = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
    start, stop = start + run[:, 0], start + run[:, 1] + window - 1
    low, block, place = run[:, 2], run[:, 3], run[:, 4]
    use = np.nonzero(low < ids[slot])[0]
    use = use[np.lexsort((start[use], slot[use]))]
    return slot[use], start[use], stop[use], low[use], block[use], place[use]


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, piece: int = LOT, hash_bits: int = 64) -> DataFrame:
    """One row per document: its kept words joined by one space, the spans of words that went, and the
    factors: words [start, stop) stand in document source_id from word source_start on.

    Shuffled are anchors, one row per block and anchor, and phrases with a shared anchor, one row per
    block and distinct phrase; a passage of any number of documents adds a row per block. Where an
    anchor has more than HOT phrases, as at the ends of a common passage, its windows are dealt one
    by one. piece: words that are hashed at a time; hash_bits: of a word's hash, fewer only add candidates.
    """
    anchor = min(ANCHOR_WORDS, window)
    table = write_blocks(docs, id_col, text_col)
    buckets = enough_buckets(table)

    def anchors_of(part: pa.Table) -> pa.Table:
        ids = _ids(part)
        keys, owner, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lot in _lots([words_of(t) for t in part.column("text").to_pylist()], window, piece, hash_bits):
            p = _Phrases(lot, window, anchor)
            keys.append(p.anchor)
            owner.append(ids[p.doc])
            kinds.append(mixed(p.windows[p.first]) + p.windows[p.last])
        keys, owner, kinds = np.concatenate(keys), np.concatenate(owner), np.concatenate(kinds)
        order = np.lexsort((kinds, keys))
        keys, owner, kinds = keys[order], owner[order], kinds[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        other = new.copy()
        other[1:] |= kinds[1:] != kinds[:-1]
        first = np.nonzero(new)[0]
        low, high, n = (f.reduceat(v, first) if len(first) else first for f, v in ((np.minimum, owner), (np.maximum, owner), (np.add, other.astype(np.int32))))
        block = np.full(len(first), part.column("block")[0].as_py(), np.int64)
        # phrases, negative if they are of several ids: a column less to shuffle
        signed = np.where(low < high, -n, n).astype(np.int32)
        return pa.table({"key": pa.array(keys[first].view(np.int64)), "block": pa.array(block), "low": pa.array(low), "phrases": pa.array(signed, pa.int32())})

    w = Window.partitionBy("key")
    counted = table.groupBy("block").applyInArrow(anchors_of, "key bigint, block bigint, low bigint, phrases int")
    shared = counted.withColumns({"several": (F.min("low").over(w) < F.max("low").over(w)) | (F.min("phrases").over(w) < 0), "hot": F.sum(F.abs("phrases")).over(w) > HOT})
    shared = shared.where("several").select("block", "key", "hot")

    def phrases_of(part: pa.Table, hits: pa.Table) -> pa.Table:
        block = part.column("block")[0].as_py()
        ids, slots = _ids(part).tolist(), part.column("slot").to_pylist()
        # (key, phrase) -> ids and places
        seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        keys = hits.column("key").to_numpy().view(np.uint64) if len(hits) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        hot = hits.column("hot").to_numpy(zero_copy_only=False).astype(bool)[order] if len(hits) else np.zeros(0, bool)
        texts = [words_of(t) for t in part.column("text").to_pylist()] if len(keys) else []
        for lot in _lots(texts, window, piece, hash_bits):
            p = _Phrases(lot, window, anchor)
            hit, where = found(keys, p.anchor)
            hit = np.nonzero(hit)[0]
            columns = (x.tolist() for x in (p.anchor[hit], p.doc[hit], p.starts[p.first[hit]], p.starts[p.last[hit]], p.first[hit], hot[where[hit]]))
            for key, doc, a, b, first, is_hot in zip(*columns):
                words, place = texts[doc], (slots[doc] << PLACE_BITS) + a
                if not is_hot:
                    seen.setdefault((key, b" ".join(words[a : b + window])), []).append((ids[doc], place))
                else:
                    for k, h in enumerate(p.windows[first : first + b - a + 1].tolist()):
                        seen.setdefault((h, b" ".join(words[a + k : a + k + window])), []).append((ids[doc], place + k))
        tidy()
        rows = [(key, phrase, sorted(at)) for (key, phrase), at in seen.items()]
        signed = np.array([k for k, _, _ in rows], dtype=np.uint64)
        return pa.table({
            "bucket": pa.array((mixed(signed) % np.uint64(buckets)).astype(np.int32)), "key": pa.array(signed.view(np.int64)), "phrase": pa.array([x for _, x, _ in rows], pa.binary()),
            "block": pa.array([block] * len(rows), pa.int64()), "low": pa.array([at[0][0] for _, _, at in rows], pa.int64()), "high": pa.array([at[-1][0] for _, _, at in rows], pa.int64()),
            "places": pa.array([[x for _, x in at] for _, _, at in rows], pa.list_(pa.int64())),
        })

    def sources_of(group: pa.Table) -> pa.Table:
        blocks, low, high = (group.column(c).to_pylist() for c in ("block", "low", "high"))
        places = pc.list_element(group.column("places"), 0).to_pylist() if len(group) else []
        members: dict[int, dict[bytes, list[int]]] = {}
        for k, (key, phrase) in enumerate(zip(group.column("key").to_pylist(), group.column("phrase").to_pylist())):
            members.setdefault(key, {}).setdefault(phrase, []).append(k)
        told: list[int] = []
        found_: list[list[int]] = []
        for phrases in members.values():
            parsed = _sources({x: min((low[k], blocks[k], places[k]) for k in own) for x, own in phrases.items()}, window)
            for x, own in phrases.items():
                least = min(s[2][0] for s in parsed[x])
                flat = [v for a, b, source in parsed[x] for v in (a, b, *source)]
                for k in own:
                    if high[k] > least:
                        told.append(k)
                        found_.append(flat)
        tidy()
        at = pa.array(told, pa.int64())
        return pa.table({"block": group.column("block").take(at), "places": group.column("places").take(at), "runs": pa.array(found_, pa.list_(pa.int64()))})

    def parse(part: pa.Table, hits: pa.Table) -> pa.Table:
        ids, slots = _ids(part), part.column("slot").to_numpy()
        by_slot = np.zeros(int(slots.max()) + 1, np.int64)
        by_slot[slots] = ids
        slot, start, stop, low, block, place = _hits(hits, by_slot, window)
        # a run continues the one before if both its words and its source do
        same = np.zeros(len(slot), bool)
        same[1:] = (slot[1:] == slot[:-1]) & (start[1:] == stop[:-1] - window + 1) & (low[1:] == low[:-1]) & (block[1:] == block[:-1]) & (place[1:] - place[:-1] == start[1:] - start[:-1])
        begin = np.nonzero(~same)[0]
        end = np.concatenate((begin[1:], [len(slot)]))[: len(begin)] - 1
        factors = slot[begin], start[begin], stop[end], low[begin], place[begin] & ((1 << PLACE_BITS) - 1)
        out: dict[str, list] = {"kept": [], "n_words": [], "n_removed": [], "spans": [], "factors": []}
        for own_slot, text in zip(slots.tolist(), part.column("text").to_pylist()):
            words = words_of(text)
            i, j = np.searchsorted(factors[0], own_slot), np.searchsorted(factors[0], own_slot, "right")
            own = [x[i:j] for x in factors[1:]]
            a, b = (x.tolist() for x in runs(covered(own[0], own[1], len(words)))) if i < j else ((), ())
            keep = [w for x, y in zip([0, *b], [*a, len(words)]) for w in words[x:y]] if a else words
            out["kept"].append(b" ".join(keep).decode("utf-8", "replace"))
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(keep))
            out["spans"].append([{"start": x, "stop": y} for x, y in zip(a, b)])
            out["factors"].append([dict(zip(("start", "stop", "source_id", "source_start"), f)) for f in zip(*(x.tolist() for x in own))])
        tidy()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        parsed = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "source_id", "source_start")]))
        return pa.table({
            "doc_id": part.column("doc_id"), "kept": pa.array(out["kept"], pa.string()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
            "spans": pa.array(out["spans"], spans), "factors": pa.array(out["factors"], parsed),
        })

    phrases = table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(phrases_of, PHRASE)
    sources = phrases.groupBy("bucket").applyInArrow(sources_of, "block bigint, places array<bigint>, runs array<bigint>")
    return table.groupBy("block").cogroup(sources.groupBy("block")).applyInArrow(parse, RESULT)
