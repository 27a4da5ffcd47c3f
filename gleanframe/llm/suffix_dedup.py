"""Substring dedup on bytes by two-stage suffix sorting.

Removed are all bytes of a string of `window` bytes that also starts anywhere else, in the same
document too. Counted besides are the bytes of shorter repeats, of `seek` bytes. Candidates are found
by anchors (see blocks): only strings of `seek` bytes whose anchor, a run of `anchor` bytes, stands in
a second place. The text around each such anchor, a context, goes to the task of its anchor. There
the contexts' suffixes are sorted in two stages: directly those that are smaller than their
successors, all others by one scan over the buckets of first bytes. Adjacent suffixes with a common
prefix of `seek` or of `window` bytes are repeats.

A null text counts as empty and a null id is kept. Rows that repeat a text, with the same id or not,
are places of their own, so all their strings are repeats. Very long texts are hashed in pieces that
overlap by a window and lie in blocks of their own; a text shorter than `seek` is never touched.
Removal may cut a multi-byte character: what is kept is therefore bytes, and kept_text has their
whole characters. An empty table gives an empty result. Only the id and the text are read, so clashing
names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import covered, enough_buckets, found, mixed, runs, window_min, write_blocks
from .common import materialise, tidy

#: Bytes of an anchor, in hundredths of the shortest repeat that is looked for.
ANCHOR_SHARE = 30
#: Bytes that are hashed at a time; longer texts are taken in overlapping pieces.
LOT = 1 << 20
POSITION_BITS = 21
#: Contexts of an anchor beyond which they are cut into slices that are dealt by the text they share.
HOT = 1024
SLICE = 16
#: What a context is for: strings of `seek` bytes, of `window` bytes, or both.
BOTH, SHORT, LONG = 0, 1, 2
#: Bytes sorted at a time.
SORT_LOT = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RESULT = "kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, n_repeated bigint"
CONTEXT = "bucket int, key bigint, deep int, context binary, starts int, block bigint, rows array<bigint>, places array<bigint>"


def suffix_order(text: bytes, depth: int, own: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least, by two-stage sorting.

    Stage one sorts the suffixes smaller than their successors by comparison. Stage two scans the
    buckets of first bytes upwards: each suffix found puts the one that starts a byte earlier, if
    that is larger than it, at the next free place in front of its bucket. A suffix larger than its
    successor is thus placed before the scan comes to it. A bucket's entries are handled as arrays.

    own: flags of the suffixes that are wanted. Only they are sorted, and what stage two needs to
    come to them: after each, the suffixes up to the next one that is smaller than its successor.
    """
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.zeros(n, np.int16)
    step[:-1] = np.diff(t.astype(np.int16))
    step[-1] = -1  # the last suffix is larger than the empty one after it
    # in a run of equal bytes, what follows the run decides
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    small = step[decides] > 0
    if own is None:
        needed = np.ones(n, bool)
    else:
        # the first small suffix at or after each place; the spans from wanted suffixes to there are needed
        stop = np.minimum.accumulate(np.where(small, np.arange(n), n - 1)[::-1])[::-1]
        wanted = np.nonzero(own)[0]
        needed = covered(wanted, stop[wanted] + 1, n)
    direct = sorted(np.nonzero(small & needed)[0].tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, np.int64)
    counts = np.bincount(t[needed], minlength=256)
    heads = np.concatenate(([0], np.cumsum(counts)[:-1]))
    tails = heads + counts
    order = np.empty(int(counts.sum()), np.int64)
    firsts = t[direct]
    bounds = np.searchsorted(firsts, np.arange(257))  # direct is sorted, so its first bytes are
    for c in range(256):
        k = bounds[c + 1] - bounds[c]
        order[tails[c] - k : tails[c]] = direct[bounds[c] : bounds[c + 1]]
    filled = heads.copy()
    large = needed & ~small

    def induce(found_: np.ndarray) -> None:
        before = found_[found_ > 0] - 1
        before = before[large[before]]
        if not len(before):
            return
        c = t[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        values, first, many = np.unique(c, return_index=True, return_counts=True)
        for v, a, m in zip(values.tolist(), first.tolist(), many.tolist()):
            order[filled[v] : filled[v] + m] = before[a : a + m]
            filled[v] += m

    # the last suffix follows the empty suffix, which is the least of all
    induce(np.array([n]))
    for c in range(256):
        at = heads[c]
        while at < filled[c]:  # runs of one byte fill their own bucket while it is scanned
            stop_ = filled[c]
            induce(order[at:stop_].copy())
            at = stop_
        induce(order[filled[c] : tails[c]].copy())
    return order


def common_prefixes(text: bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it, up to limit."""
    t = np.ndarray((len(text) + limit,), "<u8", text + bytes(limit + 8), strides=(1,))
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, limit, 8):
        if not len(alive):
            break
        x = t[order[alive] + k] ^ t[order[alive - 1] + k]
        same = x == 0
        # equal low bytes of words that differ
        out[alive] = np.where(same, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64) + k
        alive = alive[same]
    return np.minimum(out, limit)


Runs = list[tuple[int, int]]


def repeated_starts(contexts: list[tuple[bytes, int]], seek: int, window: int) -> list[tuple[Runs, Runs]]:
    """For each (context, number of starts): runs of its first places that start a string of `seek`, and of `window` bytes, that a second place starts."""
    text = b"".join(c for c, _ in contexts)
    own = np.zeros(len(text), bool)
    ends = np.zeros(len(text), np.int64)
    at = 0
    offsets = []
    for c, starts in contexts:
        offsets.append(at)
        own[at : at + starts] = True
        ends[at : at + starts] = at + len(c)
        at += len(c)
    order = suffix_order(text, window, own)
    order = order[own[order]]
    room, same = ends[order] - order, common_prefixes(text, order, window)
    out = []
    for length in (seek, window):
        # starts of whole strings; others that stand between two of them only read past their context
        whole = np.nonzero(room >= length)[0]
        flags = np.zeros(len(text), bool)
        if len(whole) > 1:
            near = np.minimum.reduceat(same[: whole[-1] + 1], whole[:-1] + 1) >= length
            flags[order[whole[1:][near]]] = True
            flags[order[whole[:-1][near]]] = True
        # runs don't reach into the next context, as a context ends with less than a whole string
        a, b = runs(flags)
        at = np.searchsorted(a, offsets).tolist() + [len(a)]
        a, b = a.tolist(), b.tolist()
        out.append([[(x - o, y - o) for x, y in zip(a[i:j], b[i:j])] if i < j else [] for o, i, j in zip(offsets, at, at[1:])])
    return list(zip(*out))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _B)


class _Lot:
    """Bytes of several documents, or of a piece of a long one, with the hashes of their runs."""

    def __init__(self, parts: list[tuple[int, int, bytes, int]], seek: int, window: int, anchor: int):
        self.text = b"".join(p[2] for p in parts)
        sizes = [len(p[2]) for p in parts]
        n = len(self.text)
        self.ends = np.cumsum(sizes)
        begins = self.ends - sizes
        self.part = np.repeat(np.arange(len(parts)), sizes)
        self.rows = np.array([p[0] for p in parts])
        self.begin = np.array([p[1] for p in parts]) - begins
        power = np.full(n, _B)
        power[:1] = 1
        power = np.cumprod(power)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[np.frombuffer(self.text, np.uint8)] * power)))
        power[:] = _INVERSE
        power[:1] = 1
        self.inverse = np.cumprod(power)
        at = np.arange(n - anchor + 1, dtype=np.uint64)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = window_min((self.hashes(np.arange(n - anchor + 1), anchor) & ~low) | at, seek - anchor + 1)
        stops = begins + [p[3] for p in parts]
        start = np.nonzero(np.arange(n - seek + 1) < stops[self.part[: n - seek + 1]])[0]
        least = least[start]
        # neighbouring strings with the same anchor are one occurrence
        new = np.ones(len(start), bool)
        new[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.concatenate((first[1:], [len(start)]))[: len(first)] - 1
        self.lo, self.hi = start[first], start[last]
        self.anchor = least[first] >> np.uint64(POSITION_BITS)
        self.place = (least[first] & low).astype(np.int64)
        stop = np.minimum(self.hi + window, self.ends[self.part[self.lo]])
        self.context = self.hashes(self.lo, stop - self.lo) ^ (self.hi - self.lo).astype(np.uint64)

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        return mixed((self.sums[at + length] - self.sums[at]) * self.inverse[at])


def _lots(table: pa.Table, seek: int, window: int, anchor: int, piece: int) -> Iterator[_Lot]:
    held, size = [], 0
    for row, text in zip(table.column("row").to_pylist(), table.column("text").to_pylist()):
        data = text.encode("utf-8", "surrogatepass")
        for a in range(0, len(data) - seek + 1, piece):
            part = data[a : a + piece + window - 1]
            if held and size + len(part) > piece + window:
                yield _Lot(held, seek, window, anchor)
                held, size = [], 0
            # a start belongs to one piece, though pieces overlap
            held.append((row, a, part, min(piece, len(data) - seek + 1 - a)))
            size += len(part)
    if held:
        yield _Lot(held, seek, window, anchor)


def _places(spans: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, long) of each repeat: every run of a context at every place of it."""
    if not len(spans):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    flat = [np.concatenate([c.flatten().to_numpy() for c in spans.column(n).chunks]) for n in ("rows", "places", "starts", "stops")]
    n, m = (pc.list_value_length(spans.column(c)).to_numpy() for c in ("rows", "starts"))
    # place k of a context meets its m runs
    owner = np.repeat(np.arange(len(n)), n)
    many = m[owner]
    place = np.repeat(np.arange(len(owner)), many)
    run = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(m) - m)[owner], many)
    long = spans.column("long").to_numpy(zero_copy_only=False).astype(bool)
    return flat[0][place], flat[1][place] + flat[2][run], flat[1][place] + flat[3][run], long[owner][place]


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, seek: int | None = None, anchor: int | None = None, carry: tuple[str, ...] = (), piece: int = LOT) -> DataFrame:
    """One row per document: its kept bytes, the spans of bytes that went, and n_repeated, the bytes in
    repeats of `seek` bytes (of `window` where it isn't given); rest has the columns to carry. piece: the
    bytes of a text that are hashed at a time.

    Anchors are shuffled as one row per block and anchor, contexts as one row per block and distinct
    context; texts are not shuffled. Where an anchor has more than HOT contexts, they are cut into
    slices of SLICE starts, dealt by the bytes that all strings of a slice share, so only slices
    that agree in nearly a whole string meet; one set of slices serves `seek`, another one `window`.
    """
    seek = min(seek or window, window)
    anchor = min(anchor or max(1, seek * ANCHOR_SHARE // 100), seek)
    width = min(SLICE, seek)
    table = write_blocks(docs, id_col, text_col, carry)
    buckets = enough_buckets(table)

    def anchors_of(part: pa.Table) -> pa.Table:
        keys, contexts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for lot in _lots(part, seek, window, anchor, piece):
            keys.append(lot.anchor)
            contexts.append(lot.context)
        keys, contexts = np.concatenate(keys), np.concatenate(contexts)
        order = np.lexsort((contexts, keys))
        keys, contexts = keys[order], contexts[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        other = new.copy()
        other[1:] |= contexts[1:] != contexts[:-1]
        first = np.nonzero(new)[0]
        stop = np.concatenate((first[1:], [len(keys)]))[: len(first)]
        distinct = np.add.reduceat(other.astype(np.int64), first) if len(first) else first
        block = np.full(len(first), part.column("block")[0].as_py(), np.int64)
        return pa.table({"key": pa.array(keys[first].view(np.int64)), "block": pa.array(block), "places": pa.array(stop - first), "contexts": pa.array(distinct)})

    counted = materialise(table.groupBy("block").applyInArrow(anchors_of, "key bigint, block bigint, places bigint, contexts bigint"), "anchors")
    # combined before the shuffle; a key of most blocks meets one row of sums, so the join can split it
    sums = counted.groupBy("key").agg(F.sum("places").alias("all"), (F.sum("contexts") > HOT).alias("hot")).where("all > 1")
    shared = counted.select("key", "block").join(sums.select("key", "hot").hint("merge"), "key").select("block", "key", "hot")

    def contexts_of(part: pa.Table, hits: pa.Table) -> pa.Table:
        block = part.column("block")[0].as_py()
        # (key, deep, context, starts) -> (rows, places)
        seen: dict[tuple[int, int, bytes, int], tuple[list[int], list[int]]] = {}
        keys = hits.column("key").to_numpy().view(np.uint64) if len(hits) else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        hot = hits.column("hot").to_numpy(zero_copy_only=False).astype(bool)[order] if len(hits) else np.zeros(0, bool)

        def add(key: int, deep: int, lot: _Lot, lo: int, hi: int, stop: int) -> None:
            part_ = lot.part[lo]
            rows, places = seen.setdefault((key, deep, lot.text[lo:stop], hi - lo + 1), ([], []))
            rows.append(int(lot.rows[part_]))
            places.append(int(lo + lot.begin[part_]))

        for lot in _lots(part, seek, window, anchor, piece) if len(keys) else ():
            hit, where = found(keys, lot.anchor)
            for k in np.nonzero(hit)[0].tolist():
                lo, hi, place, key = int(lot.lo[k]), int(lot.hi[k]), int(lot.place[k]), int(lot.anchor[k])
                end = int(lot.ends[lot.part[lo]])
                if not hot[where[k]]:
                    add(key, BOTH, lot, lo, hi, min(hi + window, end))
                    continue
                # slices are counted from the anchor, so equal strings are in equal slices
                for s in range((lo - place) // width, (hi - place) // width + 1):
                    begin = place + s * width
                    a, b = max(lo, begin), min(hi, begin + width - 1)
                    for deep, length in ((SHORT, seek), (LONG, window))[seek == window :]:
                        last = min(b, end - length)
                        if last < a:
                            continue
                        core = lot.hashes(np.array([begin + width - 1]), length - width + 1)[0]
                        mix = mixed(np.array([np.uint64(key) ^ core ^ np.uint64((s * 0x9E3779B97F4A7C15 + deep) & ((1 << 64) - 1))]))[0]
                        add(int(mix), deep, lot, a, last, last + length)
        rows = list(seen.items())
        tidy()
        signed = np.array([k for (k, _, _, _), _ in rows], dtype=np.uint64).view(np.int64)
        return pa.table({
            "bucket": pa.array((mixed(signed.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), "key": pa.array(signed), "deep": pa.array([d for (_, d, _, _), _ in rows], pa.int32()), "context": pa.array([c for (_, _, c, _), _ in rows], pa.binary()),
            "starts": pa.array([n for (_, _, _, n), _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()),
            "rows": pa.array([e[0] for _, e in rows], pa.list_(pa.int64())), "places": pa.array([e[1] for _, e in rows], pa.list_(pa.int64())),
        })

    def repeats_of(group: pa.Table) -> pa.Table:
        # equal contexts of several blocks are one
        merged: dict[tuple[int, int], dict[tuple[bytes, int], list[int]]] = {}
        starts = group.column("starts").to_pylist()
        for k, (key, deep, context) in enumerate(zip(group.column("key").to_pylist(), group.column("deep").to_pylist(), group.column("context").to_pylist())):
            merged.setdefault((key, deep), {}).setdefault((context, starts[k]), []).append(k)
        sizes_ = pc.list_value_length(group.column("rows")).to_pylist()
        # context rows with repeats, and the first and one past the last byte of each, counted from the context
        told: tuple[list, list, list, list] = ([], [], [], [])

        def tell(members: list[int], deep: int, short: Runs, long: Runs) -> None:
            for length, found_, is_long in ((seek, short if deep != LONG and seek < window else [], False), (window, long if deep != SHORT else [], True)):
                if found_:
                    a, b = [x for x, _ in found_], [y - 1 + length for _, y in found_]
                    told[0].extend(members)
                    for out, value in zip(told[1:], (a, b, is_long)):
                        out.extend([value] * len(members))

        # a place is in a slice of either kind, so the kinds are sorted apart
        lots: dict[int, list[tuple[list[int], bytes, int]]] = {}
        sizes: dict[int, int] = {}

        def sort_lot(deep: int) -> None:
            lot = lots.pop(deep, [])
            sizes[deep] = 0
            for (members, _, _), found_ in zip(lot, repeated_starts([(c, n) for _, c, n in lot], seek, window) if lot else ()):
                if members:
                    tell(members, deep, *found_)

        for (_, deep), contexts in merged.items():
            single = []
            for (context, n), members in contexts.items():
                if len(members) > 1 or sizes_[members[0]] > 1:
                    whole = min(n, len(context) - window + 1)
                    tell(members, deep, [(0, n)], [(0, whole)] * (whole > 0))
                    members = []
                single.append((members, context, n))
            if len(single) > 1 and any(m for m, _, _ in single):
                lots.setdefault(deep, []).extend(single)
                sizes[deep] = sizes.get(deep, 0) + sum(len(c) for _, c, _ in single)
                if sizes[deep] >= SORT_LOT:
                    sort_lot(deep)
        for deep in list(lots):
            sort_lot(deep)
        tidy()
        at = pa.array(told[0], pa.int64())
        return pa.table({
            **{c: group.column(c).take(at) for c in ("block", "rows", "places")},
            "starts": pa.array(told[1], pa.list_(pa.int64())), "stops": pa.array(told[2], pa.list_(pa.int64())), "long": pa.array(told[3], pa.bool_()),
        })

    def remove(part: pa.Table, spans: pa.Table) -> pa.Table:
        row, start, stop, long = _places(spans)
        by = np.argsort(row, kind="stable")
        row, start, stop, long = row[by], start[by], stop[by], long[by]
        out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "spans": [], "n_repeated": []}
        for own_row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            a = b = ()
            n_repeated = 0
            first, last = np.searchsorted(row, own_row), np.searchsorted(row, own_row, "right")
            if first < last:
                n_repeated = int(covered(start[first:last], stop[first:last], len(data)).sum())
                deep = long[first:last]
                a, b = (x.tolist() for x in runs(covered(start[first:last][deep], stop[first:last][deep], len(data))))
            kept = b"".join(data[x:y] for x, y in zip([0, *b], [*a, len(data)])) if a else data
            out["kept"].append(kept)
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept))
            out["spans"].append([{"start": x, "stop": y} for x, y in zip(a, b)])
            out["n_repeated"].append(n_repeated)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        texts = [x.decode("utf-8", "ignore") for x in out["kept"]]
        return pa.table({"doc_id": part.column("doc_id"), "kept_text": pa.array(texts, pa.string()), "rest": part.column("rest"), "kept": pa.array(out["kept"], pa.binary()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "spans": pa.array(out["spans"], spans_type), "n_repeated": pa.array(out["n_repeated"], pa.int64())})

    contexts = table.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(contexts_of, CONTEXT)
    spans = contexts.groupBy("bucket").applyInArrow(repeats_of, "block bigint, rows array<bigint>, places array<bigint>, starts array<bigint>, stops array<bigint>, long boolean")
    return table.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, f"doc_id bigint, kept_text string, rest {table.schema['rest'].dataType.simpleString()}, {RESULT}")
