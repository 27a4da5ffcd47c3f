"""Best-fit packing of token sequences over classes of equally long pieces and of bins with equal room.

Nulls count as empty texts, which are one end token. An empty table gives an empty result; repeated
rows are packed each. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import id_and_text, materialise, tidily

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, home bigint, rank int, alike int"
SEATED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
#: Pieces that a task counts at a time, which bounds its memory.
LOT = 100_000


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit by falling length of so many items of each length, as rows (length, first, items, bin, per, offset).

    Items first to first + items of a length, counted from 0, go to the bins from `bin` on, `per` to each, from `offset`
    on. Equal items fill the tightest bin that has room for one as far as they can before they turn to the next,
    so bins of equal room are filled alike and at once. A row uses up a class of bins or ends a length, so there
    are some rows for each length, whatever the counts.

    A bit for each room that some open bin has: the tightest fit is the lowest bit from the item's length on.
    """
    rows: list[tuple] = []
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal mask
        if room and n:
            open_bins[room].append((first, n))
            mask |= 1 << room

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            if above := mask >> length:
                room = length + (above & -above).bit_length() - 1
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    mask ^= 1 << room
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            per = room // length
            # bins that take as many as they can, one that takes what is left, and those that stay as they are
            for k, each in ((min(n, left // per), per), (1, left % per if left < n * per else 0)):
                if k and each:
                    rows.append((length, done, k * each, first, each, capacity - room))
                    put(room - each * length, first, k)
                    first, n, done, left = first + k, n - k, done + k * each, left - k * each
            put(room, first, n)
    return np.array(rows, np.int64).reshape(-1, 6)


def seats(planned: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of items by length and number among the equally long ones."""
    bits = int(planned[:, 2].sum()).bit_length()
    order = np.argsort((planned[:, 0] << bits) + planned[:, 1])
    length, first, _, bin_, per, offset = planned[order].T
    at = np.searchsorted((length << bits) + first, (lengths << bits) + ranks, side="right") - 1
    by, place = np.divmod(ranks - first[at], per[at])
    return bin_[at] + by, offset[at] + place * lengths


def ranked(lengths: list[int]) -> tuple[list[int], Counter]:
    """Each item's number among the equally long ones, and how many there are of each length."""
    counts: Counter = Counter()
    ranks = []
    for n in lengths:
        ranks.append(counts[n])
        counts[n] += 1
    return ranks, counts


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the bins' fills: items by falling length, each into the fullest bin it fits."""
    if not lengths:
        return [], [], []
    ranks, counts = ranked(lengths)
    bins, offsets = seats(plan(counts, capacity), np.array(lengths, np.int64), np.array(ranks, np.int64))
    return bins.tolist(), offsets.tolist(), np.bincount(bins, lengths).astype(int).tolist()


def still_open(fills: list[int], most: int) -> list[bool]:
    """Which items stand for all that are alike: of each fill below `most`, the first."""
    seen: set[int] = set()
    return [f < most and f not in seen and not seen.add(f) for f in fills]


def pack(docs: DataFrame, tokenizer: str, lower: bool = True, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each scan partition encodes its texts and numbers its pieces among the equally long ones; of those, one
    carries their number. The numbers add up to at most `capacity` counts of the whole table, which are all
    that best fit needs: the result is that of best fit over all pieces, by falling length, in one place. Every
    bin with room is open to every piece, wherever its partition. The plan is of some rows for each length;
    a piece finds its row by its length and its number, for which a partition learns how many equally long
    pieces were in those before. Texts are read and encoded once and never shuffled.

    Ties: of equally long pieces the one read first is placed first. A very long text is cut into
    pieces, which are packed like any others.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, home = bpe.load(tokenizer, lower), TaskContext.get().partitionId() << 32
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal home, rows
            lengths = [r[3] for r in rows]
            ranks, counts = ranked(lengths)
            alike = [counts[n] if one else 0 for n, one in zip(lengths, still_open(lengths, capacity + 1))]
            cols = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, types)), pa.array([home] * len(rows), pa.int64()), pa.array(ranks, pa.int32()), pa.array(alike, pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "home", "rank", "alike"],
            )
            home, rows = home + 1, []
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tok.ids(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, k, at >> 2, len(part) >> 2, bpe.crc(part)))
            if len(rows) >= LOT:
                yield flush()
        if rows:
            yield flush()
        tok.forget()

    pieces = materialise(id_and_text(docs, id_col, text_col).mapInArrow(tidily(local), PIECES), "pieces")
    alike = pieces.where("alike > 0").select("home", "length", "alike")
    planned = plan({r.length: r.n for r in alike.groupBy("length").agg(F.sum("alike").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    earlier = alike.select("home", "length", F.coalesce(F.sum("alike").over(before), F.lit(0)).alias("earlier"))

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, offsets = seats(planned, batch.column(3).to_numpy(), batch.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(earlier, ["home", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank"))
    return numbered.mapInArrow(seated, SEATED)
