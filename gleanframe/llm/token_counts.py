"""Token counts of whole texts: huge documents are encoded in overlapping chunks that are spliced again.

Nulls count as empty (0 tokens), a null id is kept, an empty table gives an empty result, repeated
rows are counted each. Very long texts are encoded chunk by chunk; a chunk grows only where its
tokens and those of the next one don't meet. Only the id and the text are read, so clashing names of
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .common import id_and_text, tidily

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, n_chunks int, overlap int"


def _spans(tok: bpe.BpeIds, text: str, start: int, stop: int) -> np.ndarray:
    """Begin in text, end and id of each token that the library makes of text[start:stop]."""
    found = tok.whole.encode(text[start:stop], add_special_tokens=False)
    out = np.empty((len(found.ids), 3), np.int64)
    out[:, :2] = np.array(found.offsets, np.int64).reshape(-1, 2) + start
    out[:, 2] = found.ids
    return out


def _begun(spans: np.ndarray) -> np.ndarray:
    """Tokens that begin with a character: several tokens of one character share its place."""
    ends = np.concatenate(([-1], spans[:-1, 1]))
    return (spans[:, 0] < spans[:, 1]) & (ends <= spans[:, 0])


def aligned(left: np.ndarray, right: np.ndarray, begin: int, stop: int) -> tuple[int, int] | None:
    """Where the two encodings have the same token, as its number in each; begin and stop bound the places it may take.

    Such a token proves the splice. Of each encoding, any two neighbours within a word are a pair
    that merging leaves apart, and a sequence all of whose neighbours are such pairs is what merging
    yields. The left tokens up to the shared one and the right ones after it are such a sequence.
    Words end alike in both, as the pattern looks ahead one character and never back.
    """
    a = np.nonzero(_begun(left) & (left[:, 0] >= begin) & (left[:, 1] <= stop))[0]
    b = np.nonzero(_begun(right) & (right[:, 1] <= stop))[0]
    _, i, j = np.intersect1d(left[a, 0], right[b, 0], assume_unique=True, return_indices=True)
    same = np.nonzero(left[a[i], 2] == right[b[j], 2])[0]
    return (int(a[i[same[0]]]), int(b[j[same[0]]])) if len(same) else None


def spliced_count(tok: bpe.BpeIds, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """(tokens, chunks, widest overlap) of a text longer than a chunk.

    Each chunk reads on into the next one, which begins where one of its tokens does, and the two encodings are spliced after the first token
    that both have at the same place. It must not lie so near the left one's end that a special
    string of the tokenizer may have been cut there. Where no token fits, the left chunk reads on
    twice as far, up to the end of the text.
    """
    total, chunks, widest, start, counted = 0, 1, 0, 0, 0
    spans, stop = _spans(tok, text, 0, min(len(text), chunk + overlap)), min(len(text), chunk + overlap)
    while stop < len(text):
        begins = spans[_begun(spans) & (spans[:, 0] >= start + chunk), 0]
        begin, wide = int(begins[0]) if len(begins) else start + chunk, overlap
        end = min(len(text), begin + chunk + overlap)
        after = _spans(tok, text, begin, end)
        while (shared := aligned(spans, after, begin, stop - tok.guard)) is None and stop < len(text):
            wide *= 2
            stop = min(len(text), begin + wide)
            spans = _spans(tok, text, start, stop)
            if end < stop:
                end = stop
                after = _spans(tok, text, begin, end)
        widest = max(widest, wide)
        if shared is None:
            break
        total += shared[0] + 1 - counted
        spans, start, stop, counted, chunks = after, begin, end, shared[1] + 1, chunks + 1
    return total + len(spans) - counted, chunks, widest


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lower: bool = False, chunk_chars: int = 65_536, overlap_chars: int = 512) -> DataFrame:
    """One row per row of docs; one pass over the input, no shuffle. tokenizer: the path of a vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = bpe.load(tokenizer, lower)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if len(text) <= chunk_chars:
                    n = len(tok.ids(text)) >> 2, 1, 0
                else:
                    n = spliced_count(tok, text, chunk_chars, overlap_chars)
                rows.append((len(text.encode()), *n))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                ["doc_id", "n_bytes", "n_tokens", "n_chunks", "overlap"],
            )
        tok.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(tidily(run), SCHEMA)
