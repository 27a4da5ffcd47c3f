"""Sequential restatements of the training-data queries, one process with the libraries: prints one JSON line of seconds.

"""

import hashlib
import json
import os
import time
from array import array

import public_tokenizers
import pyarrow.parquet as pq

from gleanframe.llm.packing import best_fit

from .test_operators import classes, one_permutation, sim, words_left

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def documents():
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return [(i, x or "") for i, x in zip(t["doc_id"], t["text"])]


def op1():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [library.decode(library.encode(t)) for _, t in documents()]


def tokens(file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [t.encode(x, add_special_tokens=False).ids for _, x in documents()]


def op4():
    lengths = []
    for ids in tokens("word_bpe_49k.json"):
        n = len(array("I", ids).tobytes()) // 4 + 1
        lengths += [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
    return best_fit(lengths, 4096)


def op6():
    rows = sorted(documents(), reverse=True)
    return [(one_permutation(t), one_permutation(t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2])) for k, (_, t) in enumerate(rows)]


def op7():
    data = [t.encode() for _, t in documents()]
    seen, again = set(), set()
    for b in data:
        for k in range(len(b) - 399):
            h = hash(b[k : k + 400])
            (again if h in seen else seen).add(h)
    return sum(hash(b[k : k + 400]) in again for b in data for k in range(len(b) - 399))


def op8():
    keep = {}
    for i, t in documents():
        h = hashlib.sha256(t.encode()).digest()
        keep[h] = max(i, keep.get(h, i))
    return keep


def op10():
    prints = sorted({sim(t) for _, t in documents()})
    return classes(prints[:2000], 4), len(prints)


QUERIES = {
    "op1_sentencepiece": op1, "op4_pack": op4, "op5_substring_dedup": lambda: words_left([(i, t) for i, t in documents()]), "op6_fingerprints": op6, "op7_suffix_dedup": op7, "op8_exact_dedup": op8,
    "op9_token_counts": lambda: [len(x) for x in tokens("byte_bpe_50k.json")], "op10_simhash (pairs of 2,000 fingerprints only)": op10,
}


if __name__ == "__main__":
    seconds = {}
    for name, run in QUERIES.items():
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 1)
        print(name, seconds[name], flush=True)
    print(json.dumps({"metric": "sequential_time", "unit": "sec", "queries": seconds, "dir": DIR}))
