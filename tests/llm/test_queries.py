"""The registered queries on the smallest table, and the pipeline stage by stage."""

import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from gleanframe.llm import bpe, common, queries, simhash, toxicity
from gleanframe.llm.common import materialise

from .test_operators import repeated

DIR = "/root/testdata/sf0.001"
N = 200


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DIR)
    got = df.collect()
    assert len({r.doc_id for r in got}) == N
    if name in queries.oracle_sql():
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
        want = con.sql(queries.oracle_sql()[name])
        assert sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())


def pieces(rows):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def packed_whole(texts, rows, capacity=4096):
    """Every document's pieces as the library's ids give them, in sequences without gaps, nearly as few as can be."""
    whole = bpe.BpeIds(public_tokenizers.path("word_bpe_49k.json"), True).whole
    want = []
    for i, t in texts.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, k, a, len(part), zlib.crc32(array("I", part).tobytes())))
    assert pieces(rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        ends = [a + n for a, n in sorted(items)]
        assert [a for a, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, DIR), "test")
        rows = docs.collect()
        seen[name] = len({r.doc_id for r in rows})
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
            reader = toxicity.Reader(toxicity.CharModel(model.counts))
            assert {r.doc_id for r in rows} == {i for i, t in before.items() if model.score(model.evidence(reader.words(t))) < 0.7}
        if name == "exact_dedup":
            assert {r.doc_id for r in rows} == {max(i for i, t in before.items() if t == text) for text in set(before.values())}
        if name == "simhash_near_dedup":
            prints = {i: simhash.simhashes(simhash.shingle_hashes(t, 5), corpus_pipeline.FAMILIES) for i, t in before.items()}
            kept = {r.doc_id for r in rows}
            linked = {i: [j for j, q in prints.items() if (np.bitwise_count(p ^ q) <= 4).any()] for i, p in prints.items()}
            part = {i: i for i in prints}
            for _ in range(10):
                for i in prints:
                    part[i] = min(part[j] for j in linked[i])
            assert kept == set(part.values())
            # what is linked is alike, and of what is nearly the same nothing stays twice
            sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in before.items()}
            alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in before for j in before if i < j and sets[i] and sets[j]}
            assert all(v > 0.5 for (i, j), v in alike.items() if j in linked[i]) and all(j not in kept or i not in kept for (i, j), v in alike.items() if v >= 0.9)
        if name == "suffix_array_dedup":
            assert all(r.n_chars == len(r.text) for r in rows)
            want = {i: bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") for i, (b, gone) in zip(before, repeated(list(before.items()), 200))}
            assert {r.doc_id: r.text for r in rows} == want
        if name == "best_fit_packing":
            packed_whole(before, rows)
    # run() is these stages one after the other; it leaves nothing but its result
    before_run = common.made()
    again = corpus_pipeline.run(spark, DIR)
    assert common.made() == before_run + 1
    again = again.collect()
    assert pieces(again) == pieces(rows)
    packed_whole(before, again)
    assert seen["toxicity"] >= seen["exact_dedup"] >= seen["simhash_near_dedup"] == seen["suffix_array_dedup"] == seen["best_fit_packing"] > N * 0.6


def test_pipeline_takes_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same text", "en", "s", 9), (3, "same text", "en", "s", 9), (None, "no id", "en", "s", 5), (4, "same text", "de", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DIR), "test")
    # of the empty texts 2 stays, of the equal ones 4
    assert sorted(((r.doc_id, r.length) for r in docs.collect()), key=repr)[:2] == [(2, 1), (4, 3)] and docs.count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, DIR), "test")
    assert empty.count() == 0
