"""Near-duplicates of 64-bit hashes by greedy leaders, as rounds over a graph of near pairs."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import checkpointed, with_row_number

#: Rows up to which all pairs of distinct hashes are compared in one broadcast join.
SMALL = 20_000
#: Hashes of a block, where blocks are compared.
BLOCK = 8192
#: Rows that one task reads in rank order, as leaders are defined.
AT_ONCE = 20_000
#: Near pairs up to which leaders are found in one task.
SMALL_EDGES = 500_000
BITS = 64


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_hash(h: Column) -> Column:
    """16 hex digits of a signed long."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def near_pairs(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b) with a < b of all distinct values of column hash within `distance` bits.

    Few hashes are compared pair by pair against a broadcast copy, of at most SMALL rows. Otherwise
    multi-index hashing finds candidates: in one of distance // 2 + 1 bands two near hashes differ in
    a bit at most, so each is looked up under its bands' values and their one-bit neighbours. Where
    the bands are too narrow to tell so many hashes apart, blocks of hashes are compared as arrays.
    """
    h = hashes.select("hash").where("hash is not null").distinct()
    n = h.count()
    if n <= SMALL:
        other = F.broadcast(h.select(F.col("hash").alias("b")))
        return h.select(F.col("hash").alias("a")).join(other, (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance))
    bands = distance // 2 + 1
    # candidates of a hash over all bands against the hashes there are
    if bands * (BITS // bands + 1) * 16 > 1 << (BITS // bands):
        return _near_by_blocks(h, distance, -(-n // BLOCK))
    edges = [BITS * k // bands for k in range(bands + 1)]

    def band(k: int) -> Column:
        width = edges[k + 1] - edges[k]
        return F.shiftrightunsigned("hash", edges[k]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    own = h.select("hash", F.posexplode(F.array(*[band(k) for k in range(bands)])).alias("band", "value"))
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(1 << j if j < 63 else -(1 << 63)).cast("bigint") for j in range(edges[k + 1] - edges[k])]) for k in range(bands)])
    around = own.withColumn("flip", F.explode(F.get(flips, F.col("band")))).select("band", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), F.col("hash").alias("b"))
    found = own.withColumnRenamed("hash", "a").join(around, ["band", "value"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance))
    return found.select("a", "b").distinct()


def _near_by_blocks(h: DataFrame, distance: int, blocks: int) -> DataFrame:
    """The same by comparing every block of about BLOCK hashes with every other one, once."""
    dealt = h.withColumn("b", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))
    left = dealt.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("j"), "hash")
    right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), "hash")

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        p, q = x["hash"].to_numpy(), y["hash"].to_numpy()
        found = []
        for at in range(0, len(p), 512):  # a part of the block at a time bounds the matrix
            part = p[at : at + 512]
            close = np.bitwise_count((part[:, None] ^ q[None, :]).view(np.uint64)) <= distance
            i, j = np.nonzero(close)
            found.append(np.stack((part[i], q[j])))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs = np.sort(pairs[:, pairs[0] != pairs[1]], axis=0)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]}).drop_duplicates()

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(near, "a bigint, b bigint")


def greedy_leaders(images: DataFrame, distance: int) -> DataFrame:
    """Adds is_duplicate and duplicate_of to images(ord, rel_path, score, hash, passed).

    Rows that passed are ranked by falling score, then ord. Read in that order, a row near an earlier
    representative is its duplicate (of the earliest such one), any other becomes a representative.
    This is the first maximal independent set in rank order, so it can be found in rounds: a row with
    a representative before it is a duplicate; a row whose earlier neighbours all are duplicates is
    a representative. Equal hashes count once, by their best row, and the others follow it.
    """
    none = images.withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("string")})
    if distance < 0:
        return none
    ranked = images.where("passed and hash is not null").select("ord", "rel_path", "score", "hash")
    if ranked.count() <= AT_ONCE:
        return _with_duplicates(images, _read_in_order(ranked, distance))
    ranked = checkpointed(with_row_number(ranked, [F.col("score").desc(), "ord"], "rank"))
    heads = ranked.groupBy("hash").agg(F.min("rank").alias("rank"))
    pairs = near_pairs(heads, distance)
    a, b = heads.select(F.col("hash").alias("a"), F.col("rank").alias("ra")), heads.select(F.col("hash").alias("b"), F.col("rank").alias("rb"))
    edges = pairs.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi"))
    edges = checkpointed(edges)
    leader = _leaders_at_once(edges) if edges.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES else _leaders_in_rounds(heads, edges)
    # a representative leads its equals; a duplicate's equals have its leader
    heads = heads.join(leader, F.col("rank") == F.col("hi"), "left").select("hash", F.coalesce("leader", "rank").alias("leader"))
    names = ranked.select(F.col("rank").alias("leader"), F.col("rel_path").alias("duplicate_of"))
    return _with_duplicates(images, ranked.join(heads, "hash").where(F.col("rank") != F.col("leader")).join(names, "leader").select("rel_path", "duplicate_of"))


def _with_duplicates(images: DataFrame, found: DataFrame) -> DataFrame:
    marked = images.join(found, "rel_path", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())
    return marked.select(*images.columns, "is_duplicate", "duplicate_of")


def _read_in_order(ranked: DataFrame, distance: int) -> DataFrame:
    """(rel_path, duplicate_of) of at most AT_ONCE rows, read in rank order by one task."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "ord"], ascending=[False, True])
        bits, names = part["hash"].to_numpy().view(np.uint64), part["rel_path"].tolist()
        reps, order, out = np.zeros(len(part), np.uint64), [], []
        for k, h in enumerate(bits):
            near = np.nonzero(np.bitwise_count(reps[: len(order)] ^ h) <= distance)[0]
            if len(near):
                out.append((names[k], names[order[near[0]]]))
            else:
                reps[len(order)] = h
                order.append(k)
        return pd.DataFrame(out, columns=["rel_path", "duplicate_of"], dtype=object)

    return ranked.groupBy(F.lit(0).alias("_all")).applyInPandas(walk, "rel_path string, duplicate_of string")


def _leaders_at_once(edges: DataFrame) -> DataFrame:
    """(hi, leader) of the duplicates among at most SMALL_EDGES near pairs, in one task."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["hi", "lo"])
        leader: dict[int, int] = {}
        for lo, hi in zip(part["lo"].tolist(), part["hi"].tolist()):
            if hi not in leader and lo not in leader:
                leader[hi] = lo
        return pd.DataFrame({"hi": list(leader), "leader": list(leader.values())}, dtype="int64")

    return edges.groupBy(F.lit(0).alias("_all")).applyInPandas(walk, "hi bigint, leader bigint")


def _leaders_in_rounds(heads: DataFrame, edges: DataFrame) -> DataFrame:
    """(hi, leader) of the duplicates: each round settles all rows whose earlier neighbours allow it."""
    state = checkpointed(heads.select("rank", F.lit(None).cast("string").alias("state")))
    while True:
        # what the earlier neighbours of each open row are: -> has a representative, has an open one
        open_rows = state.where("state is null").select("rank")
        seen = edges.join(open_rows, edges["hi"] == open_rows["rank"], "left_semi").join(state.withColumnRenamed("rank", "lo"), "lo")
        told = seen.groupBy(F.col("hi").alias("rank")).agg(F.max((F.coalesce("state", F.lit("")) == "rep").cast("int")).alias("rep"), F.max(F.col("state").isNull().cast("int")).alias("open"))
        state = checkpointed(
            state.join(told, "rank", "left").select(
                "rank",
                F.coalesce("state", F.when(F.col("rep") == 1, F.lit("dup")).when(F.coalesce("open", F.lit(0)) == 0, F.lit("rep"))).alias("state"),
            )
        )
        if state.where("state is null").limit(1).count() == 0:
            break
    reps = state.where("state = 'rep'").select(F.col("rank").alias("lo"))
    return edges.join(reps, "lo", "left_semi").groupBy("hi").agg(F.min("lo").alias("leader"))


def with_groups(images: DataFrame) -> DataFrame:
    """Adds similar_group (from 1 by first appearance), group_size and is_representative."""
    rows = images.withColumn("_head", F.coalesce("duplicate_of", "rel_path"))
    groups = rows.groupBy("_head").agg(F.count("*").alias("group_size"), F.min("ord").alias("_first"))
    groups = with_row_number(groups, ["_first"], "similar_group", 1)
    joined = rows.join(groups.drop("_first"), "_head")
    return joined.withColumn("is_representative", ~F.col("is_duplicate")).drop("_head")


def multi_member_groups(grouped: DataFrame) -> DataFrame:
    """How many groups have more than one member."""
    return grouped.groupBy("similar_group").agg(F.max("group_size").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("similar_clusters"))
