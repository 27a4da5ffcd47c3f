"""SimHash near-dedup: 64-bit fingerprints joined within a Hamming distance by vantage-point trees.

A null text counts as empty; a text without words has fingerprint zero and is linked like any
other. Texts of fewer words than a shingle are one shingle; of very long ones the shingles are hashed
one after the other and summed in lots. A bit that exactly half the shingles set is 0. Rows with
equal ids or texts are rows like any others; a null id is never a component's least. An empty table
gives an empty result. Only the id and the text are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mixed
from .common import connected_components, id_and_text, materialise, tidily

#: Cells that the top of a tree deals fingerprints into: at least so many, one for each CELL_ROWS (or fewer, see
#: links) fingerprints, and at most so many, which bounds the trees that are sent to every task.
CELLS, MOST_CELLS = 64, 16_384
#: Distinct fingerprints for each cell that the tops of the trees are grown from. Every fingerprint is then placed and searched.
SAMPLE_PER_CELL = 64
#: Rows of a cell that one task holds at a time; larger cells are cut into blocks of members times blocks of queries.
CELL_ROWS = 40_000
MEMBER, QUERY, EITHER = 0, 1, 2
#: Pairs that are compared outright instead of splitting a node further.
LEAF_PAIRS = 1 << 21

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the shingles, repeats included; of the whole sequence if its words are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, seed)] if words else [], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")


_ONES = np.uint64(0x0101010101010101)
_STEP = 0x9E3779B97F4A7C15


def simhashes(hashes: np.ndarray, families: int = 1) -> np.ndarray:
    """A fingerprint for each family: bit b is set if it is set in over half the hashes. The first family takes the
    hashes as they are, the others scramble them, each in its own way."""
    n = len(hashes)
    if not n:
        return np.zeros(families, np.uint64)
    counts = np.zeros((families, 64), np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        rows = np.stack([part, *[mixed(part + np.uint64(_STEP * k & (1 << 64) - 1)) for k in range(1, families)]])
        # eight counters of a byte each in a number: up to 255 hashes are added before the counters are read
        lots = np.arange(0, len(part), 255)
        for bit in range(8):
            sums = np.add.reduceat((rows >> np.uint64(bit)) & _ONES, lots, axis=1)
            counts[:, bit::8] += sums.view(np.uint8).reshape(families, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").reshape(families)


def simhash(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The first family's fingerprint; zero of no words."""
    return int(simhashes(shingle_hashes(text, shingle, seed))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, families: int = 1) -> DataFrame:
    """(doc_id, fp, more, text_key): fp is the unsigned fingerprint's bit pattern as a signed long, more has those of
    further families; text_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.stack([simhashes(shingle_hashes(t, shingle), families) for t in batch.column(1).to_pylist()]).view(np.int64)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * (families - 1), pa.int32()), pa.array(fps[:, 1:].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps[:, 0].copy(), pa.int64()), more, batch.column(2)], ["doc_id", "fp", "more", "text_key"])

    keyed = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(tidily(run), "doc_id bigint, fp bigint, more array<bigint>, text_key bigint")


class Tree:
    """The top of a vantage-point tree over some of the bits.

    A node deals values into shells of equal Hamming distance from its vantage point. Two values
    within r of each other have distances that differ by r at most (the triangle inequality), so a
    query visits only the shells within r of its own.
    """

    def __init__(self, mask: int, radius: int, sample: np.ndarray, cells: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.cells = 0
        rng = np.random.default_rng(7)
        self.root = self._grow(np.unique(sample & self.mask), cells, rng)

    def _leaf(self):
        self.cells += 1
        return self.cells - 1

    def _grow(self, values: np.ndarray, cells: int, rng):
        if cells < 4 or len(values) < 64:
            return self._leaf()
        # of a few candidates, the vantage point whose shells separate best
        picks = values[rng.integers(0, len(values), 8)]
        spread = [np.bincount(np.bitwise_count(values ^ p), minlength=65) for p in picks]
        best = int(np.argmin([(s.astype(float) ** 2).sum() for s in spread]))
        d = np.bitwise_count(values ^ picks[best])
        # neighbouring shells join until each has an eighth of the values
        shells, begun, held = [], 0, 0
        for k in range(65):
            held += int(spread[best][k])
            if held * 8 >= len(values) or k == 64:
                shells.append((begun, k))
                begun, held = k + 1, 0
        children = [self._grow(values[(d >= a) & (d <= b)], cells // len(shells), rng) for a, b in shells]
        return picks[best], shells, children

    def route(self, values: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each value's own cell, or with wide of every cell that can hold values within the radius."""
        rows, cells = [], []
        reach = self.radius if wide else 0

        def down(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if not isinstance(node, tuple):
                rows.append(at)
                cells.append(np.full(len(at), node))
                return
            vantage, shells, children = node
            d = np.bitwise_count((values[at] & self.mask) ^ vantage).astype(np.int64)
            for (a, b), child in zip(shells, children):
                down(child, at[(d + reach >= a) & (d - reach <= b)])

        down(self.root, np.arange(len(values)))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over whole arrays of links: the larger root hangs under the smaller until all agree."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        keep = a != b
        a, b = a[keep], b[keep]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def join_cell(members: np.ndarray, queries: np.ndarray, mask: np.uint64, radius: int, limit: int, parent: np.ndarray, m_at: np.ndarray, q_at: np.ndarray, rng) -> None:
    """Unite all (member, query) within `limit` whose masked parts are within `radius`, by a vantage-point recursion."""
    stack = [(np.arange(len(members)), np.arange(len(queries)), 0)]
    while stack:
        m, q, depth = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) * len(q) <= LEAF_PAIRS or len(m) < 32 or depth >= 12:
            step = max(1, LEAF_PAIRS // len(m))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                near = np.bitwise_count(members[m][None, :] ^ queries[part][:, None]) <= limit
                i, j = np.nonzero(near)
                _unite(parent, m_at[m[j]], q_at[part[i]])
            continue
        vantage = members[m[rng.integers(0, len(m))]] & mask
        dm = np.bitwise_count((members[m] & mask) ^ vantage).astype(np.int64)
        dq = np.bitwise_count((queries[q] & mask) ^ vantage).astype(np.int64)
        for shell in np.unique(dm):
            stack.append((m[dm == shell], q[np.abs(dq - shell) <= radius], depth + 1))


def parts_of(limit: int) -> list[tuple[int, int]]:
    """(mask, radius) of `limit` parts of the 64 bits (two at least).

    Fingerprints that differ in at most `limit` bits differ in at most the radius within some part,
    as there are too few bits to exceed all radii: the radii and the number of parts add up to more
    than `limit`. A part with a radius has more bits, so that its tree prunes more.
    """
    n = max(2, limit)
    radii = [(limit - n + 1 + k) // n if limit else 0 for k in range(n)][::-1]
    extra = [8 * (r > 0) for r in radii]
    if sum(extra) > 32 or sum(extra) in (0, 8 * n):
        extra = [0] * n
    base, rest = divmod(64 - sum(extra), n)
    out, at = [], 0
    for k, r in enumerate(radii):
        width = base + extra[k] + (k < rest)
        out.append((((1 << width) - 1) << at, r))
        at += width
    return out


def links(prints: DataFrame, limit: int = 4, seed: int = 7) -> DataFrame:
    """(u, v) over nodes: a spanning forest of all pairs of rows of a family whose fingerprints are within `limit` bits.

    prints: (node, family, fp), distinct; or one column fp, which is then the node. There is a tree for
    each part of the bits, with that part's radius. The tops of the trees come from a sample that
    grows with the input, up to MOST_CELLS; every fingerprint goes to its own cell as a member and, as
    a query, to each cell at a boundary within the radius. Cells are as many as the fingerprints of a
    family ask for, so a cell's rows stay alike. A task compares a cell's members and queries and
    sends on a forest of what it found, one link a row at most and never all pairs of a group.
    """
    spark = prints.sparkSession
    if "node" not in prints.columns:
        prints = prints.select(F.col("fp").alias("node"), F.lit(0).alias("family"), "fp")
    n = prints.where("family = 0").count()
    many = {r: min(MOST_CELLS, max(CELLS, n // (CELL_ROWS if r else CELL_ROWS // 5))) for r in (0, 1)}
    share = min(1.0, SAMPLE_PER_CELL * max(many.values()) / max(1, n))
    sample = prints.where((F.col("family") == 0) & (F.pmod(F.xxhash64("fp", F.lit(seed)), F.lit(1 << 20)) <= int(share * (1 << 20))))
    sample = np.sort(np.array([r[0] for r in sample.select("fp").collect()], dtype=np.int64).view(np.uint64))
    trees = [Tree(mask, radius, sample, many[min(1, radius)]) for mask, radius in parts_of(limit)]

    def place(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, families, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            values = fps.view(np.uint64)
            for t, tree in enumerate(trees):
                if wide and not tree.radius:
                    continue  # a query's only cell is its own
                rows, cells = tree.route(values, wide)
                # the families' cells are numbered apart
                cells = cells + families[rows].astype(np.int64) * tree.cells
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t), pa.int32()), pa.array(cells, pa.int32()), pa.array(nodes[rows], pa.int64()), pa.array(fps[rows], pa.int64())], ["tree", "cell", "node", "fp"])

    schema = "tree int, cell int, node bigint, fp bigint"
    prints = prints.select("node", "family", "fp")
    homes = prints.mapInArrow(lambda b: place(b, False), schema)
    visits = prints.mapInArrow(lambda b: place(b, True), schema)
    # rows per cell: as many counts as there are cells
    sizes = {(r[0], r[1]): r[2] for r in homes.groupBy("tree", "cell").count().collect()}
    seen = {(r[0], r[1]): r[2] for r in visits.groupBy("tree", "cell").count().collect()}
    plan = []
    for (t, c), members in sorted(sizes.items()):
        m, q = -(-members // CELL_ROWS), -(-seen.get((t, c), members) // (4 * CELL_ROWS))
        plan.append((t, c, m, q, not trees[t].radius, not trees[t].radius and m == q == 1))
    if not plan:
        return spark.createDataFrame([], "u bigint, v bigint")
    cells = spark.createDataFrame(plan, "tree int, cell int, m_blocks int, q_blocks int, own boolean, single boolean")
    salt = F.xxhash64("fp", F.lit(seed))
    # in a cell that is its queries' only one and isn't cut, a row is member and query at once
    at_home = homes.join(F.broadcast(cells), ["tree", "cell"])
    members = at_home.select(
        "tree", "cell", F.pmod(salt, "m_blocks").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
        F.when(F.col("single"), F.lit(EITHER)).otherwise(F.lit(MEMBER)).alias("role"), "node", "fp",
    )
    asking = at_home.where("own and not single").unionByName(visits.join(F.broadcast(cells), ["tree", "cell"]))
    queries = asking.select("tree", "cell", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"), F.pmod(salt, "q_blocks").cast("int").alias("q"), F.lit(QUERY).alias("role"), "node", "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        values, role = group["fp"].to_numpy().view(np.uint64), group["role"].to_numpy()
        member, query = role != QUERY, role != MEMBER
        nodes, at = np.unique(group["node"].to_numpy(), return_inverse=True)
        parent = np.arange(len(nodes))
        tree = trees[int(group["tree"].iloc[0])]
        join_cell(values[member], values[query], tree.mask, tree.radius, limit, parent, at[member], at[query], np.random.default_rng(seed))
        roots = _find(parent, np.arange(len(nodes)))
        hang = roots != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[hang], "v": nodes[roots[hang]]})

    return members.unionByName(queries).groupBy("tree", "cell", "m", "q").applyInPandas(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = 4, families: int = 1) -> DataFrame:
    """(doc_id, fp, text_key, component_id): component_id is the least id that can be reached over links.

    With several families of hashes, documents link if they do in any of them: one fingerprint of 64
    bits is a coarse measure of how alike two texts are, and each further family is another draw.

    Equal fingerprints are joined first and count once in everything that follows; only linked ones
    meet in components. A fingerprint with more than 1/1024 of all rows is one of fewer than 1024,
    which are broadcast; the rows of all others meet their component in a sort-merge join.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, families), "prints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    prints = classes.select(F.col("fp").alias("node"), F.lit(0).alias("family"), "fp")
    if families > 1:
        others = rows.select(F.col("fp").alias("node"), F.posexplode("more").alias("family", "fp"))
        prints = materialise(prints.unionByName(others.select("node", F.col("family") + 1, "fp").toDF("node", "family", "fp").distinct()), "families")
    parts = connected_components(links(prints, limit))
    linked = materialise(classes.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp").select("fp", "least", "component"), "linked")
    # written first, so that both sides of the join come straight from exchanges and a large component's rows can be split
    least = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    moved = linked.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id")
    known = materialise(classes.join(moved.hint("merge"), "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "known")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") > max(1, total // 1024)).select("fp", F.col("component_id").alias("hot_id"))
    marked = rows.join(F.broadcast(hot), "fp", "left").withColumn("key", F.when(F.col("hot_id").isNull(), F.col("fp").cast("string")).otherwise(F.concat(F.lit("hot "), F.col("doc_id").cast("string"))))
    cold = known.select(F.col("fp").cast("string").alias("key"), "component_id").hint("merge")
    return marked.join(cold, "key", "left").select("doc_id", "fp", "text_key", F.coalesce("hot_id", "component_id").alias("component_id"))
