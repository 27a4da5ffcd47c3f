"""One-permutation MinHash fingerprints in Spark expressions. [native]

A null text counts as empty; its fingerprint is all zeros and is like another empty one only. Texts
of fewer words than a shingle are one shingle. Very long texts are arrays of one 8-byte hash per
word. Rows without id come last in the order of ids; rows with equal ids follow the digest of their
texts. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_GAPS = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that a range of ids holds, about; with more than MOST_RANGES such ranges they hold more.
RANGE_BYTES, MOST_RANGES = 8 << 20, 1 << 14
#: Hashed attempts to fill an empty bin before the exact choice among the bins that are not empty.
ATTEMPTS = 6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often it occurs inside lambdas."""
    return F.transform(F.array(value), use)[0]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int) -> Column:
    """Hash of each run of k words; of all words if they are fewer; none of no words."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))


def _densified(bins: Column, bits: int, empty: Column) -> Column:
    """Optimal densification: an empty bin takes the value of a bin chosen by a hash of its own number.

    Attempt t of bin i looks at bin hash(i, t) until one isn't empty; after ATTEMPTS it takes the bin
    j with the least hash(i, j), again uniform and the same for all documents with these bins.
    """
    k = 1 << bits
    full = F.filter(F.transform(bins, lambda x, i: F.when(~empty(x), i)), lambda i: i.isNotNull())

    def fill(x: Column, i: Column, full: Column) -> Column:
        def at(t):
            return F.element_at(bins, F.shiftrightunsigned(F.xxhash64(i, F.lit(t)), 64 - bits).cast("int") + 1)

        tries = [F.when(~empty(at(t)), at(t)) for t in range(ATTEMPTS)]
        exact = F.array_min(F.transform(full, lambda j: F.struct(F.xxhash64(i, j, F.lit(-1)).alias("h"), j.alias("j"))))["j"]
        return F.when(~empty(x), x).otherwise(F.coalesce(*tries, F.element_at(bins, exact + 1)))

    return let(full, lambda full: F.transform(bins, lambda x, i: fill(x, i, full)))


def fingerprint(text: Column, k: int = 5, bits: int = 7) -> Column:
    """2**bits bins of 8 bits each, packed into 2**bits / 8 longs.

    Each shingle is hashed once: the top bits name its bin, the rest is its value there. One largest
    value per bin is added as a mark, so that after sorting the first value of every bin is its
    minimum, or the mark where the bin is empty.
    """
    n, low = 1 << bits, 64 - bits
    mark = (1 << low) - 1
    marks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.shiftleft((i - n // 2).cast("bigint"), low).bitwiseOR(F.lit(mark)))

    def empty(x):
        return x.bitwiseAND(F.lit(mark)) == F.lit(mark)

    def first_of_bins(values):
        return F.filter(values, lambda x, i: (i == 0) | (F.shiftright(x, low) != F.shiftright(F.get(values, F.greatest(i - 1, F.lit(0))), low)))

    def packed(bins):
        def word(w):
            out = F.lit(0).cast("bigint")
            for b in range(8):
                out = out.bitwiseOR(F.shiftleft(F.element_at(bins, w * 8 + b + 1).bitwiseAND(F.lit(255)).cast("bigint"), 8 * (7 - b)))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(n // 8 - 1)), word)

    def of(hashes):
        sorted_values = F.sort_array(F.concat(hashes, marks))
        filled = let(let(sorted_values, first_of_bins), lambda bins: _densified(bins, bits, empty))
        return F.when(F.size(hashes) == 0, F.array_repeat(F.lit(0).cast("bigint"), n // 8)).otherwise(let(filled, packed))

    return let(let(word_hashes(text), lambda w: shingle_hashes(w, k)), of)


def hex_digits(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, bits: int = 7) -> Column:
    """Estimated Jaccard similarity: the share of equal bytes, less what chance gives 8-bit values."""

    def equal_bytes(x, y):
        # the lowest bit of each byte gathers the byte's bits
        z = x.bitwiseXOR(y)
        z = let(z, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 4)))
        z = let(z, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2)))
        z = let(z, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))
        return 8 - F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    same = F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda s, x: s + x)
    chance = 1 / 256
    none_a, none_b = F.forall(a, lambda x: x == 0), F.forall(b, lambda x: x == 0)
    estimate = F.greatest((same / F.lit(float(1 << bits)) - chance) / (1 - chance), F.lit(0.0))
    return F.when(none_a | none_b, (none_a & none_b).cast("double")).otherwise(estimate)


def with_next(docs: DataFrame, cols: list[str], id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """docs with next_<col> of the following row by descending id (after the last: of the first).

    In a table without any id the last row has none: its next_ columns are null.

    Rows are dealt into ranges of ids, as many as the texts' bytes ask for, whose bounds are ids that occur (quantiles of one combined
    aggregate). The first row of a range is also sent to the range before it, as its tail, so every
    row finds its follower inside one window and each row is shuffled once. No window is global.
    """
    if not ranges:
        size = docs.agg(F.sum(sum((F.octet_length(c) for c in cols if docs.schema[c].dataType.typeName() == "string"), F.lit(0)).cast("bigint"))).first()[0] or 0
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    share = [k / ranges for k in range(1, ranges)] + [1.0]
    bounds = docs.agg(F.percentile_approx(id_col, F.array(*map(F.lit, share)), max(10_000, 8 * ranges)).alias("b"), F.max(id_col).alias("top")).first()
    known = sorted({*(bounds["b"] or []), *([bounds["top"]] if bounds["top"] is not None else [])})
    if not known:
        # no ids at all: one range, in the order of the digests
        known = [0]
    step = max(1, int(len(known) ** 0.5))
    coarse = [known[i : i + step] for i in range(0, len(known), step)]
    first = F.array(*[F.lit(c[-1]).cast("bigint") for c in coarse])
    fine = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in c]) for c in coarse])

    def below(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda v: v < x))

    def place(x: Column) -> Column:
        """The number of bounds below x, found over the square root of their number twice."""
        return let(below(first, x), lambda c: c * step + F.coalesce(below(F.get(fine, c), x), F.lit(0)))

    last = len(known) - 1
    x = F.col(id_col)
    at = F.when(x.isNull(), F.lit(0)).otherwise(place(x))
    # the first row of range r follows the last row of range r + 1; the first of all follows the last of all
    tail = F.when(F.array_contains(F.get(fine, F.floor(at / step).cast("int")), x), F.when(at == last, F.lit(-1)).otherwise(at + 1))
    rows = docs.select("*", at.alias("_at")).select(
        "*", F.explode(F.filter(F.array(F.struct(F.col("_at").alias("r"), F.lit(0).alias("guest")), F.struct(tail.alias("r"), F.lit(1).alias("guest"))), lambda s: s["r"].isNotNull())).alias("_to")
    )
    r = F.when(F.col("_to.r") == -1, F.lit(0)).otherwise(F.col("_to.r"))
    # of range 0, the guest is the highest id: it must come last
    order = Window.partitionBy("_r").orderBy(F.col("_guest"), F.col(id_col).desc_nulls_last(), F.col("_tie"))
    rows = rows.select(*docs.columns, r.alias("_r"), F.col("_to.guest").alias("_guest"), F.xxhash64(*cols).alias("_tie"))
    out = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols]).where("_guest = 0")
    return out.select(*docs.columns, *[f"next_{c}" for c in cols])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 7) -> DataFrame:
    """(doc_id, fingerprint): the packed bins of every whole text, as hex digits."""
    return docs.select(F.col(id_col).alias("doc_id"), hex_digits(fingerprint(F.coalesce(F.col(text_col), F.lit("")), shingle, bits)).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 7) -> DataFrame:
    """Fingerprints of every text and of its edit: its last half replaced by the head of the next text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("print", fingerprint(F.col("text"), shingle, bits))
    pairs = with_next(own, ["text", "print"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)).alias("edited"), "print", "next_print")
    edited = edited.select("*", fingerprint(F.col("edited"), shingle, bits).alias("edited_print"))
    return edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hex_digits(F.col("print")).alias("fingerprint"), hex_digits(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print"), bits).alias("near_edited"), F.coalesce(likeness(F.col("print"), F.col("next_print"), bits), F.lit(0.0)).alias("near_next"),
    )
