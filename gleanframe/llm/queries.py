"""The queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .exact_dedup import DigestIndex, exact_dedup
from .minhash import ATTEMPTS, edited_fingerprints
from .packing import pack
from . import cotrain, rlz_dedup, suffix_dedup, toxicity, wfst
from .simhash import near_duplicates
from .token_counts import count_tokens
from .xxh64_sql import of_int, of_long, xxh64


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), DigestIndex(spark, scratch_path(spark, "index")))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = wfst.encode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = cotrain.score(docs, model)
    return scored.select("doc_id", cotrain.held_out("doc_id").alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rlz_dedup.dedup_spans(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_spans(_documents(spark, sf_dir), seek=200)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(_documents(spark, sf_dir))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS words
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM docs WHERE len(ws) >= 13)),
firsts AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words),
gone AS (
  SELECT DISTINCT doc_id, k + j AS p
  FROM (SELECT doc_id, k, unnest(range(13)) AS j FROM windows JOIN firsts USING (words) WHERE least < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
left_over AS (
  SELECT doc_id, count(*) AS n_left, string_agg(w, ' ' ORDER BY p) AS kept
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_left, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""


def _op7_sql() -> str:
    """Strings of bytes are compared by polynomial hashes modulo the prime 2**61 - 1, from running sums and inverse powers."""
    prime, base = (1 << 61) - 1, 0x1D3F5A7C9E1B2D4F

    def powers(b: int) -> str:
        squares = [pow(b, 1 << k, prime) for k in range(24)]
        bits = ", ".join(f"CASE WHEN p & {1 << k} > 0 THEN {x}::HUGEINT ELSE 1::HUGEINT END" for k, x in enumerate(squares))
        return f"list_reduce([{bits}], lambda a, x: a * x % {prime}::HUGEINT)"

    def gone(n: int) -> str:
        return f"""
starts_{n} AS (SELECT doc_id, p, (lead(s, {n - 1}) OVER w - s + term) % {prime}::HUGEINT * back % {prime}::HUGEINT AS h FROM sums JOIN powers USING (p) WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
again_{n} AS (SELECT h FROM starts_{n} WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
gone_{n} AS (
  SELECT doc_id, p, max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM (SELECT doc_id, p, coalesce((h IN (SELECT h FROM again_{n}))::INTEGER, 0) AS again FROM starts_{n}))"""

    return f"""
WITH base AS (SELECT doc_id, regexp_extract_all(hex(coalesce(text, '')), '..') AS xs FROM documents),
bytes AS (SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS p FROM base),
powers AS (SELECT p, {powers(base)} AS power, {powers(pow(base, -1, prime))} AS back FROM (SELECT unnest(range((SELECT max(len(xs)) FROM base))) AS p)),
terms AS (SELECT doc_id, p, (('0x' || x)::HUGEINT + 1) * power AS term FROM bytes JOIN powers USING (p)),
sums AS (SELECT doc_id, p, term, sum(term) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM terms),{gone(400)},{gone(200)},
marked AS (SELECT doc_id, p, x, a.gone, b.gone AS short, lag(a.gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM bytes JOIN gone_400 a USING (doc_id, p) JOIN gone_200 b USING (doc_id, p)),
found AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept, count(*) FILTER (short) AS n_repeated
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(xs)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_repeated, 0) AS n_repeated
FROM base LEFT JOIN found USING (doc_id)
"""


def _of_ints(*values: str) -> str:
    out = "42::UBIGINT"
    for v in values:
        out = of_int(out, v)
    return out


# a bin takes its own value, or that of the first of its attempts that has one, or of the bin with the least hash
OP6_SQL = rf"""
WITH base AS (
  SELECT doc_id, text, n, n // 2 AS half, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text
  FROM (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents)),
edits AS (SELECT doc_id, text, n, next_text, substr(text, 1, n - half) || substr(next_text, 1, half) AS edited FROM base),
texts AS (SELECT t, row_number() OVER () AS id FROM (SELECT text AS t FROM edits UNION SELECT edited FROM edits)),
split AS (SELECT id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM texts),
placed AS (SELECT id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM split),
{xxh64("placed", "w", "hashed")},
lists AS (SELECT id, list(h ORDER BY p) AS hs FROM placed JOIN hashed USING (w) GROUP BY id),
shingles AS (
  SELECT id, list_reduce(list_prepend(42::UBIGINT, hs[k:k + 4]), lambda acc, v: {of_long("acc", "v")}) AS h
  FROM (SELECT id, hs, unnest(range(1, greatest(len(hs) - 4, 1) + 1)) AS k FROM lists)),
bins AS (SELECT id, ((h >> 57) + 64) % 128 AS bin, min(h & {(1 << 57) - 1}::UBIGINT) AS v FROM shingles GROUP BY id, bin),
pairs AS (SELECT i, j, {_of_ints("i::UBIGINT", "j::UBIGINT", "4294967295::UBIGINT")} AS h FROM range(128) a(i), range(128) b(j)),
choices AS (
  SELECT i, i AS j, 0 AS choice FROM range(128) a(i)
  UNION ALL SELECT i, {_of_ints("i::UBIGINT", "t::UBIGINT")} >> 57, 1 + t FROM range(128) a(i), range({ATTEMPTS}) b(t)
  UNION ALL SELECT i, j, {1 + ATTEMPTS} + row_number() OVER (PARTITION BY i ORDER BY h < 9223372036854775808::UBIGINT, h, j) FROM pairs),
filled AS (SELECT id, i, arg_min(v, choice) AS v FROM bins JOIN choices ON j = bin GROUP BY id, i),
prints AS (SELECT t, coalesce(print, repeat('0', 256)) AS print FROM split LEFT JOIN (SELECT id, string_agg(format('{{:02x}}', v & 255), '' ORDER BY i) AS print FROM filled GROUP BY id) USING (id)),
joined AS (
  SELECT doc_id, n, edited, a.print AS own, b.print AS other, c.print AS next
  FROM edits JOIN prints a ON a.t = text JOIN prints b ON b.t = edited JOIN prints c ON c.t = next_text),
same AS (SELECT *, {", ".join(f"list_sum(list_transform(range(128), lambda i: (substr(own, 2 * i + 1, 2) = substr({c}, 2 * i + 1, 2))::INTEGER)) AS same_{c}" for c in ("other", "next"))} FROM joined)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, own AS fingerprint, other AS edited_fingerprint,
  {", ".join(f"CASE WHEN own = repeat('0', 256) OR {c} = repeat('0', 256) THEN (own = {c})::INTEGER::DOUBLE ELSE greatest((same_{c} / 128.0::DOUBLE - 0.00390625::DOUBLE) / 0.99609375::DOUBLE, 0.0::DOUBLE) END AS {name}" for c, name in (("other", "near_edited"), ("next", "near_next")))}
FROM same
"""

_BITS = range(64)
OP10_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
shingles AS (SELECT doc_id, array_to_string(ws[k:k + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM docs WHERE len(ws) > 0)),
{xxh64("shingles", "s", "hashed")},
votes AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in _BITS)} FROM shingles JOIN hashed USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END" for b in _BITS)}, 0::UBIGINT) AS fp FROM docs LEFT JOIN votes USING (doc_id)),
classes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
near AS (SELECT a.fp AS u, b.fp AS v FROM classes a JOIN classes b ON bit_count(xor(a.fp, b.fp)) <= 4),
reach AS (SELECT fp AS u, fp AS v FROM classes UNION SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u),
components AS (SELECT reach.u AS fp, min(least) AS component_id FROM reach JOIN classes ON classes.fp = reach.v GROUP BY reach.u)
SELECT doc_id, format('{{:016x}}', fp) AS fingerprint, component_id FROM prints JOIN components USING (fp)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sentencepiece": op1_sentencepiece, "op2_toxicity": op2_toxicity, "op3_quality": op3_quality, "op4_pack": op4_pack, "op5_substring_dedup": op5_substring_dedup, "op6_fingerprints": op6_fingerprints, "op7_suffix_dedup": op7_suffix_dedup, "op8_exact_dedup": op8_exact_dedup, "op9_token_counts": op9_token_counts, "op10_simhash": op10_simhash}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op6_fingerprints": OP6_SQL, "op7_suffix_dedup": _op7_sql(), "op8_exact_dedup": OP8_SQL, "op10_simhash": OP10_SQL}
