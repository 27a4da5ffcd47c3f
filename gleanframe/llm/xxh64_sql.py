"""XXH64 in SQL, for the queries' counterparts in DuckDB.

64-bit products are taken in 128 bits, modulo 2**64; a rotation by r is a product with 2**r modulo 2**64 - 1.
"""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
M = (1 << 64) - 1


def _mul(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {M + 1}::UHUGEINT)::UBIGINT"


def _add(*terms: str | int) -> str:
    return "((" + " + ".join(f"({t})::UHUGEINT" for t in terms) + f") % {M + 1}::UHUGEINT)::UBIGINT"


def _rot(a: str, r: int) -> str:
    return f"(({a})::UHUGEINT * {1 << r}::UHUGEINT % {M}::UHUGEINT)::UBIGINT"


def _round(acc: str | int, lane: str) -> str:
    return _mul(_rot(_add(acc, _mul(lane, P2)), 31), P1)


def _number(digits: str, size: int) -> str:
    """A little-endian number of `size` bytes from its hex digits."""
    return "('0x' || " + " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UBIGINT"


def _fold(start: str, first: str, count: str, step: int, size: int, use) -> str:
    """use(acc, number) over `count` numbers of `size` bytes, from digit `first` on and `step` digits apart."""
    values = f"list_transform(range(0, ({count})::BIGINT), lambda i: {_number(f'substr(x, ({first}) + i * {step}, {2 * size})', size)})"
    return f"list_reduce(list_prepend({start}, {values}), lambda acc, v: {use('acc', 'v')})"


def xxh64(source: str, key: str, out: str, seed: int = 42) -> str:
    """CTEs that end in `out`(key, h): the hashes of the distinct texts `key` of `source`."""
    starts = ((seed + P1 + P2) & M, (seed + P2) & M, seed, (seed - P1) & M)
    lanes = ", ".join(_fold(f"{v}::UBIGINT", str(1 + 16 * k), "stripes", 64, 8, _round) + f" AS v{k}" for k, v in enumerate(starts))
    merged = _add(*[_rot(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))])
    for k in range(4):
        merged = _add(_mul(f"xor({merged}, {_round(0, f'v{k}')})", P1), P4)
    eights = _fold("h", "1 + 64 * stripes", "(n % 32) // 8", 16, 8, lambda acc, v: _add(_mul(_rot(f"xor({acc}, {_round(0, v)})", 27), P1), P4))
    four = _add(_mul(_rot(f"xor(h, {_mul(_number('substr(x, 1 + 2 * (n - n % 8), 8)', 4), P1)})", 23), P2), P3)
    ones = _fold("h", "1 + 2 * (n - n % 4)", "n % 4", 2, 1, lambda acc, v: _mul(_rot(f"xor({acc}, {_mul(v, P5)})", 11), P1))
    return f"""
{out}_0 AS (SELECT {key}, hex({key}) AS x, length(hex({key})) // 2 AS n, length(hex({key})) // 64 AS stripes FROM (SELECT DISTINCT {key} FROM {source})),
{out}_1 AS (SELECT *, {lanes} FROM {out}_0),
{out}_2 AS (SELECT {key}, x, n, stripes, {_add(f"CASE WHEN stripes > 0 THEN {merged} ELSE {(seed + P5) & M}::UBIGINT END", "n")} AS h FROM {out}_1),
{out}_3 AS (SELECT * EXCLUDE (h), {eights} AS h FROM {out}_2),
{out}_4 AS (SELECT * EXCLUDE (h), CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {out}_3),
{out}_5 AS (SELECT * EXCLUDE (h), {ones} AS h FROM {out}_4),
{out}_6 AS (SELECT {key}, {_mul("xor(h, h >> 33)", P2)} AS h FROM {out}_5),
{out}_7 AS (SELECT {key}, {_mul("xor(h, h >> 29)", P3)} AS h FROM {out}_6),
{out} AS (SELECT {key}, xor(h, h >> 32) AS h FROM {out}_7)"""


def _let(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def _mixed(h: str) -> str:
    last = _let(_mul("xor(b_, b_ >> 29)", P3), "c_", "xor(c_, c_ >> 32)")
    return _let(h, "a_", _let(_mul("xor(a_, a_ >> 33)", P2), "b_", last))


def of_long(seed: str, value: str) -> str:
    """The hash of a number of 8 bytes."""
    return _mixed(_add(_mul(_rot(f"xor({_add(seed, P5, 8)}, {_round(0, value)})", 27), P1), P4))


def of_int(seed: str, value: str) -> str:
    """The hash of a number of 4 bytes, given as an unsigned one."""
    return _mixed(_add(_mul(_rot(f"xor({_add(seed, P5, 4)}, {_mul(value, P1)})", 23), P2), P3))
