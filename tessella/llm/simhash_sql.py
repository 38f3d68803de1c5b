"""Oracle SQL of the SimHash query: XXH64 worked out on 128-bit numbers, fingerprints, links and components.

XXH64's constants are fixed values. Every product of two 64-bit numbers fits 128 bits, and is cut to 64 after it.
"""

from __future__ import annotations

from itertools import count

from tessella.llm import simhash

P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M = 1 << 64
_names = count()


def _n(value: int) -> str:
    return f"{value % M}::UHUGEINT"


def _let(value: str, body) -> str:
    """body of a name that stands for value, which is worked out once."""
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _mod(value: str) -> str:
    return f"(({value}) % {M}::UHUGEINT)"


def _turned(value: str, by: int) -> str:
    return _let(value, lambda x: f"({_mod(f'{x} * {1 << by}::UHUGEINT')} + {x} // {1 << (64 - by)}::UHUGEINT)")


def _round(acc: str, lane: str) -> str:
    return _mod(f"{_turned(_mod(f'{acc} + {_mod(f'{lane} * {_n(P2)}')}'), 31)} * {_n(P1)}")


def _reduced(start: str, values: str, step) -> str:
    a, x = f"a{next(_names)}", f"x{next(_names)}"
    return f"list_reduce(list_prepend({start}, {values}), lambda {a}, {x}: {step(a, x)})"


def _number(first: str, size: int) -> str:
    """The little-endian number of `size` bytes of list b from position `first` (from 1)."""
    return "(" + " + ".join(f"b[{first} + {i}] * {1 << (8 * i)}::UHUGEINT" for i in range(size)) + ")"


def xxh64(source: str, seed: int) -> str:
    """CTEs that end in hashed (s, h): of the distinct strings s of source, h as a 64-bit number."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"
    lanes = lambda i: f"list_transform(range(0, CAST(n // 32 AS BIGINT)), lambda j: {_number(f'CAST(32 * j + {8 * i + 1} AS BIGINT)', 8)})"
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    accs = ", ".join(f"{_reduced(_n(s), lanes(i), _round)} AS a{i}" for i, s in enumerate(starts))
    long = _mod(" + ".join(_turned(f"a{i}", by) for i, by in enumerate((1, 7, 12, 18))))
    for i in range(4):
        long = _mod(f"xor({long}, {_round('0::UHUGEINT', f'a{i}')}) * {_n(P1)} + {_n(P4)}")
    eight = _reduced("h1", f"list_transform(range(0, CAST(n % 32 // 8 AS BIGINT)), lambda j: {_number('CAST(n - n % 32 + 8 * j + 1 AS BIGINT)', 8)})", lambda h, k: _mod(f"{_turned(f'xor({h}, {_round("0::UHUGEINT", k)})', 27)} * {_n(P1)} + {_n(P4)}"))
    four = f"CASE WHEN n % 8 >= 4 THEN {_mod(f'{_turned(f"xor(h2, {_mod(f"{_number("n - n % 8 + 1", 4)} * {_n(P1)}")})", 23)} * {_n(P2)} + {_n(P3)}')} ELSE h2 END"
    one = _reduced("h3", "list_transform(range(0, CAST(n % 4 AS BIGINT)), lambda j: b[CAST(n - n % 4 + j + 1 AS BIGINT)])", lambda h, k: _mod(f"{_turned(f'xor({h}, {_mod(f"{k} * {_n(P5)}")})', 11)} * {_n(P1)}"))
    return f"""hx AS (SELECT DISTINCT s, hex(encode(s)) AS x FROM {source}),
hb AS (SELECT s, length(x) // 2 AS n, list_transform(range(0, length(x) // 2), lambda i: ({digit('2 * i + 1')} * 16 + {digit('2 * i + 2')})::UHUGEINT) AS b FROM hx),
ha AS (SELECT s, n, b, {accs} FROM hb), h1 AS (SELECT s, n, b, {_mod(f"CASE WHEN n >= 32 THEN {long} ELSE {_n(seed + P5)} END + n::UHUGEINT")} AS h1 FROM ha),
h2 AS (SELECT s, n, b, {eight} AS h2 FROM h1), h3 AS (SELECT s, n, b, {four} AS h3 FROM h2), h4 AS (SELECT s, {one} AS h4 FROM h3),
h5 AS (SELECT s, {_mod(f"xor(h4, h4 // {1 << 33}::UHUGEINT) * {_n(P2)}")} AS h5 FROM h4), h6 AS (SELECT s, {_mod(f"xor(h5, h5 // {1 << 29}::UHUGEINT) * {_n(P3)}")} AS h6 FROM h5),
hashed AS MATERIALIZED (SELECT s, xor(h6, h6 // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM h6)"""


def simhash_sql(radius: int = 2) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM d WHERE len(w) > 0),
{xxh64('sh', simhash.SEED)}, fp AS (SELECT r, {bits} AS f FROM sh JOIN hashed USING (s) GROUP BY r), all_fp AS MATERIALIZED (SELECT d.r, doc_id, coalesce(f, 0::UBIGINT) AS f FROM d LEFT JOIN fp USING (r)),
u AS MATERIALIZED (SELECT f, min(doc_id) AS least FROM all_fp GROUP BY f), l AS MATERIALIZED (SELECT a.f AS a, b.f AS b FROM u a JOIN u b ON bit_count(xor(a.f, b.f)::BIT) <= {radius}),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS f, min(least) AS component_id FROM reach JOIN u ON u.f = reach.b GROUP BY a)
SELECT doc_id, lpad(lower(hex(f)), 16, '0') AS fingerprint, component_id FROM all_fp JOIN c USING (f)"""
