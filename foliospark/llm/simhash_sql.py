"""SQL of SimHash near-dedup: XXH64 in unsigned integers of 128 bits, majorities bit by bit, and all pairs of distinct fingerprints; for tables as small as the tests'."""

from __future__ import annotations

#: Fixed values: the primes of XXH64, and its modulus.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
MODULUS = 1 << 64
M, P1, P2, P3, P4, P5 = (f"{n}::UHUGEINT" for n in (MODULUS, *PRIMES))


def times(a: str, b: str) -> str:
    return f"(({a}) * {b} % {M})"


def plus(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {M})"


def rotated(x: str, by: int) -> str:
    return f"(({x}) * {1 << by}::UHUGEINT % {M} + ({x}) // {1 << 64 - by}::UHUGEINT)"


def differing(a: str, b: str) -> str:
    return f"(xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT)"


def little(at: str, n: int) -> str:
    """The little-endian number in n bytes of the hex text h."""
    return "('0x' || " + " || ".join(f"substr(h, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def bound(x: str, body) -> str:
    """An expression that uses x more than once."""
    return f"list_transform([{x}], lambda z: {body('z')})[1]"


def fold(first: str, items: str, body) -> str:
    return f"list_reduce(list_prepend({first}, {items}), lambda a, k: {body('a', 'k')})"


def turn(a: str, k: str) -> str:
    return times(bound(plus(a, times(k, P2)), lambda z: rotated(z, 31)), P1)


def hashed(table: str, seed: int) -> str:
    """Common table expressions that end in hashed (s, x): the XXH64 of each s of a table."""
    starts = [(seed + PRIMES[0] + PRIMES[1]) % MODULUS, (seed + PRIMES[1]) % MODULUS, seed, (seed - PRIMES[0]) % MODULUS]
    lanes = ", ".join(f"CASE WHEN n >= 32 THEN {fold(f'{x}::UHUGEINT', f'list_transform(range(n // 32), lambda i: {little(f"32 * i + {8 * k}", 8)})', turn)} END AS v{k + 1}" for k, x in enumerate(starts))
    joined = plus(plus(rotated("v1", 1), rotated("v2", 7)), plus(rotated("v3", 12), rotated("v4", 18)))
    lane = lambda a, v: plus(times(differing(a, turn("0::UHUGEINT", v)), P1), P4)  # noqa: E731
    eight = lambda a, k: plus(times(bound(differing(a, turn("0::UHUGEINT", k)), lambda z: rotated(z, 27)), P1), P4)  # noqa: E731
    four = plus(times(bound(differing("x", times(little("n // 8 * 8", 4), P1)), lambda z: rotated(z, 23)), P2), P3)
    one = lambda a, k: times(bound(differing(a, times(k, P5)), lambda z: rotated(z, 11)), P1)  # noqa: E731
    return f"""b0 AS (
  SELECT s, hex(encode(s)) AS h, length(hex(encode(s))) // 2 AS n FROM {table}
), b1 AS (
  SELECT *, {lanes} FROM b0
), b2 AS (
  SELECT *, CASE WHEN n >= 32 THEN {joined} ELSE {(seed + PRIMES[4]) % MODULUS}::UHUGEINT END AS x FROM b1
), b3 AS (
  SELECT s, h, n, {plus(f"CASE WHEN n >= 32 THEN {fold('x', '[v1, v2, v3, v4]', lane)} ELSE x END", "n::UHUGEINT")} AS x FROM b2
), b4 AS (
  SELECT s, h, n, {fold("x", f"list_transform(range(n % 32 // 8), lambda i: {little('n // 32 * 32 + 8 * i', 8)})", eight)} AS x FROM b3
), b5 AS (
  SELECT s, h, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE x END AS x FROM b4
), b6 AS (
  SELECT s, {fold("x", f"list_transform(range(n // 4 * 4, n), lambda i: {little('i', 1)})", one)} AS x FROM b5
), b7 AS (
  SELECT s, {times(differing("x", f"x // {1 << 33}::UHUGEINT"), P2)} AS x FROM b6
), b8 AS (
  SELECT s, {times(differing("x", f"x // {1 << 29}::UHUGEINT"), P3)} AS x FROM b7
), hashed AS (
  SELECT s, {differing("x", f"x // {1 << 32}::UHUGEINT")}::UBIGINT AS x FROM b8
)"""


_BITS = " + ".join(f"CASE WHEN 2 * sum((x >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT r, unnest(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d WHERE len(w) > 0
), each AS (
  SELECT DISTINCT s FROM shingles
), {hashed("each", 42)}, prints AS (
  SELECT r, ({_BITS})::UBIGINT AS fp FROM shingles JOIN hashed USING (s) GROUP BY r
), f AS (
  SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN prints USING (r)
), p AS (
  SELECT DISTINCT fp FROM f
), links AS (
  SELECT a.fp AS u, b.fp AS v FROM p a JOIN p b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2
), reach AS (
  SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), least AS (
  SELECT fp, min(doc_id) AS least FROM f GROUP BY fp
), found AS (
  SELECT l.fp, least(l.least, min(m.least)) AS component_id FROM least l LEFT JOIN reach ON l.fp = u LEFT JOIN least m ON m.fp = v GROUP BY l.fp, l.least
)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN found USING (fp)
"""
