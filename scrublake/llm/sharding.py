"""Sharding: a Feistel permutation of global row numbers, with cycle walking. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, with_row_number

ROUNDS = 6
#: Products of a half below 2^31 and MULT stay below 2^63.
MULT, PRIME = 2654435761, 4294967291
#: Steps that a walk may take. Numbers outside lie under max(a, b) of a * b, so a walk in a small domain can't be longer, and
#: in a large one it leaves with a chance of 1 - 1/sqrt(n) at each step; a longer walk raises an error.
WALK = 128


def halves(n: int) -> tuple[int, int]:
    """a * b >= n, both near the square root."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    out, x = [], seed & 0xFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(x)
    return out


def _f(half: Column, key: int) -> Column:
    t = (half * F.lit(MULT) + F.lit(key)) % F.lit(PRIME)
    t = t.bitwiseXOR(F.shiftrightunsigned(t, 15))
    return F.shiftrightunsigned((t % F.lit(1 << 31)) * F.lit(MULT) + F.lit(key), 16)


def _left(key: int, a: int):
    return lambda s: F.struct(((s["l"] + _f(s["r"], key)) % F.lit(a)).alias("l"), s["r"].alias("r"))


def _right(key: int, b: int):
    return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _f(s["l"], key)) % F.lit(b)).alias("r"))


def _once(x: Column, n: int, seed: int) -> Column:
    """One pass over [0, a * b): halves take turns, each moved by a hash of the other."""
    a, b = halves(n)
    state = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).alias("r"))
    for i, key in enumerate(round_keys(seed)):
        state = F.transform(F.array(state), _left(key, a) if i % 2 == 0 else _right(key, b))[0]
    return F.transform(F.array(state), lambda s: s["l"] * F.lit(b) + s["r"])[0]


def permuted(row_no: Column, n: int, seed: int = 0) -> Column:
    """The place of a row number in [0, n) in the shuffle of ``seed``: a bijection of [0, n).

    Numbers that a pass sends outside go through it again until they are inside.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    walk = lambda x: F.aggregate(F.array_repeat(F.lit(0), WALK), x, lambda p, _: F.when(p >= n, _once(p, n, seed)).otherwise(p))
    first = F.array(_once(row_no, n, seed).cast("long"))
    walked = F.transform(first, lambda p: F.when(p < n, p).otherwise(walk(p)))[0]  # few rows walk at all
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def permuted_int(x: int, n: int, seed: int = 0) -> int:
    """The same permutation for one number, to find a row's shard without Spark."""

    def f(half: int, key: int) -> int:
        t = (half * MULT + key) % PRIME
        t ^= t >> 15
        return ((t % (1 << 31)) * MULT + key) >> 16

    if n <= 1:
        return 0
    a, b = halves(n)
    while True:
        left, r = divmod(x, b)
        for i, key in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + f(r, key)) % a
            else:
                r = (r + f(left, key)) % b
        x = left * b + r
        if x < n:
            return x


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add row_no, shard and slot: counts at most one apart, slots gapless from 0, the same for the same rows and seed.

    Row numbers follow ``order``; rows equal in all of these columns must be interchangeable. Nulls come first. Columns named row_no,
    shard or slot are replaced, unless they are in ``order``, which raises an error; names that start with _ are kept for own use.
    """
    if clash := {"row_no", "shard", "slot"}.intersection(order):
        raise ValueError(f"{sorted(clash)} can't give the order, as they are replaced")
    numbered, n = with_row_number(rows.drop("row_no", "shard", "slot"), *order)
    place = permuted(F.col("row_no"), n, seed)
    return numbered.withColumn("_p", place).withColumns(
        {"shard": F.pmod("_p", F.lit(shards)).cast("int"), "slot": F.floor(F.col("_p") / F.lit(shards)).cast("long")}
    ).drop("_p")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39; rows are numbered by doc_id, then size and CRC (a null text: size 16, CRC 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_rows(docs, ["doc_id", "size", "text_crc32"], 40, seed=6).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 by byte, from its reversed polynomial 0xEDB88320, as text for SQL.
def _crc_table() -> list[int]:
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def _sql_f(half: str) -> str:
    t = f"({half} * {MULT}::BIGINT + key) % {PRIME}"
    return f"(((xor({t}, ({t}) >> 15)) % 2147483648) * {MULT}::BIGINT + key) >> 16"


#: Six rounds, and again six as long as the number is outside; the walk goes on from the halves as they are.
OP6_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] crc),
d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda v: ('0x' || v)::BIGINT),
    lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) text_crc32 FROM documents, crc),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 row_no FROM d),
a AS (SELECT count(*) n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 a FROM d),
ab AS (SELECT n, a, greatest((n + a - 1) // a, 1) b FROM a),
key(j, key) AS (VALUES {", ".join(f"({j}, {k}::BIGINT)" for j, k in enumerate(round_keys(6)))}),
walk(row_no, i, l, r) AS (
  SELECT row_no, 0, row_no // b, row_no % b FROM o, ab
  UNION ALL
  SELECT row_no, i + 1, CASE WHEN j % 2 = 0 THEN (l + ({_sql_f("r")})) % a ELSE l END, CASE WHEN j % 2 = 1 THEN (r + ({_sql_f("l")})) % b ELSE r END
  FROM walk JOIN key ON j = i % {ROUNDS}, ab WHERE i = 0 OR i % {ROUNDS} <> 0 OR l * b + r >= n),
p AS (SELECT row_no, l * b + r p FROM walk, ab WHERE i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n)
SELECT doc_id, size, text_crc32, 'rows' law, (p % 40)::INTEGER shard, p // 40 slot, NULL::INTEGER grown_shard FROM o JOIN p USING (row_no)
"""
