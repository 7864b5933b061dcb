"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

1. Targets: sources share all words by weight; a target stops at MAX_EPOCHS times its source's words, and what that frees is shared
   again by weight. Sorted by cap / weight, the capped sources come first, so running sums give the result at once.
2. Quotas: a shard ends where the blocks of all shards so far end; each of these ends is apportioned by highest quotients
   target / (2 j + 1). Such seats only grow with the number of seats, so differences are the shards' quotas.
3. Selection: a source's documents stand in a seeded order in a ring of words, cut into blocks; the source gives its quota of
   consecutive blocks from a seeded block on, going round as often as need be. Each shard has its own consecutive part of this run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, materialize, word_count

MAX_EPOCHS = 3
BLOCK = 32
SHARDS = 4
_PRIME, _MULT = 4294967291, 2654435761
_UPTO = (Window.unboundedPreceding, -1)


def seeded(x: Column, seed: int) -> Column:
    """A number in [0, 2^32) for each whole number."""
    t = (F.pmod(F.coalesce(x, F.lit(-1)), F.lit(2147483647)) * F.lit(_MULT) + F.lit(seed * 40503 + 1)) % F.lit(_PRIME)
    t = t.bitwiseXOR(F.shiftrightunsigned(t, 15))
    return ((t % F.lit(1 << 31)) * F.lit(_MULT) + F.lit(seed)) % F.lit(_PRIME)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources: source, source_no (in code point order, null last, from 0), source_size, target.

    ``sizes`` has source and size. One row for each source meets in one task; the documents are summed before.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumns({"weight": F.col("source_no") % 3 + 1, "cap": F.col("source_size") * MAX_EPOCHS})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(order.rowsBetween(*_UPTO)), F.lit(0)).cast("double")
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    s = s.withColumns({"_left": left, "_weights": weights})
    s = s.withColumn("_capped", F.col("cap").cast("double") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    # the first source under its cap holds what is left for all others
    first = F.min(F.when(~F.col("_capped"), F.struct(F.col("cap") / F.col("weight"), "source_no", "_left", "_weights"))).over(everything)
    s = s.withColumn("_first", first)
    share = F.col("_first._left") * F.col("weight") / F.col("_first._weights")
    target = F.when(F.col("_capped") | F.col("_first").isNull(), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double")))
    return s.select("source", "source_no", "source_size", target.alias("target"))


def block_quotas(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """Quotas of blocks: source_no, shard, seats (of shards 0 to this one), quota (of this one).

    For m sources, seats under the divisor total / (s - m) are certain and seats over total / (s + m) impossible, so only some
    2 m quotients of each end are ranked.
    """
    every = Window.partitionBy()
    t = targets.select("source_no", "target", F.sum("target").over(every).alias("_all"), F.count(F.lit(1)).over(every).alias("_m"))
    t = t.withColumn("_seats", F.ceil(F.col("_all") / F.lit(block)))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = t.withColumn("_end", F.floor(F.col("_seats") * (F.col("shard") + 1) / F.lit(shards)))
    at = lambda seats: F.when(F.col("_all") > 0, F.floor(F.col("target") / F.col("_all") * F.greatest(seats, F.lit(0)) + 0.5)).otherwise(0).cast("long")
    t = t.withColumns({"_low": at(F.col("_end") - F.col("_m")), "_high": at(F.col("_end") + F.col("_m")) + 1})
    t = t.withColumn("_rest", F.col("_end") - F.sum("_low").over(Window.partitionBy("shard")))
    c = t.withColumn("_j", F.explode(F.sequence("_low", "_high")))
    rank = F.row_number().over(Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("_j") + 1)).desc(), "source_no"))
    c = c.withColumn("_won", (rank <= F.col("_rest")).cast("long"))
    ends = c.groupBy("source_no", "shard").agg((F.first("_low") + F.sum("_won")).alias("seats"))
    before = F.lag("seats", 1, 0).over(Window.partitionBy("source_no").orderBy("shard"))
    return ends.withColumn("quota", F.col("seats") - before)


def mixed_sources(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """Add source_size, target, taken, taken_by_shard, copies to ``docs`` (doc_id, source, size; further columns stay, but for those of these names).

    ``taken``: the document's words in the mix, repeats counted, MAX_EPOCHS times its size at most; ``taken_by_shard``: an array of
    those in each shard. ``copies``: how often the mix
    begins the document, for mixes of whole documents. Documents without words take nothing and have as many copies as
    the place where they stand is passed. A source's documents are summed up in buckets of its ring first, then the
    buckets are, so that no source meets in one task. Null sources are a source; repeated rows count one by one. Rows without a
    doc_id stand in the ring by their sizes, so they don't share one bucket.
    """
    docs = docs.drop("source_size", "target", "taken", "taken_by_shard", "copies")
    if buckets is None:
        buckets = min(1 << 16, max(256, docs.count() // 64))
    docs = docs.withColumns({"_src": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull(), "_key": seeded(F.coalesce(F.col("doc_id"), -1 - F.col("size")), seed)})
    docs = docs.withColumn("_bucket", F.floor(F.col("_key") * F.lit(buckets) / F.lit(float(_PRIME))).cast("int"))
    key = ["_src", "_none", "_bucket"]
    targets = source_targets(docs)
    run = block_quotas(targets, block, shards).groupBy("source_no")
    run = run.agg((F.sum("quota") * F.lit(block)).alias("_run"), F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"] * block).alias("_ends"))
    z = F.col("source_size")
    plan = targets.join(run, "source_no").select(
        F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"), "source_size", "target",
        F.least(F.col("_run"), z * MAX_EPOCHS).alias("_run"), F.transform("_ends", lambda x: F.least(x, z * MAX_EPOCHS)).alias("_ends"),
        (F.pmod(seeded(F.col("source_no"), seed + 1), F.greatest(F.floor(z / F.lit(block)), F.lit(1))) * F.lit(block)).alias("_start"),
    )
    sums = docs.groupBy(*key).agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_off", F.coalesce(F.sum("_sum").over(Window.partitionBy("_src", "_none").orderBy("_bucket").rowsBetween(*_UPTO)), F.lit(0)))
    sums = sums.drop("_sum").join(plan, ["_src", "_none"])
    inside = Window.partitionBy(*key).orderBy("_key", "doc_id", "size").rowsBetween(*_UPTO)
    docs = docs.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, key)
    lo, hi = F.col("_off") + F.col("_in"), F.col("_off") + F.col("_in") + F.col("size")
    full = F.when(z > 0, F.floor(F.col("_run") / z)).otherwise(0).cast("long")
    end = F.col("_start") + F.col("_run") - full * z
    part = lambda a, b: F.greatest(F.least(hi, b) - F.greatest(lo, a), F.lit(0))
    begins = ((lo >= F.col("_start")) & (lo < end)) | (lo < end - z)
    # the document's words among the first x of the ring and its repeats
    upto = lambda x: F.when(z > 0, F.floor(x / z) * F.col("size") + F.greatest(F.least(x % z, hi) - lo, F.lit(0))).otherwise(0)
    shard = lambda x, i: upto(F.col("_start") + x) - upto(F.col("_start") + F.when(i > 0, F.get("_ends", i - 1)).otherwise(0))
    return docs.withColumns({
        "taken_by_shard": F.transform("_ends", lambda x, i: shard(x, i).cast("long")),
        "taken": (full * F.col("size") + part(F.col("_start"), end) + part(F.lit(0), end - z)).cast("long"),
        "copies": (full + begins.cast("long")).cast("int"),
    }).drop(*key, "_key", "_in", "_off", "_run", "_ends", "_start")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; size is the number of words. taken_0 and so on: of the words taken, those that each shard takes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixed_sources(materialize(docs, "sizes"), seed=5)
    return mix.select("doc_id", "size", "source_size", "target", "taken", *(F.get("taken_by_shard", F.lit(i)).alias(f"taken_{i}") for i in range(SHARDS)))


def _sql_seeded(x: str, seed: int) -> str:
    t = f"((((coalesce({x}, -1) % 2147483647) + 2147483647) % 2147483647) * {_MULT}::BIGINT + {seed * 40503 + 1}) % {_PRIME}"
    t = f"xor({t}, ({t}) >> 15)"
    return f"((({t}) % 2147483648) * {_MULT}::BIGINT + {seed}) % {_PRIME}"


_ENDS = ", ".join(f"count(*) FILTER (r <= (SELECT seats FROM n) * {i} // {SHARDS}) e{i}" for i in range(SHARDS + 1))
_RUNS = ", ".join(f"least(coalesce(e{i}, 0) * {BLOCK}, {MAX_EPOCHS} * s.z) run{i}" for i in range(SHARDS + 1))
#: Words of a document among the first start + run of its source's ring.
_UPTO_SQL = ", ".join(
    f"(CASE WHEN z > 0 THEN (start + run{i}) // z * size + greatest(least((start + run{i}) % z, lo + size) - lo, 0) ELSE 0 END)::BIGINT u{i}" for i in range(SHARDS + 1)
)
#: The seats are dealt one by one here, from all quotients.
OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT z, row_number() OVER (ORDER BY source NULLS LAST) - 1 no FROM d GROUP BY source),
w AS (SELECT *, no % 3 + 1 w, 3 * z cap FROM s),
round(i, no, w, cap, t) AS (
  SELECT 0, no, w, cap, w * (SELECT sum(z) FROM s)::DOUBLE / (SELECT sum(w) FROM w) FROM w
  UNION ALL
  SELECT i + 1, no, w, cap, CASE WHEN t >= cap THEN cap::DOUBLE ELSE
    ((sum(cap) OVER ())::DOUBLE / 3 - sum(CASE WHEN t >= cap THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN t >= cap THEN 0 ELSE w END) OVER () END
  FROM round WHERE i <= (SELECT count(*) FROM s)),
t AS (SELECT no, cap // 3 z, t FROM round WHERE i = (SELECT count(*) FROM s) + 1),
n AS (SELECT ceil(sum(t) / {BLOCK})::BIGINT seats FROM t),
q AS (SELECT no, t / (2 * j + 1) q FROM t, (SELECT unnest(generate_series(0, (SELECT seats FROM n))) j)),
ranked AS (SELECT no, row_number() OVER (ORDER BY q DESC, no) r FROM q),
ends AS (SELECT no, {_ENDS} FROM ranked GROUP BY no),
p AS (SELECT s.source, t.no, s.z, t.t, ({_sql_seeded("t.no", 6)}) % greatest(s.z // {BLOCK}, 1) * {BLOCK} start, {_RUNS}
  FROM t JOIN s USING (no) LEFT JOIN ends USING (no)),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY {_sql_seeded("coalesce(doc_id, -1 - size)", 5)}, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT lo FROM d),
u AS (SELECT doc_id, size, z, t, {_UPTO_SQL} FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, z source_size, t "target", u{SHARDS} - u0 taken, {", ".join(f"u{i + 1} - u{i} taken_{i}" for i in range(SHARDS))} FROM u
"""
