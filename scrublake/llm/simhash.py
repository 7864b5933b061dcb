"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at two differing bits or fewer by pigeonring filtering.

Fingerprints are cut into SEGMENTS on a ring. If two of them differ in up to MOST bits, there is a segment from which every chain of l
consecutive ones differs in no more than its share, MOST * l / SEGMENTS bits. So:

1. While that share is below one, the chain is equal: the first CHAIN segments from each of the SEGMENTS places are keys, under which
   candidates meet, 27 or 28 bits in each.
2. Candidates go on only while each longer chain from there keeps its share; the last chain is the whole fingerprint.
3. Buckets of more than SMALL fingerprints aren't paired. Two fingerprints that differ in two bits both differ in one bit from a third, so
   theirs are written beside each of the 64 that are one bit away, and beside themselves: what meets there, 65 fingerprints at most,
   is linked to the smallest. That loses and adds no link between components, and takes 65 rows a fingerprint in a bucket of any size.

Only distinct fingerprints take part, each once, with the smallest doc_id as its node; components come from large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_skewed, load, materialize
from .near_dedup import components

#: Bits in which linked fingerprints may differ; the third step holds for this number.
MOST = 2
SEGMENTS = 7
#: The longest chain whose share is below one.
CHAIN = -(-SEGMENTS // MOST) - 1
#: Fingerprints of a bucket that are paired.
SMALL = 32
#: Shingles hashed in one go.
CHUNK = 1 << 16
BATCH = 256
SEED = 42
WIDTH = 64


def segment(i: int) -> int:
    """The bits of a segment."""
    a, b = (-(-WIDTH * j // SEGMENTS) for j in (i, i + 1))
    return (1 << b) - (1 << a)


def chain(i: int, length: int) -> int:
    """The bits of consecutive segments from i on, as a signed number."""
    bits = sum(segment((i + j) % SEGMENTS) for j in range(length))
    return bits - (1 << WIDTH) if bits >> (WIDTH - 1) else bits


def fingerprint(data: bytes, k: int) -> int:
    """Of a text's bytes: words are lower-cased in A-Z and hashed in runs of k, or all together if fewer; without words 0."""
    words = data.lower().split()
    n = max(len(words) - k + 1, min(len(words), 1))
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, n, CHUNK):
        run = (b" ".join(words[i : i + k]) for i in range(at, min(n, at + CHUNK)))
        h = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in run), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                found = [fingerprint(b or b"", k) for b in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def _within_shares(i: Column, differing: Column) -> Column:
    """Whether all chains from segment i on, from the first that may differ, keep their shares of the differing bits."""
    ok = F.lit(True)
    for length in range(CHAIN + 1, SEGMENTS + 1):
        bits = F.element_at(F.array(*(F.lit(chain(j, length)) for j in range(SEGMENTS))), i + 1)
        ok = ok & (F.bit_count(differing.bitwiseAND(bits)) <= MOST * length // SEGMENTS)
    return ok


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp): all that differ in up to MOST bits and share a small bucket; of those in larger
    buckets, pairs that connect the same ones."""
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(chain(i, CHAIN))).alias("key")) for i in range(SEGMENTS)))
    rows = fps.select("fp", F.inline(keys))
    sizes = rows.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("size", F.col("n")), "sizes")
    members = materialize(join_skewed(rows, sizes, ["i", "key"], "n"), "members")

    few = members.where(F.col("size") <= SMALL).groupBy("i", "key").agg(F.collect_list("fp").alias("_f"))
    pairs = few.select("i", "_f", F.explode("_f").alias("a")).select("i", "a", F.explode("_f").alias("b")).where("a < b")
    pairs = pairs.where(_within_shares(F.col("i"), F.col("a").bitwiseXOR(F.col("b")))).select("a", "b")

    many = members.where(F.col("size") > SMALL).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(WIDTH)))
    beside = many.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.array_sort(F.collect_list("fp")).alias("_f"))
    stars = beside.where(F.size("_f") > 1).select(F.col("_f")[0].alias("a"), F.explode(F.slice("_f", 2, WIDTH)).alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable over links, itself included).

    A bit of the fingerprint is set if more than half of the shingles' hashes have it, repeats counted. Null, empty and blank texts have the
    fingerprint 0 and link like any other. Rows are told apart by doc_id: rows that repeat an id are one node, with the links of either; a
    null id links with nothing, and its component_id is null. Other columns of ``docs`` are not looked at.
    """
    found = materialize(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    known = found.where("doc_id is not null")
    fps = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct")

    node = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"_{c}"))
    links = near_pairs(fps.select("fp")).join(node("a"), "a").join(node("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    # ids that repeat with several fingerprints tie these together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("_hi"), F.count(F.lit(1)).alias("n")).where("a < _hi").drop("_hi")
    ties = join_skewed(known.withColumnRenamed("fp", "b"), materialize(several, "several"), ["doc_id"], "n").where("a <> b").select("a", "b").distinct()
    ties = ties.join(node("a"), "a").join(node("b"), "b").select("_a", "_b")
    linked = components(materialize(links.union(ties), "links"))

    of = fps.join(linked.withColumnRenamed("doc_id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n")
    out = join_skewed(known, materialize(of, "components"), ["fp"], "n").unionByName(found.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with shingles of three words."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3)
