"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, connected components.

1. One pass over the texts gives each document's number of shingles, a key of its whole set, a signature (a bit of each of 240 minima)
   and 40 band keys of six minima each. A pair at 0.8 shares no band with a chance of (1 - 0.8^6)^40, about 5e-6.
2. Documents of equal sets are one class, with the smallest doc_id as representative; only representatives go on.
3. In each band bucket the smallest id is the pivot; every member is compared with it: first the signatures, then the full sets. Members
   of a large bucket are dealt over several tasks, and the pivot's set goes to each once for PARTNERS members.
   Buckets whose members are then in different components get further pivots while that pays. Before that, counts of the shingles that other
   such documents have too, in 64 buckets by hash, bound what two documents can share; pairs that can't reach the threshold
   by this exact bound need no comparison. Documents that are still in buckets of several components are compared if they share
   one of their rarest shingles (a prefix filter, which is exact), so a group of near copies costs a few comparisons for
   each member and not one for each pair.
4. Components come from alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, join_skewed, load, materialize, mixed, runs_of, splitmix, text_buffers, words_of

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Bits of the signatures of two documents at the threshold differ in (1 - s) / 2 of HASHES places; so many standard deviations more pass:
#: of a pair at the threshold, less than 1 in 10^10 is lost by that, far less than by the bands.
SIGMAS = 7.0
#: A pivot's set is sent along once for so many of the sets that it is compared with.
PARTNERS = 256
#: Documents of pairs to be confirmed are looked up by broadcast up to so many rows (16 bytes each), by a shuffle beyond.
BROADCAST_ROWS = 1 << 19
#: Further pivots of a bucket in a turn, and turns at most; then pairs are taken one by one.
PIVOTS, TURNS = 8, 1
_A = (splitmix(21, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (splitmix(22, HASHES) >> np.uint64(32)).astype(np.uint32)
#: Bits of the longer signatures of members of open buckets.
LONG = 1024
_LONG_A = (splitmix(25, LONG) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_LONG_B = (splitmix(26, LONG) >> np.uint64(32)).astype(np.uint32)
#: Buckets of shingles, for the bound of what two documents share.
PARTS = 64
_M = splitmix(23, ROWS)
_BAND = splitmix(24, BANDS)
SKETCH = "doc_id long, n_shingles long, set_key binary, signature array<long>, bands array<long>"


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text; words are lower-cased in A-Z.

    Fewer than k words make one shingle, no words none.
    """
    for row, to, buf, offsets in text_buffers(column):
        words, begins = words_of(buf, offsets, lower=True)
        runs = runs_of(words, k, seed=k)
        for i in range(to - row):
            a, b = int(begins[i]), int(begins[i + 1])
            if b - a >= k:
                yield row + i, np.unique(runs[a : b - k + 1])
            elif b > a:
                yield row + i, runs_of(words[a:b], b - a, seed=b - a)
            else:
                yield row + i, np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Least values of the hashes a * x + b."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 18) // len(a))
    for at in range(0, len(x), step):
        h = a[:, None] * x[None, at : at + step]
        h += b[:, None]
        np.minimum(best, h.min(axis=1), out=best)
    return best


def bands_of(least: np.ndarray) -> np.ndarray:
    wide = (least.reshape(BANDS, ROWS).astype(np.uint64) * _M).sum(axis=1, dtype=np.uint64)
    return mixed(wide + _BAND).view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """A bit of each minimum, in 64-bit words."""
    bits = np.packbits((least * np.uint32(2654435761)) >> np.uint32(31)).tobytes()
    return np.frombuffer(bits.ljust(-(-len(bits) // 8) * 8, b"\0"), np.int64)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, keys, signatures, bands = [], [], [], []
            for _, s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                if len(s):
                    m = minima(s)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signatures.append(signature(m))
                    bands.append(bands_of(m))
                else:
                    keys.append(None)
                    signatures.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "signature", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = [s.tobytes() for _, s in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "part", "b")), pa.array(sets, pa.binary())], ["a", "part", "b", "shingles"])

    return run


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [s for _, s in shingle_sets(part.column("text"), k)]
                row = np.repeat(np.arange(len(part)), [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(flat)], ["doc_id", "shingle"])

    return run


def _longer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(signature(minima(s, _LONG_A, _LONG_B)), bands_of(minima(s))) for _, s in shingle_sets(batch.column("text"), k)]
            arrays = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "signature", "bands"])

    return run


def _bounds(ids: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Of the documents ``ids``: n shingles, how many of them (most) another of these documents may have too, and these by bucket; and
    longer signatures, with bands."""
    ids = materialize(ids, "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    own = docs.join(ids, "doc_id")
    longer = materialize(own.mapInArrow(_longer(k), "doc_id long, signature array<long>, bands array<long>"), "longer")
    rows = own.mapInArrow(_rows(k), "doc_id long, shingle long").distinct()  # a repeated row must not count twice
    part = F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")
    alone = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    signed = rows.select("doc_id", part, F.lit(1).alias("n"), F.lit(1).alias("most")).union(alone.select("doc_id", part, F.lit(0), F.lit(-1)))
    counts = signed.groupBy("doc_id", "part").agg(F.sum("n").alias("n"), F.sum("most").alias("most"))
    entries = F.map_from_entries(F.collect_list(F.struct("part", "most")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_e"), i), F.lit(0)).cast("int"))
    bounds = counts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("most").alias("most"), entries.alias("_e"))
    return materialize(bounds.select("doc_id", "n", "most", dense.alias("parts")), "bounds"), longer


def _alike(percent: int):
    """Of rows sorted by a, part and b (null: the sets of a itself, first), the pairs of which two sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found = []
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for a, part, b, raw in zip(*(some.column(c).to_pylist() for c in ("a", "part", "b", "shingles")), strict=True):
                    y = np.frombuffer(raw, np.uint64)
                    if (a, part) != key:
                        key, own = (a, part), []
                    if b is None:
                        own.append(y)
                        continue
                    for x in own:
                        both = len(x) + len(y) - len(np.union1d(x, y))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            found.append((a, b))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def unlike(percent: int, bits: int) -> Column:
    """Whether the signatures sig_a and sig_b differ too much for the threshold."""
    miss = (1 - percent / 100) / 2
    most = int(bits * miss + SIGMAS * (bits * miss * (1 - miss)) ** 0.5)
    return sum(F.bit_count(F.col("sig_a")[i].bitwiseXOR(F.col("sig_b")[i])) for i in range(-(-bits // 64))) > most


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; the sets are made again from the whole texts, that of a once for PARTNERS
    or so of its pairs."""
    pairs = materialize(pairs, "pairs")
    counts = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("_parts"), F.count(F.lit(1)).alias("_n")), "counts")
    dealt = join_skewed(pairs, counts, ["a"], "_n").select("a", F.pmod(F.xxhash64("b"), "_parts").cast("int").alias("part"), "b")
    first = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    routes = dealt.withColumn("doc_id", F.col("b")).unionByName(first.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")))
    routes = materialize(routes, "routes")
    if routes.count() <= BROADCAST_ROWS:
        routes = F.broadcast(routes)
    sets = docs.join(routes, "doc_id").select("a", "part", "b", "text").mapInArrow(_sets(k), "a long, part int, b long, shingles binary")
    sets = sets.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(sets.mapInArrow(_alike(percent), "a long, b long").distinct(), "links")


def _likely(stars: DataFrame, centres: DataFrame, percent: int, bits: int = HASHES) -> DataFrame:
    """Distinct pairs (a, b), a < b, of a member and its bucket's pivot, whose signatures are near. ``stars``: key, doc_id, signature;
    ``centres``: key, pivot, sig_a, and n, the number of members."""
    pairs = join_skewed(stars, centres, ["key"], "n").withColumnRenamed("signature", "sig_b").where((F.col("doc_id") != F.col("pivot")) & ~unlike(percent, bits))
    return pairs.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()


def _smallest(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each node with the smallest of its neighbours and itself."""
    return edges.groupBy(node).agg(F.least(F.col(node), F.min(other)).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): doc_id and component, the smallest id, for every linked id.

    Large-star: each node links its larger neighbours to the smallest of all. Small-star: each node links its smaller neighbours and
    itself to the smallest of them. Steps alternate, through the shared folder, until only stars are left: each node has one smaller
    neighbour, which has none.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    n = links.count()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both, "u", "v"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # written, as it is read twice: no more rows than edges, and repeated ones go below; each plan and its tasks weigh on the driver
        large = materialize(large, "large", _parts(n))
        # a node's least neighbour gives the node's own link, the others give theirs
        small = large.join(_smallest(large, "u", "v"), "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.distinct(), "edges", _parts(n))
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, loose = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()
        if not loose:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()
            )


def _parts(rows: int) -> int:
    """Files for a table of so many pairs."""
    return max(4, -(-rows // 1_000_000))


def _open(inside: DataFrame) -> DataFrame:
    """Members of the buckets with several components."""
    keys = inside.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
    return inside.join(keys, "key", "left_semi")


def _possible(percent: int, parts: bool = True) -> Column:
    """Whether sets of n and _n shingles can reach the threshold: in a bucket they share no more than the lesser of their counts there of
    shingles that several documents have. Without counts they can."""
    reach = lambda shared: 100 * shared >= percent * (F.col("n") + F.col("_n") - shared)
    shared = F.least("most", "_most")
    if parts:
        shared = F.aggregate(F.zip_with("parts", "_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(reach(shared), F.lit(True))


def _meets(percent: int) -> Column:
    """Whether sets of n and _n shingles whose first common one stands at ``at`` and ``_at`` can reach the threshold: they share that one and no
    more than either has after it. A pair's first common shingle fulfils this, if later ones don't."""
    sizes = (F.col("n") * 100 >= F.col("_n") * percent) & (F.col("_n") * 100 >= F.col("n") * percent)
    after = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    return sizes & ((after + 1) * (100 + percent) >= (F.col("n") + F.col("_n")) * percent)


def _prefixes(left: DataFrame, several: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of documents ``left`` (doc_id, component), the rarest shingles: doc_id, component, n, shingle.

    Two sets of n and m shingles that reach the threshold share ``percent`` hundredths of n; of the shingles in one order for all, here by
    the number of documents that have them, the n - that + 1 first of each must then have one in common.
    Shingles that no other prefix has are left out. ``at`` is a shingle's place in that order, from 1: what comes before it isn't shared by two
    sets that meet here first. Ids of ``several`` texts keep all their shingles, and no n or place.
    """
    if left.count() <= BROADCAST_ROWS:
        left = F.broadcast(left)
    rows = materialize(docs.join(left.select("doc_id").distinct(), "doc_id").mapInArrow(_rows(k), "doc_id long, shingle long").distinct(), "shingles")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = materialize(common.withColumn("_df", F.col("n")), "common")
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = join_skewed(rows, common, ["shingle"], "n")
    # shingles of one document only come first in the order: so many of the prefix are used up by them
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("_df", "shingle"))
    some = shared.withColumns({"_i": order, "_s": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))}).join(sizes, "doc_id").join(several.withColumn("_all", F.lit(True)), "doc_id", "left")
    most = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - (F.col("n") - F.col("_s"))
    of_one = lambda x: F.when(F.col("_all"), None).otherwise(x)
    some = some.where((F.col("_i") <= most) | F.col("_all")).select("doc_id", of_one(F.col("n")).alias("n"), of_one(F.col("_i") + F.col("n") - F.col("_s")).alias("at"), "shingle")
    twice = some.groupBy("shingle").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("shingle")
    return some.join(twice, "shingle", "left_semi").join(left, "doc_id").select("doc_id", "component", "n", "at", "shingle")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Documents link if ``100 * |intersection| >= percent * |union|`` of their shingle sets. Null, empty and blank texts have
    no shingles and no links. Rows are told apart by doc_id: rows that repeat an id are one node, with the links of
    either; a null id links with nothing and is kept. Other columns of ``docs`` are not looked at.
    """
    docs = docs.select("doc_id", "text")
    sketch = materialize(docs.mapInArrow(_sketches(shingle), SKETCH), "sketch")
    known = sketch.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    members = materialize(known.select("doc_id", "set_key").join(reps, "set_key").select("doc_id", "rep").distinct(), "members")
    alone = known.join(reps.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"])
    alone = materialize(alone.dropDuplicates(["set_key"]).select("doc_id", "signature", "bands"), "reps")

    signatures = alone.select("doc_id", "signature")
    rows = alone.select("doc_id", F.explode("bands").alias("key"))
    pivots = rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_other"), F.count(F.lit(1)).alias("n")).where("pivot < _other")
    pivots = materialize(pivots.select("key", "pivot", "n"), "pivots")
    buckets = materialize(join_skewed(rows, pivots.withColumn("_n", F.col("n")), ["key"], "_n"), "buckets")
    stars = materialize(buckets.join(signatures, "doc_id").select("key", "doc_id", "pivot", "signature", "n"), "stars")
    centres = materialize(stars.where("doc_id = pivot").select("key", "pivot", F.col("signature").alias("sig_a"), "n"), "centres")
    links = _confirmed(_likely(stars.select("key", "doc_id", "signature"), centres, percent), docs, shingle, percent)
    several = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")  # ids of several texts
    inside = buckets.where("n > 2").select("key", "doc_id")
    for turn in range(TURNS + 1):
        found = components(links)
        links = found.where("doc_id <> component").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))  # all that later steps need of them
        inside = inside.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        inside = materialize(_open(inside), "open")
        if turn == 0:
            bounds, longer = _bounds(inside.select("doc_id").distinct(), docs, shingle)
            inside = inside.join(bounds.join(several, "doc_id", "left_anti"), "doc_id", "left").where("n is null or 100 * most >= %d * n" % percent)
            inside = materialize(_open(inside), "open")
        sizes = inside.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("_n"))
        sizes = sizes.groupBy("key").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_n")).alias("_own"))
        n_rows, apart = sizes.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_n") - F.col("_own"))).first()
        if turn == TURNS or (apart or 0) <= 2 * PIVOTS * (n_rows or 0):
            break
        signed = materialize(inside.join(longer.select("doc_id", "signature"), "doc_id"), "signed")
        theirs = {"doc_id": "pivot", "component": "_c", "n": "_n", "most": "_most", "parts": "_parts", "signature": "sig_a"}
        picked = [F.min(F.struct(F.xxhash64(F.lit(turn * PIVOTS + i), "doc_id").alias("h"), *(F.col(c).alias(x) for c, x in theirs.items()))) for i in range(PIVOTS)]
        more = materialize(signed.groupBy("key").agg(F.array_distinct(F.array(*picked)).alias("_p"), F.count(F.lit(1)).alias("_rows")), "more")
        stars = join_skewed(signed, more, ["key"], "_rows").select("doc_id", "component", "n", "most", "parts", F.col("signature").alias("sig_b"), F.inline("_p"))
        stars = stars.where((F.col("component") != F.col("_c")) & _possible(percent) & ~unlike(percent, LONG))
        new = _confirmed(stars.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct(), docs, shingle, percent)
        links = links.union(new)
        inside = inside.drop("component")

    # what is left: documents that share one of their rarest shingles, without which two sets can't reach the threshold
    left = materialize(inside.select("doc_id", "component").distinct(), "left")
    bounded = materialize(inside.select("doc_id", "n", "most", "parts").distinct(), "bounded")
    rest = materialize(_prefixes(left, several, docs, shingle, percent), "prefixes")
    one = rest.withColumnsRenamed({"doc_id": "a", "component": "_c", "n": "_n", "at": "_at"})
    two = rest.withColumnRenamed("doc_id", "b")
    apart = (F.col("a") < F.col("b")) & (F.col("_c") != F.col("component")) & F.coalesce(_meets(percent), F.lit(True))
    rest = materialize(one.join(two, "shingle").where(apart).select("a", "b").distinct(), "met")
    rest = rest.join(longer.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a")), "a").join(longer.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b")), "b")
    rest = rest.where(~unlike(percent, LONG)).select("a", "b").distinct()
    theirs = bounded.select(F.col("doc_id").alias("a"), F.col("n").alias("_n"), F.col("most").alias("_most"), F.col("parts").alias("_parts"))
    rest = rest.join(bounded.withColumnRenamed("doc_id", "b"), "b").join(theirs, "a").where(_possible(percent)).select("a", "b").distinct()
    links = links.union(_confirmed(rest, docs, shingle, percent))

    # ids that repeat with several texts belong to several classes, and tie these together
    ties = members.join(several, "doc_id", "left_semi").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(ties))
    of = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    of = of.join(final.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    of = of.select("doc_id", F.coalesce("component", "rep").alias("component"))
    component: Column = F.coalesce("component", "doc_id")
    return (
        sketch.select("doc_id", "n_shingles").join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with shingles of four words."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=4)


#: Every pair that shares a shingle is counted here.
OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END g FROM d),
u AS (SELECT doc_id, len(g) n, unnest(g) g FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(doc_id, root) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id AND t.root < e.b),
c AS (SELECT doc_id, min(root) component_id FROM t GROUP BY doc_id)
SELECT s.doc_id, len(g)::BIGINT n_shingles, component_id, coalesce(component_id = s.doc_id, true) kept FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""
