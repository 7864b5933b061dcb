"""Exact top-k search: dual-tree cover-tree search by inner product.

1. The top of a cover tree, pivots far from each other taken from a bounded sample, cuts the space into cells, for rows and queries alike; a
   cell with more rows than a block holds is dealt over several. Each block gets a cover tree, those of queries with small
   leaves, as queries are few.
2. Each query block is searched in the blocks of its own cell first, which gives most queries a good k-th score.
3. From there on a query block goes only to those blocks in which one of its queries could find something better than its worst k-th score,
   by the block's centre and radius, and takes its scores along. Inside, a pair of nodes is passed over if even the best
   inner product that centres and covering radii, or angles and norms, allow is below the worst k-th score in the query node.

Blocks of rows are shuffled once, into groups of GROUP blocks; a query block travels once to a group, with the list of its blocks there, and
keeps its scores from block to block. Vectors without structure leave nothing to prune: then all scores are computed, as in any exact search.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, materialize

BLOCK, QUERY_BLOCK, LEAF, QUERY_LEAF = 2048, 256, 32, 4
#: The pivots, MOST_PIVOTS at most, are taken from so many rows (those of the smallest hashes); every row is then in a cell.
SAMPLE, MOST_PIVOTS = 2048, 256
#: Blocks that a query block is held against in one go.
CHUNK = 1024
#: Blocks whose trees one task holds at a time.
GROUP = 32
EVERY = 50
NONE = -(1 << 62)


class CoverTree:
    """Nodes over points in an order in which each node's points are consecutive.

    A node covers its points by a centre, one of them, and a radius, and by an angle and the bounds of their norms. Its children are balls of
    half the radius around points that are further than that from each other's centres; balls of up to ``leaf`` points that lie close together
    are leaves. The points of balls of fewer than ``loose`` are the node's last level: each is a node of radius 0, and they stand in front of
    the children so that their bounds are found together.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, loose: int = LEAF // 4) -> None:
        self.leaf, self.loose = leaf, loose
        n = len(points)
        x = points.astype(np.float64)
        norms = np.einsum("ij,ij->i", x, x)
        self.order: list[int] = []
        self.nodes: list[tuple[int, float, int, int, int, list[int]]] = []  # centre, radius, start, end of the loose points, end, children
        #: Of each node: the greatest angle between its centre and a point, the greatest and the least norm.
        self.caps: list[tuple[float, float, float]] = []
        self._gram = x @ x.T if n else np.zeros((0, 0))
        self._norms = np.sqrt(norms)
        self._away = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * self._gram, 0.0))
        if n:
            self._build(np.arange(n), 0)
        del self._away, self._gram, self._norms

    def _cap(self, idx: np.ndarray, centre: int) -> tuple[float, float, float]:
        norms = self._norms[idx]
        most, least = float(norms.max()), float(norms.min())
        if least == 0:
            return float(np.pi), most, least
        cos = (self._gram[centre, idx] / (norms * self._norms[centre])).min()
        return float(np.arccos(np.clip(cos, -1.0, 1.0))), most, least

    def _build(self, idx: np.ndarray, centre: int) -> int:
        away = self._away[centre, idx]
        radius, start, me = float(away.max()), len(self.order), len(self.nodes)
        self.nodes.append((centre, radius, start, 0, 0, []))
        self.caps.append(self._cap(idx, centre))
        balls, rest = [], idx
        if len(idx) > self.leaf and radius > 0:
            c = centre
            while len(rest):
                near = self._away[c, rest] <= radius / 2
                balls.append((c, rest[near]))
                rest = rest[~near]
                if len(rest):
                    c = int(rest[0])
        loose = [b for _, b in balls if len(b) < self.loose] if balls else [idx]
        for b in loose:
            self.order += b.tolist()
        middle, children = len(self.order), []
        for c, b in balls:
            if len(b) >= self.loose:
                children.append(self._build(b, c))
        self.nodes[me] = (centre, radius, start, middle, len(self.order), children)
        return me


class Block:
    """Vectors with their tree; all in the tree's order. ``times``: how often each row is there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, loose: int = LEAF // 4, times: np.ndarray | None = None) -> None:
        tree = CoverTree(vectors, leaf, loose)
        place = np.empty(len(ids), np.int64)
        order = np.array(tree.order, np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.vectors = ids[order], vectors[order]
        self.times = np.ones(len(ids), np.int64) if times is None else times[order]
        self.caps = tree.caps
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.nodes = [(int(place[c]), r, s, m, e, kids) for c, r, s, m, e, kids in tree.nodes]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where all sums stay under 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 1 << 53 else a @ b.T


class DualSearch:
    """The k best candidates of every query of a block pair; equal scores go to the smaller id, a query's own id is left out.

    ``floor``: scores that k candidates elsewhere reach; worse ones are of no use. ``computed``: how many scores were.
    """

    def __init__(self, queries: Block, refs: Block, k: int, floor: np.ndarray | None = None) -> None:
        self.q, self.k, self.computed = queries, k, 0
        self.scores = np.full((len(queries.ids), k), NONE, np.int64)
        self.found = np.full((len(queries.ids), k), np.iinfo(np.int64).max, np.int64)
        self.times = np.zeros((len(queries.ids), k), np.int64)
        self.floor = np.full(len(queries.ids), NONE, np.int64) if floor is None else floor
        self.search(refs)

    def search(self, refs: Block) -> None:
        """Look through one more block."""
        self.r = refs
        if len(self.q.ids) and len(refs.ids):
            self._visit(0, 0)

    def _worst(self, start: int, end: int) -> int:
        """What a candidate must reach to be of use to one of these queries."""
        return np.maximum(self.scores[start:end, -1], self.floor[start:end]).min()

    def _bound(self, qc: np.ndarray, qr: float, qn: float, places: np.ndarray, radii, q_cap: tuple | None = None, caps: np.ndarray | None = None) -> np.ndarray:
        """What inner products between two balls can reach, with room for rounding: by radii, and by angles where caps are given."""
        mid = self.r.vectors[places].astype(np.float64) @ qc.astype(np.float64)
        norms = self.r.norms[places]
        most = mid + qn * radii + norms * qr + qr * radii
        if caps is not None:
            angle, top, low = q_cap if q_cap is not None else (0.0, qn, qn)
            with np.errstate(divide="ignore", invalid="ignore"):
                between = np.where(qn * norms > 0, np.arccos(np.clip(mid / (qn * norms), -1.0, 1.0)), 0.0)
            cos = np.cos(np.maximum(0.0, between - angle - caps[:, 0] - 1e-7))
            most = np.minimum(most, np.where(cos > 0, top * caps[:, 1] * cos, low * caps[:, 2] * cos))
        return most + 1e-9 * (np.abs(mid) + (qn + qr) * (norms + radii)) + 1e-6

    def _visit(self, a: int, b: int) -> None:
        c, radius, start, middle, end, kids = self.q.nodes[a]
        rc, rr, *_ = self.r.nodes[b]
        cap = self.q.caps[a]
        if self._bound(self.q.vectors[c], radius, self.q.norms[c], np.array([rc]), rr, cap, np.array([self.r.caps[b]]))[0] < self._worst(start, end):
            return
        if middle > start:  # each loose query by itself where there are few: its own radius is 0
            if kids:
                for i in range(start, middle):
                    self._group(i, i + 1, self.q.vectors[i], 0.0, self.q.norms[i], b)
            else:
                self._group(start, middle, self.q.vectors[c], radius, self.q.norms[c], b, cap)
        for kid in kids:
            self._visit(kid, b)

    def _group(self, start: int, end: int, c: np.ndarray, radius: float, norm: float, b: int, cap: tuple | None = None) -> None:
        """The loose queries of a node against a candidate node, nearest candidates first."""
        _, _, r0, r1, _, kids = self.r.nodes[b]
        if r1 > r0:
            places = np.arange(r0, r1)
            places = places[self._bound(c, radius, norm, places, 0.0) >= self._worst(start, end)]
            if len(places):
                self._merge(start, end, places)
        if kids:
            nodes = [self.r.nodes[x] for x in kids]
            bounds = self._bound(c, radius, norm, np.array([x[0] for x in nodes]), np.array([x[1] for x in nodes]), cap, np.array([self.r.caps[x] for x in kids]))
            for i in np.argsort(-bounds):
                if bounds[i] < self._worst(start, end):
                    break
                self._group(start, end, c, radius, norm, kids[i], cap)

    def _merge(self, start: int, end: int, places: np.ndarray) -> None:
        places = places[np.argsort(self.r.ids[places], kind="stable")]
        ids, times, s = self.r.ids[places], self.r.times[places], inner(self.q.vectors[start:end], self.r.vectors[places])
        self.computed += s.size
        s[self.q.ids[start:end, None] == ids[None, :]] = NONE
        rows = np.flatnonzero(s.max(axis=1) >= np.maximum(self.scores[start:end, -1], self.floor[start:end]))
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            t = s[part]
            if t.shape[1] > 4 * self.k:  # all that reach the k-th best, then the first of equals by id
                kth = np.partition(t, t.shape[1] - self.k, axis=1)[:, t.shape[1] - self.k]
                above = t > kth[:, None]
                equal = t == kth[:, None]
                keep = above | (equal & (np.cumsum(equal, axis=1) <= (self.k - above.sum(axis=1))[:, None]))
                pick = np.nonzero(keep)[1].reshape(len(part), self.k)
                t, new, often = np.take_along_axis(t, pick, axis=1), ids[pick], times[pick]
            else:
                new, often = np.broadcast_to(ids, t.shape), np.broadcast_to(times, t.shape)
            scores = np.concatenate([self.scores[start + part], t], axis=1)
            found = np.concatenate([self.found[start + part], new], axis=1)
            often = np.concatenate([self.times[start + part], often], axis=1)
            order = np.lexsort((found, -scores), axis=-1)[:, : self.k]
            self.scores[start + part] = np.take_along_axis(scores, order, axis=1)
            self.found[start + part] = np.take_along_axis(found, order, axis=1)
            self.times[start + part] = np.take_along_axis(often, order, axis=1)


def _matrix(rows: list[list[int]], wide: int) -> np.ndarray:
    """Shorter vectors end in zeros."""
    return np.array([r + [0] * (wide - len(r)) for r in rows], np.int64).reshape(len(rows), wide)


def pivots_of(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of ``sample`` far from each other, each the farthest from those before: the top of a cover tree."""
    x = sample.astype(np.float64)
    away, chosen = np.full(len(x), np.inf), []
    while len(chosen) < min(most, len(x)) and (not chosen or away.max() > 0):
        chosen.append(0 if not chosen else int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _celled(pivots: np.ndarray):
    """Adds the nearest pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            cells = []
            for at in range(0, len(batch), 2048):
                rows = batch.column("v")[at : at + 2048].to_pylist()
                x = _matrix([r[: pivots.shape[1]] for r in rows], pivots.shape[1]).astype(np.float64)
                cells.append((half - x @ pivots.T).argmin(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "n")), pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32))], ["vec_id", "v", "n", "cell"])

    return run


def _built(leaf: int, loose: int):
    """A block's tree; its centre, radius and number of rows."""

    def build(table: pa.Table) -> pa.Table:
        rows = table.column("v").to_pylist()
        vectors = _matrix(rows, max(map(len, rows)))
        mean = vectors.mean(axis=0)
        centre = int(((vectors - mean) ** 2).sum(axis=1).argmin())  # the tree's root is centred
        order = np.append(centre, np.delete(np.arange(len(rows)), centre))
        ids, times, vectors = table.column("vec_id").to_numpy()[order], table.column("n").to_numpy()[order], vectors[order]
        radius = float(np.sqrt(((vectors - vectors[0]).astype(np.float64) ** 2).sum(axis=1)).max())
        root = vectors[0].tolist()
        if np.abs(vectors).max(initial=0) < 1 << 31:
            vectors = vectors.astype(np.int32)
        raw = pickle.dumps(Block(ids, vectors, leaf, loose, times), protocol=5)
        return pa.table({
            "block": table.column("block")[:1], "cell": table.column("cell")[:1], "centre": pa.array([root], pa.list_(pa.int64())), "radius": pa.array([radius]), "tree": pa.array([raw], pa.binary())
        })

    return build


BUILT = "block long, cell int, centre array<long>, radius double, tree binary"


def _blocks(rows: DataFrame, size: int, leaf: int, loose: int, name: str) -> DataFrame:
    """Trees of blocks of about ``size`` rows: a cell's rows are dealt by hash over as many as it needs."""
    cells = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_parts"))
    rows = rows.join(F.broadcast(cells), "cell")  # a row for each pivot
    part = F.pmod(F.xxhash64("vec_id", "v"), "_parts")
    dealt = rows.select("vec_id", "v", "n", "cell", (F.col("cell") + F.lit(MOST_PIVOTS) * part).cast("long").alias("block"))
    return materialize(dealt.groupBy("block").applyInArrow(_built(leaf, loose), BUILT), name)


def _searched(k: int):
    """Of rows sorted by group, its blocks' trees first: the k best of each query block that comes along, in the blocks that it asks for."""

    def wide(x: Block, n: int) -> Block:
        if x.vectors.shape[1] != n or x.vectors.dtype != np.int64:
            x.vectors = np.pad(x.vectors, ((0, 0), (0, n - x.vectors.shape[1]))).astype(np.int64)
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, refs, most = None, {}, 0
        for batch in batches:
            for i in range(len(batch)):
                g, q = batch.column("group")[i].as_py(), batch.column("asked")[i].as_py()
                raw = pickle.loads(batch.column("tree")[i].as_py())
                if g != group:
                    group, refs, most = g, {}, 0
                if q is None:
                    refs[batch.column("blocks")[i][0].as_py()] = raw
                    most = max(most, raw.vectors.shape[1])
                    continue
                floor = batch.column("floor")[i]
                raw = wide(raw, max(most, raw.vectors.shape[1]))
                search = None
                for b in batch.column("blocks")[i].as_py():
                    block = wide(refs[b], raw.vectors.shape[1])
                    if search is None:
                        search = DualSearch(raw, block, k, floor.values.to_numpy() if floor.is_valid else None)
                    else:
                        search.search(block)
                if search is not None:
                    ok = search.scores.ravel() > NONE
                    times = (np.minimum(raw.times, k)[:, None] * np.minimum(search.times, k)).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(ok.sum()), q)), *(pa.array(x[ok]) for x in (np.repeat(raw.ids, k), search.found.ravel(), search.scores.ravel(), times))], ["asked", "query_id", "vec_id", "score", "times"]
                    )

    return run


def _search(blocks: DataFrame, routes: DataFrame, k: int, name: str) -> DataFrame:
    """Query blocks (group, asked, blocks, tree, floor) meet the trees of the groups they go to."""
    trees = blocks.select("group", F.lit(None).cast("long").alias("asked"), F.array("block").alias("blocks"), "tree", F.lit(None).cast("array<long>").alias("floor"))
    both = trees.join(routes.select("group").distinct(), "group", "left_semi").unionByName(routes)
    both = both.repartition("group").sortWithinPartitions("group", F.col("asked").asc_nulls_first())
    return materialize(both.mapInArrow(_searched(k), "asked long, query_id long, vec_id long, score long, times long"), name)


def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a query block and a chunk of blocks (of other cells): by group, those where one of the queries could find what it needs, the most
    promising first."""
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            queries, floors = pickle.loads(row["tree"].as_py()), dict(zip(row["ids"].as_py() or [], row["scores"].as_py() or [], strict=True))
            floor = np.array([floors.get(q, NONE) for q in queries.ids.tolist()], np.int64)
            centres = row["centres"].as_py()
            wide = max(queries.vectors.shape[1], max(map(len, centres)))
            x = np.pad(queries.vectors, ((0, 0), (0, wide - queries.vectors.shape[1]))).astype(np.float64)
            mid = x @ _matrix(centres, wide).astype(np.float64).T
            reach = queries.norms[:, None] * row["radii"].values.to_numpy()[None, :]
            useful = mid + reach + 1e-9 * (np.abs(mid) + reach) + 1e-6 >= floor[:, None]
            to = np.flatnonzero(useful.any(axis=0) & (row["cells"].values.to_numpy() != row["cell"].as_py()))
            groups, blocks = row["groups"].values.to_numpy()[to], row["blocks"].values.to_numpy()[to]
            best = (mid + reach).max(axis=0)[to]
            for g in np.unique(groups).tolist():
                here = np.flatnonzero(groups == g)
                asked = blocks[here[np.argsort(-best[here], kind="stable")]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int64()), pa.array([row["asked"].as_py()], pa.int64()), pa.array([asked.tolist()], pa.list_(pa.int64())), pa.array([row["tree"].as_py()], pa.binary()), pa.array([floor.tolist()], pa.list_(pa.int64()))],
                    ["group", "asked", "blocks", "tree", "floor"],
                )


def whole(embedding: Column) -> Column:
    """floor(256 x) of each component, as a double; null if the vector or one of its components is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of ``vectors`` (vec_id, v: array of whole numbers) for each of ``queries`` (alike) by inner product: query_id, rank
    (from 1), vec_id, score.

    Rows with a null id or vector take no part; a query's own id is no candidate; equal scores go to the smaller id; fewer candidates
    give fewer rows. A row that is repeated counts as often as it is there, as a candidate and as a query; rows that repeat a query's id with
    other vectors are queries of that id too, and its k best are the best of all their pairs. Shorter vectors count as if they ended in zeros.
    """
    # before rows are counted and dealt: equal rows would meet in one block, however many
    good = "vec_id is not null and v is not null"
    vectors, queries = (materialize(d.select("vec_id", "v").where(good).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "vectors") for d in (vectors, queries))
    n = vectors.count()
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(SAMPLE).collect()]
    pivots = pivots_of(_matrix(sample, max(map(len, sample), default=0)), max(1, min(MOST_PIVOTS, -(-n // BLOCK))))
    if not len(pivots):
        pivots = np.zeros((1, 0))
    vectors, queries = (d.mapInArrow(_celled(pivots), "vec_id long, v array<long>, n long, cell int") for d in (vectors, queries))
    groups = max(1, -(-n // (BLOCK * GROUP)), min(-(-n // BLOCK), vectors.sparkSession.sparkContext.defaultParallelism))
    blocks = _blocks(vectors, BLOCK, LEAF, LEAF // 4, "blocks").withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = _blocks(queries, QUERY_BLOCK, QUERY_LEAF, 2, "asked").select(F.col("block").alias("asked"), "cell", "tree")

    none = F.lit(None).cast("array<long>").alias("floor")
    own = blocks.groupBy("cell", "group").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    first = _search(blocks, asked.join(own, "cell").select("group", "asked", "blocks", "tree", none), k, "own")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    kth = first.select("query_id", "vec_id", "score").distinct().withColumn("_r", rank).where(F.col("_r") == k).select("query_id", "score")
    kth = first.select("asked", "query_id").distinct().join(kth, "query_id").groupBy("asked").agg(F.collect_list(F.struct("query_id", "score")).alias("_f"))
    kth = kth.select("asked", F.col("_f.query_id").alias("ids"), F.col("_f.score").alias("scores"))
    # the blocks' centres and radii in chunks of whole groups, and each query block beside each chunk
    parts = max(1, -(-groups * GROUP // CHUNK))
    chunk = F.pmod("group", F.lit(parts)).alias("chunk")
    chunks = blocks.select(chunk, F.struct("block", "group", "cell", "centre", "radius").alias("_b")).groupBy("chunk").agg(F.collect_list("_b").alias("_b"))
    chunks = chunks.select("chunk", *(F.col(f"_b.{c}").alias(a) for c, a in (("block", "blocks"), ("group", "groups"), ("cell", "cells"), ("centre", "centres"), ("radius", "radii"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    pairs = asked.join(kth, "asked", "left").withColumn("chunk", every).join(chunks, "chunk")
    routes = pairs.mapInArrow(_routed, "group long, asked long, blocks array<long>, tree binary, floor array<long>")
    found = first.unionByName(_search(blocks, materialize(routes, "routes"), k, "others"))
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, candidates all others."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", whole(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 5)


OP3_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
