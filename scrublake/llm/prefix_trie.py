"""Conversation prefix trie, built level by level: what training on shared beginnings once would save.

1. Conversations of equal turns are one class, with the smallest conv_id; only classes go on.
2. Per depth, live classes are grouped by (parent node, next turn); a group is a node, told by its depth and its smallest conv_id. A class
   that is alone in its node leaves: below, it is a chain that needs no grouping. So there are as many steps as the longest beginning
   that two different conversations share.
3. In reverse, each level's nodes gather leaves and savings of their children by a join.

Turns are rows (conv_id, depth, key, words), never gathered by conversation; the key is 128 bits of a SHA-256. Large conversations, common
turns and groups of copies are dealt out by ``join_skewed``, and counts are made before shuffles.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_skewed, load, materialize, shared_dir, with_row_number, word_count

#: Members of an ended node that are written in one piece, before the pieces are hashed in order.
PIECE = 4096
#: Fixed values of the rebuilding: conversations of a block begin with up to DRAWN - 1 turns of its first one.
BLOCK, DRAWN = 20, 4
_MADE = ("node", "n_convs", "n_classes", "words", "n_turns", "end_rep", "end_weight")
_EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, key, words) in the order of ``turn``, nulls first, and conversations (conv_id, n_turns).

    Null role or text counts as empty; turns of equal number come in the order of their keys; rows without a conv_id are left out. Other
    columns are not looked at.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("key"), word_count(text).alias("words"))
    rows, _ = with_row_number(materialize(rows, "turns"), "conv_id", "turn", "key")
    convs = materialize(rows.groupBy("conv_id").agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("n_turns")), "convs")
    turns = join_skewed(rows.drop("turn"), convs.withColumn("n", F.col("n_turns")).drop("n_turns"), ["conv_id"], "n")
    return materialize(turns.select("conv_id", (F.col("row_no") - F.col("_first") + 1).alias("depth"), "key", "words"), "turns"), convs.drop("_first")


def rebuilt(turns: DataFrame, convs: DataFrame, block: int = BLOCK, drawn: int = DRAWN) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first h turns of the first one of its block in place of its own first h; h is the CRC-32 of the id, modulo
    ``drawn``. All of them if there are fewer, none if that conversation is absent."""
    c = convs.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % block).alias("_base"), (F.crc32(F.col("conv_id").cast("string")) % drawn).alias("_h"))
    bases = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.col("n_turns").alias("_n"))
    put = F.least("_h", F.coalesce("_n", F.lit(0).cast("long")))
    c = materialize(c.join(bases, "_base", "left").withColumn("_put", put).drop("_n"), "rebuilt")
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("depth") < drawn)).select(F.col("conv_id").alias("_base"), "depth", "key", "words")
    shared = c.join(heads, "_base").where(F.col("depth") <= F.col("_h")).select("conv_id", "depth", "key", "words")
    own = join_skewed(turns, c.select("conv_id", "_h", "_put", F.col("n_turns").alias("n")), ["conv_id"], "n")
    own = own.where(F.col("depth") > F.col("_h")).select("conv_id", (F.col("depth") - F.col("_h") + F.col("_put")).alias("depth"), "key", "words")
    return shared.union(own), c.select("conv_id", (F.col("_put") + F.greatest(F.col("n_turns") - F.col("_h"), F.lit(0))).alias("n_turns"))


def _classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal turns (conv_id, the smallest; weight, how many; n_turns), and the members (conv_id, rep) of those of several."""
    whole = [F.bit_xor(F.xxhash64(F.lit(i), "depth", "key")).alias(f"_x{i}") for i in range(2)]
    c = convs.join(turns.groupBy("conv_id").agg(*whole), "conv_id", "left").na.fill(0, ["_x0", "_x1"])
    same = ["n_turns", "_x0", "_x1"]
    c = materialize(c, "sequences")
    classes = materialize(c.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    several = classes.where("weight > 1").select(*same, "rep", F.col("weight").alias("n"))
    members = join_skewed(c, materialize(several, "several"), same, "n").select("conv_id", "rep")
    return classes.select(F.col("rep").alias("conv_id"), "weight", "n_turns"), members


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each rep, joined by commas; rows come sorted by rep and piece."""
    rep, state, reps, digests = None, None, [], []
    for batch in batches:
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if r != rep:
                if state is not None:
                    reps.append(rep)
                    digests.append(state.hexdigest())
                rep, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        reps.append(rep)
        digests.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(digests, pa.string())], ["rep", "_ends"])


def _ended(members: DataFrame) -> DataFrame:
    """The digest of each class's ids (rep, _ends): written in pieces of PIECE ids, of which one task reads a row each."""
    rows, _ = with_row_number(members, "rep", "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = rows.groupBy("rep", F.floor(F.col("row_no") / PIECE).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("rep").sortWithinPartitions("rep", "piece").select("rep", "ids").mapInArrow(_digests, "rep long, _ends string")


class _Levels:
    """Tables of one kind, a folder of the shared one for each level."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/scrublake-{name}-{uuid.uuid4().hex}", None

    def put(self, level: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/level={level}")
        self.schema = df.schema
        return self.get(level)

    def get(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level}")

    def every(self) -> DataFrame:
        return self.spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.schema)}, level long").parquet(self.path)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv_id, depth, key, words; depths from 1 without gaps) and ``convs`` (conv_id, n_turns, also 0).

    Per node: conv_id (smallest member), depth (0: the root), parent_conv_id (null for the root), n_convs, n_children, n_leaves of its
    subtree, saved_tokens of its subtree, ends_sha256 of the ids that end there. Without conversations there is no node.
    """
    spark = turns.sparkSession
    turns = materialize(turns.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "by_depth")  # a level reads its files
    classes, members = _classes(turns, convs)
    if not classes.head(1):
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    ends = lambda d, c, name: F.min(F.when(F.col("n_turns") == d, F.col(c))).alias(name)  # noqa: E731  one class at most ends in a node
    made = lambda d: [F.min("conv_id").alias("node"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("n_classes"), F.max("words").alias("words"), F.max("n_turns").alias("n_turns"), ends(d, "conv_id", "end_rep"), ends(d, "weight", "end_weight")]
    groups = _Levels(spark, "groups")
    none = F.lit(None).cast("long")
    root = groups.put(0, classes.withColumn("words", F.lit(0).cast("long")).agg(*made(0)).select(none.alias("parent"), F.lit(None).cast("binary").alias("key"), *_MADE))
    top = root.first()["node"]
    live, depth = classes.withColumn("node", F.lit(top).cast("long")), 0
    while True:
        depth += 1
        step = live.where(F.col("n_turns") >= depth).join(turns.where(F.col("depth") == depth).drop("depth"), "conv_id").withColumnRenamed("node", "parent")
        step = materialize(step.select("parent", "key", "conv_id", "weight", "n_turns", "words"), "step")
        level = groups.put(depth, step.groupBy("parent", "key").agg(*made(depth)).select("parent", "key", *_MADE))
        on = level.where("n_classes > 1").select("parent", "key", "node", F.col("n_classes").alias("n"))
        if not on.head(1):
            break
        live = materialize(join_skewed(step, on, ["parent", "key"], "n").select("conv_id", "weight", "n_turns", "node"), "live")

    # classes alone in their node go on as chains: each depth a node with the same members
    alone = groups.every().where("level > 0 and n_classes = 1").select(F.col("node").alias("conv_id"), "parent", F.col("n_convs").alias("weight"), "n_turns", F.col("level").alias("_from"), (F.col("n_turns") - F.col("level") + 1).alias("n"))
    chains = join_skewed(turns.drop("key"), materialize(alone, "alone"), ["conv_id"], "n").where(F.col("depth") >= F.col("_from"))
    rest = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    zero = F.lit(0).cast("long")
    copies = chains.where("weight > 1").withColumn("saved", F.sum((F.col("weight") - 1) * F.col("words")).over(rest))
    chains = chains.where("weight = 1").withColumn("saved", zero).unionByName(copies)
    last = F.col("depth") == F.col("n_turns")
    chains = materialize(
        chains.select(
            F.col("conv_id").alias("node"), "depth", F.when(F.col("depth") == F.col("_from"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent"), F.col("weight").alias("n_convs"),
            F.when(last, zero).otherwise(zero + 1).alias("n_children"), (zero + 1).alias("n_leaves"), "saved", F.when(last, F.col("conv_id")).alias("end_rep"), F.when(last, F.col("weight")).alias("end_weight"),
            (F.col("depth") == F.col("_from")).alias("_first"),
        ),
        "chains",
    )

    results = _Levels(spark, "nodes")
    for d in range(depth - 1, -1, -1):
        below = chains.where(F.col("_first") & (F.col("depth") == d + 1)).select("parent", "n_leaves", "saved")
        if d < depth - 1:
            below = below.unionByName(results.get(d + 1).select("parent", "n_leaves", "saved"))
        below = below.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        nodes = groups.get(d).where(F.lit(d == 0) | (F.col("n_classes") > 1)).join(below.withColumnRenamed("parent", "node"), "node", "left")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("_saved", zero)
        results.put(d, nodes.select("node", F.lit(d).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("_leaves", zero + 1).alias("n_leaves"), saved.alias("saved"), "end_rep", "end_weight"))

    nodes = results.every().drop("level").unionByName(chains.drop("_first"))
    one = F.when(F.col("end_weight") == 1, F.sha2(F.col("end_rep").cast("string"), 256)).otherwise(F.lit(_EMPTY))
    ended = nodes.where("end_weight > 1").join(_ended(members).withColumnRenamed("rep", "end_rep"), "end_rep").drop("end_rep", "end_weight")
    nodes = nodes.where("end_weight is null or end_weight = 1").withColumn("_ends", one).drop("end_rep", "end_weight").unionByName(ended)
    return nodes.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("_ends").alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt so that those of a block of twenty ids share beginnings."""
    return prefix_trie(*rebuilt(*ordered_turns(load(spark, sf_dir, "conversations"))))


#: Every prefix of every rebuilt conversation as a list; the table of the CRC-32 is made from its polynomial.
OP11_SQL = rf"""
WITH bits AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) tab FROM range(256) r(i)),
own AS (SELECT conv_id c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) o
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
drawn AS (SELECT c, o, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a // 256, tab[xor(a % 256, x) + 1])), 4294967295) % {DRAWN} h FROM own, bits),
again AS (SELECT a.c, list_concat(coalesce(b.o[1:a.h], a.o[1:0]), a.o[a.h + 1:]) s FROM drawn a LEFT JOIN own b ON b.c = a.c - a.c % {BLOCK}),
node AS (SELECT d, s[1:d] p, min(c) conv_id, count(*) n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '') e FROM (SELECT c, s, unnest(range(0, len(s) + 1)) d FROM again) GROUP BY ALL),
kids AS (SELECT d - 1 d, p[1:d - 1] p, count(*) k FROM node WHERE d > 0 GROUP BY ALL),
each AS (SELECT node.*, coalesce(k, 0) k, (n - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END saved FROM node LEFT JOIN kids USING (d, p)),
up AS (SELECT a d, p[1:a] p, count(*) FILTER (k = 0) leaves, sum(saved) saved FROM (SELECT p, k, saved, unnest(range(0, d + 1)) a FROM each) GROUP BY ALL)
SELECT x.conv_id::BIGINT conv_id, x.d::BIGINT depth, y.conv_id::BIGINT parent_conv_id, x.n::BIGINT n_convs, x.k::BIGINT n_children, up.leaves::BIGINT n_leaves, up.saved::BIGINT saved_tokens, sha256(x.e) ends_sha256
FROM each x JOIN up ON up.d = x.d AND up.p = x.p LEFT JOIN node y ON y.d = x.d - 1 AND y.p = x.p[1:x.d - 1]
"""
