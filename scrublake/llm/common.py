"""What several operators share: tables written to the shared folder, global row numbers, hashing of words.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes; bytes from 0x80 on never separate, so byte-wise work is exact.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that the vectorised word code looks at in one go.
CHUNK_BYTES = 1 << 19


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), a temporary folder set once a session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.scrublake.shared.dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="scrublake-")
            spark.conf.set("spark.scrublake.shared.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "t", parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and any executor can read it.

    ``parts``: files at most, for tables known to be small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scrublake-{name}-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- global row numbers


def with_row_number(df: DataFrame, *order: str, name: str = "row_no") -> tuple[DataFrame, int]:
    """Row numbers from 0 in the order of ``order`` (nulls first), and the number of rows.

    Rows are dealt by range and sorted within partitions; the number is the place in the partition plus the rows of
    the partitions before. Only one row per partition meets in one task. Rows equal in all of ``order`` are taken in
    any order, so give enough columns to make such rows interchangeable.
    """
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "rows",
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row for each partition of the range exchange
        .withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33))
    )
    return numbered.drop("_at", "_part", "_before"), int(total)


#: A key is hot from so many rows on, and from this share of all rows.
HOT_ROWS, HOT_SHARE = 1024, 4096


def join_skewed(big: DataFrame, small: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, a written table with a row for each key and in ``n`` the number of big's rows of it (n isn't
    returned). Rows of hot keys are dealt over as many parts as it takes; the few hot keys, HOT_SHARE at most, are broadcast.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    part = max(HOT_ROWS, -(-int(total) // HOT_SHARE))
    small = small.withColumn("_salts", F.ceil(F.col(n) / part).cast("int")).drop(n)
    hot = F.broadcast(small.where("_salts > 1").select(*keys, F.col("_salts").alias("_over")))
    salt = F.when(F.col("_over").isNotNull(), F.pmod(F.xxhash64(*big.columns), "_over")).otherwise(0).cast("int")
    big = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_over")
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest("_salts", F.lit(1)) - 1))).drop("_salts")
    return big.join(small, [*keys, "_salt"]).drop("_salt")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- what a worker keeps

_KEPT: dict = {}
#: Longer words are not remembered.
LONG_WORD = 64


class Memory:
    """Values of words, bounded in bytes: when the young generation is full, it becomes the old one, and what the old one had and wasn't
    asked for is forgotten."""

    def __init__(self, most: int) -> None:
        self.most, self.held, self.young, self.old = most // 2, 0, {}, {}

    def look(self, words: list, make) -> list:
        """The words' values; ``make`` gives those of a list of words that aren't known. Words must be distinct."""
        out = list(map(self.young.get, words))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        old, new = self.old, []
        for i in missing:
            v = out[i] = old.get(words[i])
            if v is None:
                new.append(i)
        for i, v in zip(new, make([words[i] for i in new]) if new else (), strict=True):
            out[i] = v
        for i in missing:
            self._keep(words[i], out[i])
        return out

    def _keep(self, word, value) -> None:
        if len(word) <= LONG_WORD:
            self.young[word] = value
            self.held += 220 + len(word) + len(value)  # two objects and their place in a dict
            if self.held > self.most:
                self.young, self.old, self.held = {}, self.young, 0


def kept_by_worker(key, make):
    """What ``make`` gives, kept from task to task; only one such thing at a time, so that memories of several operators don't add up."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what other operators have kept in this worker, and give memory back."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


# ---------------------------------------------------------------- hashing of words, vectorised


def splitmix(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = splitmix(11, 256)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_P = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, CHUNK_BYTES + 1)
        _POWERS["up"] = np.cumprod(np.full(m, _P, np.uint64))
        _POWERS["down"] = np.cumprod(np.full(m, pow(_P, -1, 1 << 64), np.uint64))
    return _POWERS["up"], _POWERS["down"]


def _hash_chunk(buf: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a chunk; no word reaches over a cut."""
    w = ~SPACE[buf]
    if not w.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    at = cuts[(cuts > 0) & (cuts < len(buf))]
    first[at] = w[at]
    last[at - 1] = w[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mixed(h), starts, ends


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False):
    """64-bit hashes of the words of texts lying one after another in ``buf``, and where each text's words begin.

    Works in chunks of CHUNK_BYTES; texts longer than that are cut at white space, so memory is bounded by the chunk
    and the hashes. With ``spans``, the words' byte positions too.
    """
    table = _LOWER if lower else _EXACT
    end, pos, parts = int(offsets[-1]), int(offsets[0]), []
    while pos < end:
        stop = min(end, pos + CHUNK_BYTES)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > pos:
                stop = int(offsets[k])
            else:  # inside a long text: go on to the next white space or the text's end
                limit = int(offsets[k + 1])
                while stop < limit and not SPACE[buf[stop]]:
                    step = SPACE[buf[stop : min(limit, stop + 4096)]]
                    stop += int(step.argmax()) if step.any() else len(step)
        lo, hi = np.searchsorted(offsets, [pos, stop])
        h, s, e = _hash_chunk(buf[pos:stop], np.asarray(offsets[lo:hi]) - pos, table)
        parts.append((h, s + pos, e + pos))
        pos = stop
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    starts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    begins = np.searchsorted(starts, offsets)
    if not spans:
        return hashes, begins
    ends = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    return hashes, begins, starts, ends


def runs_of(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash for every k consecutive entries (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(splitmix(seed, k)):
        out += hashes[j : j + n] * m
    return mixed(out)


def text_buffers(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into pieces of about ``most`` bytes: first row, row after the last, bytes, offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[to])
        yield row, to, buf[a:b], offsets[row : to + 1] - a
        row = to
