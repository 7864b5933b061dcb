"""Substring dedup: suffix automata over reference shards, matching statistics, removal of spans above a length.

Streaming every document past the automata of all shards would be quadratic. Two windows of W words are equal only if their anchors are:
the smallest hash of the M-word runs inside. So texts are cut into segments, maximal runs of windows of one anchor, and the
reference is sharded by anchor; a segment is streamed past the automaton of its own anchor's shard only.

1. Anchors that only one document has can't repeat; of the other anchors' segments, each distinct one (by a 64-bit hash of its words and
   its anchor's smallest document) is looked at once, in the smallest document that holds it. Segments next to each other there make one
   span.
2. Anchors are dealt into shards by the smallest document that has them, so that what copies share stays together. A shard's spans make
   one suffix automaton, of which each state knows the smallest document that holds its words. A shard holds SHARD_WORDS
   words or so; one with more is dealt over several automata by anchor, and in it the segments of a hot anchor window by window, by the
   hash of the window's words. So a window meets one automaton, however many contexts an anchor has.
3. Where the matching statistic of a span reaches W, the state of the last W words tells the smallest holder of this window; in
   documents with a greater doc_id the window's words go.

Words are 64-bit hashes, and windows are equal if all 13 of these are. Counts are partial before any exchange and joins deal hot keys
over several tasks, so copies of a passage don't meet in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, forget, join_skewed, load, materialize, mixed, runs_of, text_buffers, words_of

M = 4
#: Words of an automaton, about; one of words that are all different has twice as many states at most, of some 300 bytes.
SHARD_WORDS = 1 << 16
#: Shards over these bounds are told by broadcast up to so many (20 bytes each), by a shuffle beyond.
BROADCAST_ROWS = 1 << 18
NOBODY = (1 << 63) - 1
ALL = [-1]
_Q = 0xD6E8FEB86659FD93


class SuffixAutomaton:
    """Suffix automaton over hashable symbols, extended one symbol at a time; several sequences may be added, each with its holder."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.holder = [NOBODY]

    def _clone(self, p: int, q: int, symbol) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.holder.append(NOBODY)  # what is below it in the tree of links tells
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, symbols, holder: int = 0) -> None:
        at = 0
        nexts, link, length, holders = self.next, self.link, self.length, self.holder
        for s in symbols:
            q = nexts[at].get(s)
            if q is not None:  # there already, from another sequence
                at = q if length[q] == length[at] + 1 else self._clone(at, q, s)
                if holder < holders[at]:
                    holders[at] = holder
                continue
            cur, p = len(nexts), at
            nexts.append({})
            length.append(length[at] + 1)
            holders.append(holder)
            while p >= 0:
                own = nexts[p]
                q = own.get(s)
                if q is not None:
                    break
                own[s] = cur
                p = link[p]
            link.append(0)  # before a clone, which takes the next number
            if p >= 0:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, s)
            at = cur

    def finish(self) -> None:
        """Each state's smallest holder, once all is added: of its own places and of those of the states that link to it."""
        holders, link = self.holder, self.link
        for v in np.argsort(self.length)[:0:-1].tolist():  # all but the root, which alone has length 0
            h, p = holders[v], link[v]
            if h < holders[p]:
                holders[p] = h

    def matching(self, symbols) -> list[int]:
        """For each place, the length of the longest run of symbols ending there that occurs in what was added."""
        out, v, n = [], 0, 0
        for s in symbols:
            while v and s not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if s in self.next[v]:
                v = self.next[v][s]
                n += 1
            out.append(n)
        return out

    def holders_of(self, symbols, window: int) -> list[int]:
        """For each window of symbols, the smallest holder of one equal to it; NOBODY: none. The matching statistic is cut at ``window``."""
        out, v, n = [], 0, 0
        nexts, link, length, holders = self.next, self.link, self.length, self.holder
        for s in symbols:
            q = nexts[v].get(s)
            while v and q is None:
                v = link[v]
                n = length[v]
                q = nexts[v].get(s)
            if q is not None:
                v = q
                n += 1
            if n >= window:
                while length[link[v]] >= window:
                    v = link[v]
                n = window
            out.append(holders[v] if n == window else NOBODY)
        return out[window - 1 :]


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive entries."""
    have, out = 1, g
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(words: np.ndarray, begins: np.ndarray, window: int):
    """First window, number of windows, anchor, hash and text number of the segments, and a hash of every window."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    anchors = _least(runs_of(words, M, seed=31), window - M + 1)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(anchors)]
    valid = np.arange(len(anchors)) + window <= begins[text + 1]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (anchors[1:] == anchors[:-1]))
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(valid & np.append(~valid[1:] | first[1:], True)) + 1
    lengths = ends - starts
    up = np.cumprod(np.full(len(words), _Q, np.uint64))
    down = np.cumprod(np.full(len(words), pow(_Q, -1, 1 << 64), np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))
    stop = starts + lengths + window - 1
    content = mixed((sums[stop] - sums[starts]) * down[starts] + lengths.astype(np.uint64)) if len(starts) else none.astype(np.uint64)
    return starts, lengths, anchors[starts], content, text[starts]


def _each(batch: pa.RecordBatch, window: int):
    """For pieces of a batch: first row, row after the last, words, begins and segments."""
    for row, to, buf, offsets in text_buffers(batch.column("text")):
        words, begins = words_of(buf, offsets)
        yield row, to, words, begins, segments(words, begins, window)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of one is small."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            yield batch.slice(at, 256)


def _flat(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.Array) -> list[list[int]]:
    """A list column without nulls, its values converted in one go."""
    at = column.offsets.to_numpy()
    flat = _flat(column.values[int(at[0]) : int(at[-1])])
    at = (at - at[0]).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for row, _, _, _, (_, _, anchor, _, text) in _each(batch, window):
                yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(ids[row + text])], ["anchor", "doc_id"])

    return run


_PIECE = "head long, content long, windows int, hot boolean, doc_id long"


def _pieces(window: int):
    """Segments with a shared anchor: the anchor's smallest document, what tells the segment's words, its windows, whether the anchor is hot, its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            ids = batch.column("doc_id").to_pylist()
            for row, to, _, _, (_, n, anchor, content, text) in _each(batch, window):
                cut = np.searchsorted(text, np.arange(to - row + 1))
                parts = []
                for i in range(to - row):
                    a, b = cut[i], cut[i + 1]
                    shared, heads, hots = (batch.column(c)[row + i].values.to_numpy(zero_copy_only=False) for c in ("anchors", "heads", "hots"))
                    order = np.argsort(shared)
                    place = np.minimum(np.searchsorted(shared, anchor[a:b].view(np.int64), sorter=order), len(shared) - 1)
                    ok = np.flatnonzero(shared[order[place]] == anchor[a:b].view(np.int64))
                    _, first = np.unique(content[a:b][ok], return_index=True)
                    ok = ok[first]
                    at = order[place[ok]]
                    parts.append((heads[at], content[a:b][ok].view(np.int64), n[a:b][ok].astype(np.int32), hots[at], np.full(len(ok), ids[row + i], np.int64)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)], ["head", "content", "windows", "hot", "doc_id"])

    return run


_SPAN = pa.schema([
    ("shard", pa.int64()), ("sub", pa.int32()), ("refers", pa.bool_()), ("asks", pa.bool_()), ("first", pa.int32()), ("holder", pa.int64()), ("words", pa.binary()),
    ("heads", pa.list_(pa.int64())), ("contents", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
SPAN = "shard long, sub int, refers boolean, asks boolean, first int, holder long, words binary, heads array<long>, contents array<long>, windows array<long>, counts array<long>"
#: ``first`` of rows with whole segments.
WHOLE = -1


def _spans(window: int):
    """The distinct segments of their smallest holders, as spans of one shard, with the automata that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            ids, todo = batch.column("doc_id").to_pylist(), batch.column("todo")
            begin = todo.offsets.to_pylist()
            heads, contents, shards, subs, hots, counts = (_flat(todo.values.field(c)) for c in ("head", "content", "shard", "subs", "hot", "n"))
            for row, to, words, _, (start, n, anchor, content, text) in _each(batch, window):
                out: list[tuple] = []
                cut = np.searchsorted(text, np.arange(to - row + 1))
                for i in range(to - row):
                    x, y = begin[row + i], begin[row + i + 1]
                    want = dict(zip(contents[x:y], range(x, y), strict=True))
                    a, b = cut[i], cut[i + 1]
                    span: list[tuple[int, int, tuple]] = []
                    place = (0, 0)
                    for s, k, c, m in zip(start[a:b].tolist(), n[a:b].tolist(), content[a:b].view(np.int64).tolist(), anchor[a:b].tolist(), strict=True):
                        t = want.pop(c, None)
                        apart = t is not None and hots[t] and subs[t] > 1
                        here = None if t is None or apart else (shards[t], m % subs[t])
                        if span and (here != place or s != span[-1][0] + span[-1][1]):
                            out.append(_placed(span, place, words, window, ids[row + i]))
                            span = []
                        if apart:
                            out += _by_window(s, k, (shards[t], subs[t]), (heads[t], c, counts[t]), words, window, ids[row + i])
                        elif t is not None:
                            span.append((s, k, (heads[t], c, counts[t])))
                            place = here
                    if span:
                        out.append(_placed(span, place, words, window, ids[row + i]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SPAN, strict=True)], schema=_SPAN)

    return run


def _placed(span: list[tuple[int, int, tuple]], place: tuple[int, int], words: np.ndarray, window: int, holder: int) -> tuple:
    """Row of a span, which is both reference and question."""
    raw = words[span[0][0] : span[-1][0] + span[-1][1] + window - 1].tobytes()
    return (*place, True, True, WHOLE, holder, raw, [t[0] for _, _, t in span], [t[1] for _, _, t in span], [k for _, k, _ in span], [t[2] for _, _, t in span])


def _by_window(s: int, k: int, dealt: tuple[int, int], told: tuple[int, int, int], words: np.ndarray, window: int, holder: int) -> Iterator[tuple]:
    """Rows of a segment of a hot anchor: each window's automaton is told by its words. Many segments may hold the same window, so it
    comes as a reference and once more as a question, which needn't wait in memory for the last reference."""
    (shard, over), (head, content, n) = dealt, told
    subs = [crc32(words[i : i + window].tobytes()) % over for i in range(s, s + k)]
    first = 0
    for i in range(1, k + 1):
        if i == k or subs[i] != subs[first]:
            raw = words[s + first : s + i + window - 1].tobytes()
            segs = ([head], [content], [i - first], [n])
            yield (shard, subs[first], True, False, first, holder, raw, *segs)
            yield (shard, subs[first], False, True, first, holder, raw, *segs)
            first = i


_HELD = pa.schema([("head", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("holders", pa.list_(pa.int64()))])
HELD = "head long, content long, n long, first int, holders array<long>"


def _streamed(window: int):
    """Of rows sorted by automaton, references first: the smallest holder of each window of the segments that are asked about; one for
    all, where they are equal and the segment is whole. Left out: whole segments of which one document only holds any window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, waiting, out = None, SuffixAutomaton(), [], []

        def answer(first: int, holder: int, words: list[int], heads: list[int], contents: list[int], windows: list[int], counts: list[int]) -> None:
            found, at = automaton.holders_of(words, window), 0
            for h, c, k, n in zip(heads, contents, windows, counts, strict=True):
                some = found[at : at + k]
                at += k
                if first != WHOLE or n > 1 or min(some) < holder:
                    out.append((h, c, n, first, some if first != WHOLE or min(some) != max(some) else some[:1]))

        def found() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(_HELD), _HELD, strict=True)], schema=_HELD)
            out.clear()
            return batch

        def settle() -> None:
            """All references are there; whole segments, asked about themselves, have waited (a few times SHARD_WORDS at most)."""
            automaton.finish()
            for w in waiting:
                answer(*w)
            waiting.clear()

        names, lists = ("shard", "sub", "refers", "asks", "first", "holder"), ("heads", "contents", "windows", "counts")
        open_ = False
        for batch in batches:
            for shard, sub, refers, asks, first, holder, raw, *segs in zip(*(_flat(batch.column(c)) for c in names), batch.column("words").to_pylist(), *(_lists(batch.column(c)) for c in lists), strict=True):
                if (shard, sub) != key:
                    if open_:
                        settle()
                    key, automaton, open_ = (shard, sub), SuffixAutomaton(), True
                words = np.frombuffer(raw, np.uint64).tolist()
                if refers:
                    automaton.add(words, holder)
                    if asks:
                        waiting.append((first, holder, words, *segs))
                else:
                    if open_:
                        settle()
                        open_ = False
                    answer(first, holder, words, *segs)
                if len(out) >= 4096:
                    yield found()
        if open_:
            settle()
        yield found()

    return run


def _dealt(distinct: DataFrame, window: int) -> DataFrame:
    """Distinct segments by their holder, with shard and number of its automata: doc_id and todo."""
    words = F.col("windows") + window - 1
    apart = F.when(F.col("hot"), F.col("windows") * window).otherwise(words)
    total = distinct.agg(F.sum(words)).first()[0] or 0  # overlaps count, so shards are less full than that
    shards = max(1, -(-int(total) // SHARD_WORDS))
    rows = distinct.withColumn("shard", F.pmod(F.xxhash64("head"), F.lit(shards)))
    over = rows.groupBy("shard").agg(F.sum(words).alias("_w"), F.sum(apart).alias("_a")).where(F.col("_w") > 2 * SHARD_WORDS)
    over = materialize(over.select("shard", F.ceil(F.col("_a") / SHARD_WORDS).cast("int").alias("subs")), "over")
    rows = rows.join(F.broadcast(over) if over.count() <= BROADCAST_ROWS else over, "shard", "left")
    todo = F.struct("head", "content", "shard", F.coalesce("subs", F.lit(1)).alias("subs"), "hot", "n")
    return rows.groupBy(F.col("holder").alias("doc_id")).agg(F.collect_list(todo).alias("todo"))


_RESULT = "n_words long, n_removed long, kept_sha256 string"


def _removed_words(begins, seg, rows, found, window) -> list[np.ndarray | None]:
    """For each text a mask of the words to remove; None: none."""
    start, n, _, content, text = seg
    cut = np.searchsorted(text, np.arange(rows + 1))
    out: list[np.ndarray | None] = []
    for i in range(rows):
        if not found[i]:
            out.append(None)
            continue
        a, b = int(cut[i]), int(cut[i + 1])
        base = int(begins[i])
        cover = np.zeros(int(begins[i + 1]) - base + 1, np.int32)
        gone = {f["content"]: f["gone"] for f in found[i]}
        for s, k, c in zip(start[a:b].tolist(), n[a:b].tolist(), content[a:b].view(np.int64).tolist(), strict=True):
            at = gone.get(c, ())
            for x, y in [(0, k + window - 1)] if at == ALL else spans_of(at, window):
                cover[s - base + x] += 1
                cover[s - base + y] -= 1
        out.append(np.cumsum(cover[:-1]) > 0)
    return out


def _masks(batch: pa.RecordBatch, found: list, window: int) -> list[np.ndarray | None]:
    """For each row a mask of the words to remove; None: none. Only texts of which something was found are cut into segments again."""
    out: list[np.ndarray | None] = [None] * len(batch)
    some = [i for i, f in enumerate(found) if f]
    if some:
        for row, to, _, begins, seg in _each(batch.select(["text"]).take(pa.array(some)), window):
            masks = _removed_words(begins, seg, to - row, [found[i] for i in some[row:to]], window)
            for i, mask in zip(some[row:to], masks, strict=True):
                out[i] = mask
    return out


def spans_of(places: list[int], window: int) -> Iterator[tuple[int, int]]:
    """First and last word (exclusive) of maximal runs of consecutive windows."""
    first = None
    for i, p in enumerate(places):
        if first is None:
            first = p
        if i + 1 == len(places) or places[i + 1] != p + 1:
            yield first, p + window
            first = None


def _cut(window: int, texts: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in _small(batches):
            found = batch.column(name).to_pylist()
            n_words, n_removed, shas, kept_texts = [], [], [], []
            column = batch.column("text").to_pylist()
            for text, mask in zip(column, _masks(batch, found, window), strict=True):
                raw = (text or "").encode()
                w = raw.split()
                kept = w if mask is None else list(compress(w, (~mask).tolist()))
                n_words.append(len(w))
                n_removed.append(len(w) - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if texts:
                    kept_texts.append(text if len(kept) == len(w) else _spliced(raw, mask))
            rest = [n for n in batch.schema.names if n != name and (not texts or n != "text")]
            if not texts:
                rest.remove("text")
            more = {"text": pa.array(kept_texts, pa.string())} if texts else {}
            cols = {n: batch.column(n) for n in rest} | more
            cols |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _spliced(text: bytes, mask: np.ndarray) -> str:
    """The text without the masked words; white space before a kept word stays."""
    buf = np.frombuffer(text, np.uint8)
    _, _, starts, ends = words_of(buf, np.array([0, len(buf)]), spans=True)
    keep, pos, out = ~mask, 0, []
    for s, e, k in zip(starts.tolist(), ends.tolist(), keep.tolist(), strict=True):
        if k:
            out.append(text[pos:e])
        pos = e
    return b"".join([*out, text[pos:]]).decode().strip()


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 (of the kept words, joined by spaces); with ``texts``, text is what is kept.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are judged on
    the input. Null and empty texts have no words, and nothing to remove. Rows with a null doc_id are neither cut nor
    references; rows that repeat an id don't count as smaller than each other. Columns named like the three new ones are replaced, all
    others stay as they are.
    """
    own = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = own.mapInArrow(_anchors(window), "anchor long, doc_id long")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("head < _hi")
    # a hot anchor may fill an automaton alone
    shared = materialize(shared.select("anchor", "head", "_n", (F.col("_n") * window > SHARD_WORDS).alias("hot")), "shared")
    marks = join_skewed(rows, shared, ["anchor"], "_n").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "head", "hot")).alias("_s"))
    marks = materialize(marks.select("doc_id", F.col("_s.anchor").alias("anchors"), F.col("_s.head").alias("heads"), F.col("_s.hot").alias("hots")), "marks")

    pieces = materialize(own.join(marks, "doc_id").mapInArrow(_pieces(window), _PIECE), "pieces")
    distinct = pieces.groupBy("head", "content").agg(
        F.min("doc_id").alias("holder"), F.max("windows").alias("windows"), F.max("hot").alias("hot"), F.count(F.lit(1)).alias("n")
    )
    todo = _dealt(materialize(distinct, "distinct"), window)
    spans = own.join(materialize(todo, "todo"), "doc_id").mapInArrow(_spans(window), SPAN)
    spans = spans.repartition("shard", "sub").sortWithinPartitions("shard", "sub", F.col("refers").desc())
    held = spans.mapInArrow(_streamed(window), HELD)
    # parts of a segment in their order; rows that repeat an id say the same again
    held = held.groupBy("head", "content").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("first", "holders"))).alias("_h"))
    held = materialize(held.select("head", "content", "n", F.flatten("_h.holders").alias("holders")), "held")

    by = join_skewed(pieces.select("head", "content", "doc_id"), held, ["head", "content"], "n")
    some = F.filter(F.sequence(F.lit(0), F.size("holders") - 1), lambda i: F.get("holders", i) < F.col("doc_id"))
    whole = F.when(F.col("holders")[0] < F.col("doc_id"), F.array(F.lit(ALL[0])))
    by = by.withColumn("gone", F.when(F.size("holders") == 1, whole).otherwise(some)).where(F.size("gone") > 0)
    name = next(n for n in (f"_found{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    by = materialize(by.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("content", "gone")).alias(name)), "verdict")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    # null ids don't meet in one task
    key = F.coalesce("doc_id", F.xxhash64("text"))
    joined = docs.select(*names).join(by, (key == F.col("_id")) & F.col("doc_id").isNotNull(), "left").select(*names, name)
    kept = [c for c in names if c != "text"] + (["text"] if texts else [])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", " + _RESULT
    return joined.mapInArrow(_cut(window, texts, name), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []::VARCHAR[]) w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') s FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) i FROM d WHERE len(w) >= 13)),
own AS (SELECT s, min(doc_id) lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) k FROM win JOIN own USING (s) WHERE doc_id > lo),
g AS (SELECT r, list(k) a FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(len(a), 0)::BIGINT n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: a IS NULL OR NOT list_contains(a, i)), ' '), '')) kept_sha256
FROM d LEFT JOIN g USING (r)
"""
