"""Language ID: known words by per-language log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, load

#: The model is fitted on about so many labelled documents of each language, those of the smallest hashes of doc_id; a bound that
#: doesn't depend on the corpus. It keeps all their words and n-grams.
SAMPLE_DOCS = 400
LONGEST = 4
#: Bytes of memory for words whose scores a worker remembers, from task to task.
REMEMBERED = 48 << 20
#: Evidence in a document counts as that of so many words at most, so that the score stays short of certainty.
EVIDENCE = 12.0
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}[\p{L}\p{M}]*)*")


def words_in(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (length 0) and n-grams in the batches' texts, by language."""
    for batch in batches:
        counts: dict[tuple[str, int, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in words_in(text):
                counts[lang, 0, w] = counts.get((lang, 0, w), 0) + 1
        for (lang, _, w), c in list(counts.items()):
            for n in range(1, LONGEST + 1):
                for g in grams(w, n):
                    if g != " ":
                        counts[lang, n, g] = counts.get((lang, n, g), 0) + c
        rows = list(zip(*((*k, c) for k, c in counts.items()), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "gram", "count"])


class Model:
    """Log frequencies of words and n-grams, less their mean over languages: a row for each, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]) -> None:
        self.uid = uuid.uuid4().hex
        self.languages = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.languages)}
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, gram, _ in rows:
            self.tables[n].setdefault(gram, len(self.tables[n]))
        counts = [np.zeros((len(t), len(at))) for t in self.tables]
        for lang, n, gram, count in rows:
            counts[n][self.tables[n][gram], at[lang]] = count
        self.scores = []
        for c in counts:
            total = c.sum(axis=0)
            logs = np.log(np.maximum(c, 0.5)) - np.log(total + 1)
            self.scores.append(logs - logs.mean(axis=1, keepdims=True) if len(at) else logs)

    def word(self, w: str) -> np.ndarray:
        """Scores of a word: its own if known, else of its longest n-grams, and of shorter ones inside those that are unseen too."""
        known = self.tables[0].get(w)
        if known is not None:
            return self.scores[0][known]
        total, parts, tables = np.zeros(len(self.languages)), 0, self.tables
        todo = [(g, LONGEST) for g in grams(w, LONGEST)] or [(f" {w} ", len(w) + 2)]
        while todo:
            g, n = todo.pop()
            found = tables[n].get(g) if n <= LONGEST else None
            if found is not None:
                total += self.scores[n][found]
                parts += 1
            elif n > 1:
                todo += [(g[:-1], n - 1), (g[1:], n - 1)]
        return total / max(1, parts)


class Scorer:
    """Scores texts; remembers the scores of words."""

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.held = model, {}, 0
        self.table = np.zeros((1024, len(model.languages)))

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [words_in(t) for t in texts]
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        for w in set(chain.from_iterable(words)).difference(self.known):
            n = self.known[w] = len(self.known)
            self.held += 160 + 2 * len(w) + 8 * self.table.shape[1]
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n] = self.model.word(w)
        out = []
        for ws in words:
            if not ws or not self.model.languages:
                out.append(("und", 0.0))
                continue
            sums = self.table[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            sums *= min(len(ws), EVIDENCE) / len(ws)
            p = np.exp(sums - sums.max())
            best = int(np.argmax(p))
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def scorer(model: Model) -> Scorer:
    """One scorer for all tasks of a worker."""
    return kept_by_worker(("language", model.uid), lambda: Scorer(model))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning. A null doc_id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Fit on ``labelled`` (doc_id, text, lang); rows of a null text or lang are left out.

    Languages are counted first; then a threshold on the hash of doc_id takes about ``sample`` documents of each. An empty table gives
    a model that calls everything ``und``.
    """
    own = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    hashed = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)).cast("double")
    take = F.lit(False)
    for lang, n in sorted(sizes.items()):
        take = take | ((F.col("lang") == lang) & (hashed < (1 << 30) * min(1.0, sample / n)))
    counts = own.where(take).mapInArrow(_counted, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    # what about ``sample`` documents of each language hold
    return Model([(r["lang"], r["n"], r["gram"], r["count"]) for r in counts.orderBy("n", "gram", "lang").collect()])


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = scorer(model.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = words.score([t or "" for t in part.column("text").to_pylist()])
                rest = {c: part.column(c) for c in part.schema.names}
                yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred (a learned language; ``und`` without letters, with score 0) and score, from text alone.

    Null and empty texts are ``und``; whole texts are read; equal texts get equal answers. Ties go to the first language in
    order. Columns named lang_pred and score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of a bounded sample
    return docs.mapInArrow(_predicted(shared), f"{fields}, lang_pred string, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learns from those not held out."""
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
