"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir), with the columns of documents, and returns a DataFrame; all but the last return these columns.
Null texts go in the first stage. Rows that repeat a doc_id stay or go together. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrublake.llm import language_id, mixing, near_dedup, pieces, substring_dedup
from scrublake.llm.common import load, materialize, word_count

#: A document goes if its language is unknown or less certain than this.
LEAST_SCORE = 0.5
#: Passages of so many words that an earlier document has are cut out.
PASSAGE_WORDS = 50
#: Decisions on up to so many documents are joined by broadcast (some 50 bytes each), others by a shuffle.
BROADCAST_ROWS = 1 << 19
#: Words that the last stage remembers in a worker; fewer than by default, as the executors' heaps are full by then.
REMEMBERED = 120_000


def _beside(decisions: DataFrame) -> DataFrame:
    """Ready for a join: written, and broadcast if the rows are few."""
    decisions = materialize(decisions, "decisions")
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """Columns that a stage's own would replace get other names meanwhile."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in names})


def _restored(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"_own_{c}").alias(c) if f"_own_{c}" in docs.columns else F.col(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all documents with a language; those without letters, or too uncertain, go."""
    told = language_id.identify(_aside(docs, "lang_pred", "score"), language_id.train(docs))
    return _restored(told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8 or more; the smallest doc_id of each component stays."""
    gone = near_dedup.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(_beside(gone), "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that an earlier document has; documents with nothing left go."""
    cut = substring_dedup.remove_repeats(_aside(docs, "owned", "found", "n_words", "n_removed", "kept_sha256"), window=PASSAGE_WORDS)
    cut = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", chars)
    return _restored(cut, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of sources begins it: not at all up to three times."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mix = mixing.mixed_sources(sizes, seed=5).groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    mix = _beside(mix.withColumnRenamed("doc_id", "_id"))
    taken = docs.join(mix, docs.doc_id.eqNullSafe(F.col("_id")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces, and whether decoding gives the text again."""
    out = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), remembered=REMEMBERED)
    return out.select("doc_id", "lang", "source", "ids", "n_pieces", "same")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_texts),
]

#: Language scores and piece ids are not for SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
