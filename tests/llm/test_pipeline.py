"""The pipeline against a version by hand, stage by stage."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import brute_components, brute_removed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "source_mix", "sentencepiece"]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in now.collect()]
        stage(spark, now, "").write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in out.collect()]
        if name != "sentencepiece":
            assert out.columns == docs.columns
        ids = lambda x: sorted(str(r["doc_id"]) for r in x)
        pairs = [(r["doc_id"], r["text"]) for r in before]
        if name == "language_id":
            assert ids(after) == ids([r for r in before if re.search(r"[^\W\d_]", r["text"] or "")])
            assert {r["score"] for r in after} <= {"own", None}
        elif name == "near_dedup":
            keep = brute_components(pairs, 5)
            assert ids(after) == ids([r for r in before if r["doc_id"] is None or keep[r["doc_id"]] == r["doc_id"]])
        elif name == "substring_dedup":
            expected = {(str(i), n - g) for i, n, g, _ in brute_removed(pairs, corpus_pipeline.PASSAGE_WORDS) if n > g}
            assert {(str(r["doc_id"]), len(WORD.findall(r["text"]))) for r in after} == expected
        elif name == "source_mix":
            assert set(ids(after)) <= set(ids(before)) and after
            assert all(sum(1 for r in after if r["doc_id"] == i) <= 3 * sum(1 for r in before if r["doc_id"] == i) for i in {r["doc_id"] for r in before})
        else:
            assert ids(after) == ids(before) and all(r["n_pieces"] == len(r["ids"]) > 0 for r in after)
            assert all(r["same"] for r in after if r["doc_id"] != 42)
        now = out


def test_run_and_empty(spark, sf, empty):
    assert set(corpus_pipeline.run(spark, sf).columns) == {"doc_id", "lang", "source", "ids", "n_pieces", "same"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_registered():
    import __spark_entry__ as e

    names = {k.split("_")[0] for k in e.queries() if re.match(r"op\d+_", k)}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
