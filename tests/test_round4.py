"""Lines in Arrow batches, views from one pass, face suppression by frames, tab streams in arrivals, payloads with one parse."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrublake.operators import lines, merge


def test_lines_of_whole_batches(spark):
    """Frames that go on from batch to batch, words apart by less than a line's reach, whose medians move, and ids that are null."""
    import random

    r = random.Random(4)
    words = [(f if f else None, t, r.choice(["a", "bé", "🙂x", "word"]), float(r.randrange(300)), t * 1.5 if f % 2 else r.randrange(9) * 7.0, 30.0, float(r.choice([0, 8, 12])), float(t)) for f in range(6) for t in range(25)]
    kind = "frame_id long, token_no long, text string, left double, top double, width double, height double, confidence double"

    def plain(rows):
        median = lambda v: sorted(v)[len(v) // 2] if v else 0.0
        usual = median([w[6] for w in rows if w[6] > 0]) or 12.0
        out: list = []
        for w in sorted(rows, key=lambda w: w[4] + w[6] / 2):
            if out and w[4] + w[6] / 2 - median([x[4] + x[6] / 2 for x in out[-1]]) <= max(4.0, usual * 0.6):
                out[-1].append(w)
            else:
                out.append([w])
        return [[w[1] for w in sorted(line, key=lambda w: w[3])] for line in out]

    expected = {f: plain([w for w in words if w[0] == f]) for f in {w[0] for w in words}}
    d = spark.createDataFrame(words, kind).coalesce(1)
    size = lines._AT_ONCE
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for together in (False, True):
            got: dict = {}
            for x in lines.group_lines(d, together).collect():
                got.setdefault(x.frame_id, {})[x.line_no] = [s.token_no for s in x.spans]
                assert all(x.text[s.start : s.end] in ("a", "bé", "🙂x", "word") for s in x.spans)
            assert {f: [v[i] for i in range(len(v))] for f, v in got.items()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batches = [pa.RecordBatch.from_pylist([dict(zip(("frame_id", "token_no", "text", "left", "top", "width", "height", "confidence"), w, strict=True))]) for w in words[25:60]]
    lines._AT_ONCE = 1
    try:
        found = list(lines._grouped(iter(batches)))
    finally:
        lines._AT_ONCE = size
    assert sum(map(len, found)) == len(expected[1]) + len(plain(words[50:60])) and len(found) > 1


def test_words_are_not_shuffled_and_views_share_a_scan(spark):
    """Lines of texts come from a shuffle of texts; an inspector's views are counted in one pass."""
    import io
    from contextlib import redirect_stdout

    from scrublake import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    found = queries.inspector_views(spark, sf)
    out = io.StringIO()
    with redirect_stdout(out):
        found.explain()
    assert out.getvalue().count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in out.getvalue()
    one = queries.corroborated_scan(spark, sf).withColumn("sources", F.split("sources", ","))
    counted = {(v, x.type): x.n for v in merge.VIEWS for x in merge.view(one, v).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert {(x.view, x.type): x.n for x in found.collect()} == counted


def test_lenient_condition(spark):
    """Texts with a single detection each pass what is looked at before the rules, and words that look a little like digits don't."""
    from scrublake.operators import scan

    texts = ["212-555-1234", "(212) 555-1234", "(2l2)5551234 x", "SI2.3456", "12345 67890", "123-4567-8901", "O12-34-5678", "2345 6789 0I23", "4111-1111-1111-1111", "a@b.org", "Soll Bill IO l"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    every = {r.id for r in d.select("id", F.size(F.coalesce(scan.detections_in(F.col("text"), True), F.array())).alias("n")).where("n > 0").collect()}
    may = {r.id for r in d.where(scan.may_match(F.col("text"), True)).collect()}
    assert every <= may and 10 not in may and len(every) >= 7


def test_payloads_parse_once(spark):
    """What takes Python is read from written tables by the parts of a payload."""
    import io
    from contextlib import redirect_stdout

    from scrublake import queries_frames

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    out = io.StringIO()
    with redirect_stdout(out):
        queries_frames.payload_metas(spark, sf).explain()
    assert not any(x in out.getvalue() for x in ("InPandas", "InArrow", "PythonUDF"))


def test_arrivals_are_batches(spark):
    """Tab contexts come in as many batches as arrivals, however many files these have."""
    from scrublake import queries_frames

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    seen: list = []
    read, spark_table = queries_frames.tabs.last_contexts, queries_frames.table
    queries_frames.tabs.last_contexts = lambda w: (seen.append(w), read(w))[1]
    queries_frames.table = lambda *a: spark_table(*a).repartition(3)
    try:
        queries_frames.tab_contexts(spark, sf).collect()
    finally:
        queries_frames.tabs.last_contexts, queries_frames.table = read, spark_table
    batches = {x.batch for x in seen[0].select("batch").distinct().collect()}
    assert max(batches) == 7 and batches >= {0, 1, 3, 4, 5, 6, 7}  # the third arrival may be late throughout
