"""Project memories: one text file for each project, with a manifest of its files and their contents in fences; written, checked, read again.

Lines are rows (project, line_no, value). A reader must pass over fenced parts, as contents may hold the very marks that it looks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrublake.functions.tables import shared_path
from scrublake.functions.text import trim
from scrublake.sources.inventory import INLINE_BYTES, fence_length, human_size, in_locale_order

# Marks around the parts of a memory, and names of languages in fences.
MANIFEST = ("<!-- MANIFEST:BEGIN -->", "<!-- MANIFEST:END -->")
CONTENT = ("<!-- CONTENT:BEGIN -->", "<!-- CONTENT:END -->")
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "js", "mjs": "js", "json": "json", "css": "css", "html": "html"}
#: A fence: up to three spaces and at least three backticks.
FENCE = r"^ {0,3}(`{3,})"
ENTRY = r"^([0-9a-f]{64})\s{2,}(\S.*)$"


def memory_lines(files: DataFrame) -> DataFrame:
    """project, line_no (from 0), value: a manifest, then the contents of files (project, rel, size, sha256, binary, content) that are neither
    binary nor too large, each in a fence longer than any in it. Files are in the order of a locale. Null contents are empty."""
    text = F.coalesce("content", F.lit(""))
    suffix = F.regexp_extract("rel", r"\.([^./]*)$", 1)
    language = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix), F.lit(""))
    fence = F.repeat(F.lit("`"), fence_length(text))
    said = F.concat(human_size(F.col("size")), F.lit(" · sha256 `"), F.substring("sha256", 1, 16), F.lit("` · "), (F.size(F.split("rel", "/")) - 1).cast("string"), F.lit(" level(s) deep"))
    block = F.concat(
        F.array(F.concat(F.lit("### `"), "rel", F.lit("`")), F.lit(""), said, F.lit(""), F.concat(fence, language)), F.split(text, "\n", -1), F.array(fence, F.lit(""))
    )
    embedded = ~F.col("binary") & (F.col("size") < INLINE_BYTES)
    projects = files.select("project").distinct()
    mark = lambda at, line: projects.select("project", F.lit(at).alias("part"), F.lit("").alias("rel"), F.lit(0).alias("sub"), F.lit(line).alias("value"))
    rows = mark(0, MANIFEST[0]).union(files.select("project", F.lit(1), "rel", F.lit(0), F.concat("sha256", F.lit("  "), "rel"))).union(mark(2, MANIFEST[1])).union(mark(3, CONTENT[0]))
    rows = rows.union(files.where(embedded).select("project", F.lit(4), "rel", F.posexplode(block))).union(mark(5, CONTENT[1]))
    number = F.row_number().over(Window.partitionBy("project").orderBy("part", *in_locale_order("rel"), "sub")) - 1
    return rows.select("project", number.alias("line_no"), "value")


def write_memories(lines: DataFrame, path: str | None = None) -> DataFrame:
    """Write a text file for each project, read it again and compare: project, n_lines, sha256 of the text that was meant, verbatim, text as read.

    A project's lines go through one task, in order, as they make one file.
    """
    spark = lines.sparkSession
    path = path or shared_path(spark, "memories")
    lines.repartition("project").sortWithinPartitions("project", "line_no").select("project", "value").write.partitionBy("project").text(path)
    kind = lines.schema["project"].dataType.simpleString()
    read = spark.read.schema(f"value string, project {kind}").text(path, wholetext=True)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"])
    meant = lines.groupBy("project").agg(F.count(F.lit(1)).alias("n_lines"), F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("sha256"))
    same = F.coalesce(F.sha2("value", 256) == F.col("sha256"), F.lit(False))
    return meant.join(read, "project", "left").select("project", "n_lines", "sha256", same.alias("verbatim"), F.col("value").alias("text"))


def text_lines(memories: DataFrame) -> DataFrame:
    """project, line_no, value of whole texts (project, text); a break is a newline, perhaps with a carriage return before."""
    return memories.select("project", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "value"))


def _fenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where fences open and close, of fence lines sorted by project and line: an open one is closed by the next bare one that is no shorter."""
    project, fence = None, 0
    for batch in batches:
        at, steps = [], []
        for i, (p, ticks, bare) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("project", "ticks", "bare")), strict=True)):
            if p != project:
                project, fence = p, 0
            if not fence or (ticks >= fence and bare):
                steps.append(-1 if fence else 1)
                at.append(i)
                fence = 0 if fence else ticks
        taken = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("project").take(taken), batch.column("line_no").take(taken), pa.array(steps, pa.int32())], ["project", "line_no", "step"])


def outside_fences(lines: DataFrame) -> DataFrame:
    """The lines that stand in no fence, fence lines left out.

    Only fence lines pass through Python, where the length of the open fence is remembered; the others learn from a running sum of openings and
    closings. A fence that isn't closed holds all that follows.
    """
    ticks = F.length(F.regexp_extract("value", FENCE, 1))
    kind = lines.schema["project"].dataType.simpleString()
    fences = lines.where(F.col("value").rlike(FENCE)).select("project", "line_no", ticks.alias("ticks"), (trim(F.expr("substring(value, length(regexp_extract(value, '" + FENCE + "', 1)) + 1)")) == "").alias("bare"))
    steps = fences.repartition("project").sortWithinPartitions("project", "line_no").mapInArrow(_fenced, f"project {kind}, line_no int, step int")
    known = lines.select("project", F.col("line_no").cast("int").alias("line_no"), "value").join(steps, ["project", "line_no"], "left")
    depth = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("project").orderBy("line_no"))
    return known.withColumn("_depth", depth).where((F.col("_depth") == 0) & ~F.col("value").rlike(FENCE)).select("project", "line_no", "value")


def block(lines: DataFrame, begin: str, end: str) -> DataFrame:
    """Lines between the first line that is ``begin`` and the next that is ``end`` (or the last), outside fences."""
    open_lines = outside_fences(lines)
    w = Window.partitionBy("project").orderBy("line_no")
    begun = F.min(F.when(trim(F.col("value")) == begin, F.col("line_no"))).over(w)
    marked = open_lines.withColumn("_begin", begun)
    ended = F.min(F.when((trim(F.col("value")) == end) & (F.col("line_no") > F.col("_begin")), F.col("line_no"))).over(w)
    return marked.withColumn("_end", ended).where((F.col("line_no") > F.col("_begin")) & F.col("_end").isNull()).select("project", "line_no", "value")


def previous_state(memories: DataFrame) -> DataFrame:
    """project, rel, sha256 as the manifests of whole texts (project, text) tell; of a path that is there twice, the last."""
    rows = block(text_lines(memories), *MANIFEST)
    found = trim(F.col("value"))
    entry = lambda i: F.regexp_extract(found, ENTRY, i)
    rows = rows.where(found.rlike(ENTRY)).select("project", trim(entry(2)).alias("rel"), "line_no", entry(1).alias("sha256"))
    return rows.groupBy("project", "rel").agg(F.max_by("sha256", "line_no").alias("sha256"))
