"""File inventories: scan, purpose, snapshot diff, changelog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrublake.functions.tables import numbered

# Extensions that are never embedded, and the size from which files aren't.
BINARY = (".onnx", ".wasm", ".traineddata", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".zip", ".gz", ".br", ".pdf", ".woff", ".woff2", ".ttf", ".eot")
INLINE_BYTES = 120 * 1024
ENTRIES = 60


def is_binary(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"(\.[^./]*)$", 1)).isin(*BINARY)


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """rel, size, sha256, binary of every file below ``root``, but for .git and node_modules."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = f"{re.sub('^[a-z]+:/+', '/', root).rstrip('/')}/"
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    rel = F.when(F.startswith(path, F.lit(inside)), F.substring(path, len(inside) + 1, 1 << 30)).otherwise(path)
    rows = files.select(rel.alias("rel"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("rel").rlike(r"(^|/)(\.git|node_modules)/")).withColumn("binary", is_binary(F.col("rel")))


def in_locale_order(path: str) -> list[Column]:
    """Sort keys of paths as people sort them: by the root collation, equal ones by their characters."""
    return [F.collate(F.col(path), "UNICODE"), F.col(path)]


def ranked(files: DataFrame, path: str = "rel") -> DataFrame:
    """Files with their rank (from 1) in the order of a locale."""
    return numbered(files, in_locale_order(path), "rank", start=1)


def diff(before: DataFrame, after: DataFrame, key: str = "rel", digest: str = "sha256") -> DataFrame:
    """key and change: added, removed or modified."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def changelog(entries: DataFrame, new: DataFrame, at: Column, most: int = ENTRIES) -> DataFrame:
    """Entries (at, n_added, n_modified, n_removed), the newest first, with the diff ``new`` as one of them; ``most`` stay."""
    n = lambda k: F.count_if(F.col("change") == k).alias(f"n_{k}")
    row = new.agg(n("added"), n("modified"), n("removed")).select(at.alias("at"), "*")
    return entries.unionByName(row).orderBy(F.col("at").desc()).limit(most)


def purposes(files: DataFrame, exact: DataFrame, prefixes: DataFrame, folders: DataFrame) -> DataFrame:
    """``files`` (rel, binary) with purpose: of the exact path, of the first fitting prefix (by no), binary, or of the nearest folder above.

    ``exact`` and ``folders`` have path and purpose; ``prefixes`` has no, prefix, purpose; all three are small lookups by nature.
    """
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("rel", "/"))), lambda i: F.array_join(F.slice(F.split("rel", "/"), F.lit(1), i), "/"))
    f = files.join(exact.select(F.col("path").alias("rel"), F.col("purpose").alias("_exact")), "rel", "left")
    hits = files.join(F.broadcast(prefixes), F.startswith(F.col("rel"), F.col("prefix"))).groupBy("rel").agg(F.min_by("purpose", "no").alias("_prefix"))
    above = files.select("rel", F.posexplode(up).alias("_n", "path")).join(folders, "path").where(F.col("path") != F.col("rel"))
    above = above.groupBy("rel").agg(F.max_by("purpose", "_n").alias("_folder"))
    f = f.join(hits, "rel", "left").join(above, "rel", "left")
    return f.select(*files.columns, F.coalesce("_exact", "_prefix", F.when(F.col("binary"), F.lit("Binary asset.")), "_folder", F.lit("Project file.")).alias("purpose"))


def fence_length(content: Column) -> Column:
    """One more than the longest run of backticks, three at least."""
    runs = F.transform(F.regexp_extract_all(content, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def human_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.2f", n / 1048576.0), F.lit(" MB")))
    )


def inventory(files: DataFrame) -> DataFrame:
    """rel, size as text, the digest's first 16 characters, kind; sorted by path."""
    kind = F.when(F.col("binary"), "binary").when(F.col("size") < INLINE_BYTES, "embedded").otherwise("generated")
    return files.select("rel", human_size(F.col("size")).alias("size_text"), F.substring("sha256", 1, 16).alias("digest"), kind.alias("kind")).orderBy(*in_locale_order("rel"))


def capped(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def markdown(rows: DataFrame) -> DataFrame:
    """A line of text for each inventory row, in the order of paths, as one column that ``write.text`` takes."""
    cells = F.concat_ws(" | ", F.concat(F.lit("`"), "rel", F.lit("`")), "size_text", "digest", "kind")
    return rows.orderBy(*in_locale_order("rel")).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))
