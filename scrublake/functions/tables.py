"""Tables written to the folder that all executors share, and row numbers in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. Where that is unset, a local session takes a temporary folder; a cluster has none that all can see."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.scrublake.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scrublake-")
        spark.conf.set("spark.scrublake.shared.dir", root)
    return f"{root.rstrip('/')}/scrublake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back; lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Rows with their number in a global order: dealt by range and sorted, so that a row for each partition is all that meets in one task."""
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each partition of the range exchange
    rows = placed.withColumn("_part", part).join(offsets, "_part")
    return rows.withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33) + start).drop("_at", "_part", "_before")
