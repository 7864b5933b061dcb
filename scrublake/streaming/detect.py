"""The batch transformations over files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder, as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, each row once; with ``once``, stop when all that is there is done."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run(spark: SparkSession, source: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> DataFrame:
    """Apply a row-wise ``step`` (scan, sanitise, audit) to all files there, and read the result."""
    write(step(read(spark, source, schema)), sink, checkpoint).awaitTermination()
    return spark.read.parquet(sink)
