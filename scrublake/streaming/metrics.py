"""Numbers of a run, observed while it runs: no second pass over its rows."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def scan_metrics() -> list[Column]:
    """Of detections (source, sources, type, confidence): how many, by provenance, and the mean confidence."""
    s = F.coalesce("sources", F.array("source"))
    ocr, dom = F.array_contains(s, "OCR"), F.array_contains(s, "DOM")
    return [
        F.count(F.lit(1)).alias("flagged_count"), F.count_if(F.col("source") == "DOM").alias("dom_flagged_count"), F.count_if(F.col("source") != "DOM").alias("ocr_flagged_count"),
        F.count_if(ocr).alias("ocr_matched_count"), F.count_if(ocr & dom).alias("corroborated_count"), F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("mean_confidence"),
    ]


def word_metrics() -> list[Column]:
    """Of recognised words (text, confidence): how many, their characters, and the mean confidence."""
    return [F.count(F.lit(1)).alias("token_count"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.coalesce(F.round(F.avg("confidence")), F.lit(0.0)).alias("mean_confidence")]


def vision_metrics() -> list[Column]:
    """Of detections of models (label): faces and others."""
    return [F.count_if(F.col("label") == "face").alias("face_count"), F.count_if(F.col("label") != "face").alias("object_count")]


def metered(rows: DataFrame, metrics: list[Column], name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and what holds their numbers once they have been written or counted."""
    seen = Observation(name)
    return rows.observe(seen, *metrics), seen


def status(spark: SparkSession, stage: str, seen: Observation | None, error: str | None = None) -> DataFrame:
    """A row for a stage that ran or failed: stage, status (done or error), metrics as a map, error. Waits for the run of ``seen``."""
    found = {k: float(v) for k, v in seen.get.items()} if seen is not None and error is None else {}
    return spark.createDataFrame([(stage, "error" if error else "done", found, error)], "stage string, status string, metrics map<string,double>, error string")


class Meter(StreamingQueryListener):
    """Collects what streams observe: a row for each batch and observed name, and a row for a stream that ended with an error."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, str, dict]] = []
        self.errors: list[tuple[str, str]] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for name, row in (p.observedMetrics or {}).items():
            self.rows.append((str(p.id), p.batchId, name, row.asDict()))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.errors.append((str(event.id), event.exception))
        self.ended.set()
