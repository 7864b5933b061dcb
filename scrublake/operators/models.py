"""A host for models: each worker loads a model once, when first asked, with providers tried in order; failures become status rows.

A loader takes a provider and gives a function from a batch of frames to a DataFrame of rows with frame_id. Models fail one by one: one that
can't be loaded, or that raises for a frame, leaves the others' rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Loader = Callable[[str], Callable[[pd.DataFrame], pd.DataFrame]]
STATUS = "model string, status string, provider string, error string"
NOT_LOADED = "Model not loaded"
_SESSIONS: dict[tuple, tuple] = {}


@dataclass(frozen=True)
class Model:
    """``key`` tells sessions apart in a worker; a new one loads anew."""

    name: str
    load: Loader
    providers: tuple[str, ...] = ("gpu", "cpu")
    key: str = field(default="")


def session(model: Model) -> tuple[Callable | None, str | None, str | None]:
    """The model's function, the provider that it runs on, and the last error in loading; made once in a worker, failures too."""
    at = (model.name, model.key, model.providers)
    if at not in _SESSIONS:
        found: tuple = (None, None, None)
        for provider in model.providers:
            try:
                found = (model.load(provider), provider, None)
                break
            except Exception as e:  # a provider that isn't there is no failure of the frame
                found = (None, None, f"{provider}: {e}")
        _SESSIONS[at] = found
    return _SESSIONS[at]


def _told(frames: pd.DataFrame, model: Model, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a model for a batch: by frame only where the batch as a whole fails, so that one frame's failure is its own."""
    run, provider, broken = session(model)

    def row(ids: pd.Series, status: str, error: str | None) -> pd.DataFrame:
        return pd.DataFrame({"frame_id": ids, "kind": "status", "model": model.name, "status": status, "provider": provider, "error": error}).reindex(columns=columns)

    if run is None:
        yield row(frames["frame_id"], "missing", broken or NOT_LOADED)
        return
    try:
        parts = [(frames, run(frames), None)]
    except Exception:
        parts = []
        for i in range(len(frames)):
            one = frames.iloc[i : i + 1]
            try:
                parts.append((one, run(one), None))
            except Exception as e:
                parts.append((one, None, str(e)))
    for asked, made, error in parts:
        if made is not None and len(made):
            yield made.assign(kind="row", model=model.name, provider=provider).reindex(columns=columns)
        yield row(asked["frame_id"], "failed" if error else "done", error)


def host(frames: DataFrame, models: list[Model], schema: str) -> DataFrame:
    """Rows of all models (kind row, with the columns of ``schema``) and a status row (kind status) for each frame and model: done, failed (with
    the error) or missing (it couldn't be loaded). frame_id, kind, model, status, provider, error, then ``schema``.

    Each worker keeps its sessions from batch to batch. Frames are partitioned as they come; nothing is gathered.
    """
    whole = f"frame_id long, kind string, {STATUS}, {schema}"
    kinds = dict(frames.sparkSession.createDataFrame([], whole).dtypes)
    columns, texts = list(kinds), {c: object for c, kind in kinds.items() if kind == "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model in models:
                for part in _told(batch, model, columns):
                    yield part.astype(texts)

    return frames.mapInPandas(run, whole)


def runs(hosted: DataFrame) -> DataFrame:
    """A row for each frame: models_used, failed models, statuses (model, loaded, provider, error) by model, n_rows, and error if no model could
    be loaded."""
    status = F.struct("model", (F.col("status") != "missing").alias("loaded"), "provider", "error")
    of = hosted.groupBy("frame_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "status", status))).alias("statuses"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "status") & (F.col("status") != "missing"), F.col("model")))).alias("models_used"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("model")))).alias("models_failed"), F.count_if(F.col("kind") == "row").alias("n_rows"),
    )
    return of.withColumn("error", F.when(F.size("models_used") == 0, F.lit("No model could be loaded.")))
