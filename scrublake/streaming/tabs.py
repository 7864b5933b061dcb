"""Tab events as a stream: what each tab shows last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTEXT = "tab_id long, event_id long, at timestamp, event string, n_read long, n_dropped long"
_STATE = "micros long, event_id long, event string, n_read long, n_dropped long"


def _latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An event is read if it is later than the tab's last (of one time, the greater id); late and repeated ones are counted and dropped."""
    micros, event_id, event, n_read, n_dropped = state.get if state.exists else (None, None, None, 0, 0)
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    m, i = rows["micros"].to_numpy(), rows["event_id"].to_numpy()
    later = np.arange(len(m)) if micros is None else np.flatnonzero((m > micros) | (m == micros) & (i > event_id))
    n_new = 0
    if len(later):
        order = later[np.lexsort((i[later], m[later]))]
        m, i = m[order], i[order]
        micros, event_id = int(m[-1]), int(i[-1])
        event = min(rows["event"].to_numpy()[order[(m == micros) & (i == event_id)]])
        n_new = 1 + int(np.count_nonzero((m[1:] != m[:-1]) | (i[1:] != i[:-1])))
    n_read, n_dropped = n_read + n_new, n_dropped + len(rows) - n_new
    state.update((micros, event_id, event, n_read, n_dropped))
    if n_new:
        yield pd.DataFrame({"tab_id": [key[0]], "event_id": [event_id], "at": np.array([micros], "datetime64[us]"), "event": np.array([event], object), "n_read": [n_read], "n_dropped": [n_dropped]})


def contexts(events: DataFrame) -> DataFrame:
    """A row for each tab and batch in which something newer came: tab_id, event_id, at, event, and how many events were read and dropped so far.

    ``events``: tab_id, event_id, ts, event. State is one small row a tab. Rows without a tab, id or time are left out.
    """
    known = events.where("tab_id is not null and event_id is not null and ts is not null")
    rows = known.select("tab_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.coalesce("event", F.lit("")).alias("event"))
    return rows.groupBy("tab_id").applyInPandasWithState(_latest, CONTEXT, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_contexts(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Contexts of a stream, appended to Parquet with the number of their batch; a batch that is done again is written over."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = contexts(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_contexts(written: DataFrame) -> DataFrame:
    """What each tab shows after the last batch."""
    last = F.max_by(F.struct(*(c for c in written.columns if c not in ("tab_id", "batch"))), "batch").alias("_c")
    return written.groupBy("tab_id").agg(last).select("tab_id", "_c.*")
