"""First-wins deduplication across the batches of a stream.

One state entry per distinct text, keyed by its SHA-256: the first batch that
holds the text emits its row of smallest order, later ones emit nothing. The
state lives in the stream's checkpoint, so a restart goes on where it stopped
and repeats neither rows nor texts. With ``expiry`` an entry is dropped once the
event-time watermark has passed its row's time by that long: the state then
holds the texts of that period only, and a text that comes back after it counts
as new.

Rows travel as JSON, so that types survive the state operator's pandas frames
(nullable integers, dates). A group's rows are folded frame by frame, never
gathered: a text that makes up a third of a batch costs one task time, not memory.

Null texts are one text. Equal orders within a batch: the smaller JSON row wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from narrata.session import ship_package

_ROW = "_order long, _row string"


def dedup_stream(df: DataFrame, col: str = "narrative", order: str = "complaint_id",
                 event_time: str | None = None, expiry: str = "7 days") -> DataFrame:
    """First row per ``col`` of a stream (append mode). ``order``: a long column
    that ranks rows within a batch. ``event_time``: a timestamp column; texts are
    then forgotten ``expiry`` after it."""
    ship_package(df.sparkSession)
    key = F.coalesce(F.sha2(F.col(col).cast("binary"), 256), F.lit("null")).alias("_key")
    small = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    source = df.withWatermark(event_time, expiry) if event_time else df
    time = [F.col(event_time).alias("_time")] if event_time else []
    rows = source.select(key, F.col(order).cast("long").alias("_order"), small.alias("_row"), *time)
    keep_ms = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def first(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            return  # the frames of a known text are not read
        best, latest = None, 0
        for f in frames:
            mine = min(zip(f["_order"].tolist(), f["_row"].tolist(), strict=True),
                       key=lambda r: (r[0] is None or r[0] != r[0], r[0] if r[0] == r[0] and r[0] is not None else 0, r[1]))
            best = mine if best is None or mine < best else best
            if event_time:
                latest = max(latest, int(f["_time"].max().timestamp() * 1000) if f["_time"].notna().any() else 0)
        state.update((1,))
        if event_time:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({"_order": [best[0]], "_row": [best[1]]})

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    kept = rows.groupBy("_key").applyInPandasWithState(first, _ROW, "seen int", "append", timeout)
    return kept.select(F.from_json("_row", df.schema).alias("r")).select("r.*")


def run_dedup_stream(df: DataFrame, out_path: str, checkpoint: str, **options) -> None:
    """Process everything available now into Parquet, then stop."""
    q = (dedup_stream(df, **options).writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
