"""Rolling demand (W1-W3) on a stream: exact per trip, with a watermark.

Trips are keyed by (location, time chunk); a trip of a chunk's last hour is also
context of the next chunk, as in ``operators.demand``, so a hot location is many
keys in a backfill and its state ends with each chunk. A key keeps the trips per
second of the last window and the trips that wait. A second is closed once the
watermark has passed it: no trip of it can come any more. Its trips are then
emitted, with counts that no later trip changes; a timer closes the last seconds
of a key without new trips, and drops keys whose windows have run out.

Late trips, those not after the watermark when they arrive, are dropped by Spark
and count nowhere. Rows of a heartbeat stream (``heartbeats``: only a time) move
the watermark where trips are missing, and close the end of a backfill.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from surgelane.config import FEATURES, PICKUP_TS, PU_LOC, FeatureRules
from surgelane.operators.demand import UNIX_TS, demand_col

_TIME, _CHUNK, _CONTEXT = "_event_time", "_chunk", "_context"


def count_windows(seconds: np.ndarray, at: np.ndarray, minutes: Sequence[int]) -> list[np.ndarray]:
    """Numbers of (sorted) ``seconds`` in [s - 60 m, s] for each s of ``at``."""
    upto = np.searchsorted(seconds, at, side="right")
    return [upto - np.searchsorted(seconds, at - 60 * m, side="left") for m in minutes]


def stream_rolling_demand(
    trips: DataFrame,
    keep: Sequence[str],
    delay: str = "10 minutes",
    rules: FeatureRules = FEATURES,
    heartbeats: DataFrame | None = None,
) -> DataFrame:
    """Streaming (location, pickup_unix_ts, *keep, demand_15/30/60min) of each trip, in append mode.

    ``keep`` are columns of simple types. ``heartbeats`` has one column, a timestamp.
    Trips without a pickup time are left out; those without a location are a key of their own.
    """
    chunk, longest = rules.demand_chunk_seconds, 60 * max(rules.rolling_minutes)
    kept = [trips.schema[c] for c in keep]
    rows = trips.where(F.col(PICKUP_TS).isNotNull()).select(
        F.col(PICKUP_TS).cast("timestamp").alias(_TIME), F.col(PU_LOC), *keep, F.lit(False).alias("_beat")
    )
    if heartbeats is not None:
        beat = F.col(heartbeats.columns[0]).cast("timestamp").alias(_TIME)
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in (trips.schema[PU_LOC], *kept)]
        rows = rows.unionByName(heartbeats.select(beat, *nothing, F.lit(True).alias("_beat")))
    second = F.unix_seconds(_TIME)
    home = F.floor(second / chunk)
    spill = ~F.col("_beat") & (second - home * chunk >= chunk - longest)
    copies = F.array_compact(F.array(
        F.struct(home.alias(_CHUNK), F.lit(False).alias(_CONTEXT)), F.when(spill, F.struct((home + 1).alias(_CHUNK), F.lit(True).alias(_CONTEXT)))
    ))
    rows = rows.withWatermark(_TIME, delay).withColumn(UNIX_TS, second).select("*", F.inline(copies))

    out = T.StructType([trips.schema[PU_LOC], T.StructField(UNIX_TS, T.LongType()), *kept, *(T.StructField(demand_col(m), T.LongType()) for m in rules.rolling_minutes)])
    waiting = [T.StructField(f"w_{f.name}", T.ArrayType(f.dataType)) for f in kept]
    state_type = T.StructType([T.StructField("seconds", T.ArrayType(T.LongType())), T.StructField("w_second", T.ArrayType(T.LongType())), *waiting])
    names, minutes = list(keep), list(rules.rolling_minutes)
    # pandas holds whole numbers with gaps as fractions.
    integral = [isinstance(f.dataType, T.IntegralType) for f in kept]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, *columns = state.get if state.exists else ([], [], *([] for _ in names))
        seconds = list(seconds)
        w_second, *w_kept = (list(c) for c in columns)
        for part in parts:
            if part.empty:  # a timer has no rows
                continue
            part = part[~part["_beat"]]
            seconds += part[UNIX_TS].tolist()
            own = part[~part[_CONTEXT]]
            w_second += own[UNIX_TS].tolist()
            for held, c, whole in zip(w_kept, names, integral):
                held += [None if pd.isna(v) else int(v) if whole else v for v in own[c].tolist()]
        mark = state.getCurrentWatermarkMs()
        seconds.sort()
        known, wait = np.array(seconds, np.int64), np.array(w_second, np.int64)
        closed = (wait + 1) * 1000 <= mark
        if closed.any():
            at = np.flatnonzero(closed)
            found = {PU_LOC: [key[0]] * len(at), UNIX_TS: wait[at]}
            found |= {c: [held[i] for i in at] for held, c in zip(w_kept, names)}
            found |= {demand_col(m): n for m, n in zip(minutes, count_windows(known, wait[at], minutes))}
            yield pd.DataFrame(found)
        left = np.flatnonzero(~closed)
        # Trips that a window of an open second of this chunk can reach.
        end = (int(key[1]) + 1) * chunk
        reach = min(mark // 1000, end) - longest
        known = known[known >= reach]
        if not len(known) or (not len(left) and mark >= end * 1000):
            state.remove()
            return
        state.update((known.tolist(), wait[left].tolist(), *([held[i] for i in left] for held in w_kept)))
        soonest = int(wait[left].min()) + 1 if len(left) else end
        state.setTimeoutTimestamp(max(soonest * 1000, mark + 1))

    return rows.groupBy(PU_LOC, _CHUNK).applyInPandasWithState(update, out, state_type, "append", GroupStateTimeout.EventTimeTimeout)


def start_demand_stream(demand: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream of ``stream_rolling_demand`` to a Parquet table; ``checkpoint`` is this stream's own."""
    writer = demand.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
