"""Admission control and job expiry over keyed state."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, WINDOW = 10, 3600.0
TTL = 3600.0


class Gate:
    """The times of the last `limit` accepted hits of a key, in a ring.

    A hit is accepted if fewer have been, or if the oldest of the ring lies more than `window` before it; refused hits
    leave no trace.
    """

    def __init__(self, limit: int, window: float, times=()):
        self.limit, self.window = limit, window
        self.ring = deque(times, maxlen=max(limit, 1))

    def accepts(self, now: float) -> bool:
        ok = self.limit > 0 and (len(self.ring) < self.limit or now - self.ring[0] > self.window)
        if ok:
            self.ring.append(now)
        return ok


def rate_limit(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW, key: str = "key") -> DataFrame:
    """hits (key, ts) with `allowed`.  A key's hits are streamed in order of time; only its window is held."""
    schema = f"{key} {dict(hits.dtypes)[key]}, ts double, allowed boolean"
    rows = hits.select(key, "ts").repartition(key).sortWithinPartitions(key, "ts")

    def run(batches):
        last, gate = None, Gate(limit, window)
        for pdf in batches:
            out = []
            for k, ts in zip(pdf[key], pdf["ts"], strict=True):
                if k != last:
                    last, gate = k, Gate(limit, window)
                out.append(gate.accepts(ts))
            yield pdf.assign(allowed=out)

    return rows.mapInPandas(run, schema)


def rate_limit_stream(hits: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """The like over a stream of (key string, ts double), in order of arrival; idle keys are forgotten after the window."""

    def update(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        gate = Gate(limit, window, state.get[0] if state.exists else ())
        for pdf in pdfs:
            pdf = pdf.sort_values("ts")
            yield pd.DataFrame({"key": key[0], "ts": pdf["ts"], "allowed": [gate.accepts(t) for t in pdf["ts"]]})
        state.update((list(gate.ring),))
        state.setTimeoutDuration(int(window * 1000))

    return hits.groupBy("key").applyInPandasWithState(
        update, "key string, ts double, allowed boolean", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def expired(status: Column, created_at: Column, now: Column, ttl: float = TTL) -> Column:
    """Finished jobs after ttl seconds, any job after twice that."""
    age = now - created_at
    return (status.isin("done", "failed") & (age > ttl)) | (age > 2 * ttl)


def latest_status(events: DataFrame, order: str = "ts") -> DataFrame:
    """(id, status, updated) from a log of (id, status, ts).  Of equal times the greatest `order` is the latest."""
    return events.groupBy("id").agg(F.max_by("status", F.struct("ts", order)).alias("status"), F.max("ts").alias("updated"))


def live_keys(admitted: DataFrame, now: float | Column, window: float = WINDOW) -> DataFrame:
    """(key, last) of the keys that an admission log (key, ts, allowed) must still remember at `now`; others are forgotten."""
    last = admitted.where("allowed").groupBy("key").agg(F.max("ts").alias("last"))
    return last.where((now if isinstance(now, Column) else F.lit(now)) - F.col("last") <= window)
