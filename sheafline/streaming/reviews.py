"""Keyed state over streams: human review of sessions, and windowed counts with a watermark.

``review_stream`` folds two kinds of events per session, a request that pauses it and a decision that resumes it, in a
state store: a decision without a request and a second decision are ignored, and a request without a decision expires
after a time to live. ``review_batch`` is the same fold over a finite log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session long, seq long, status string, action string"
STATE = "pending boolean, seq long"
APPROVING = ("approve", "approve_with_edit")


def status_of(action: Column) -> Column:
    return F.when(action.isin(*APPROVING), "grounded_synthesis").otherwise("refusal_redirect")


def review_batch(log: DataFrame) -> DataFrame:
    """session, seq, status, action: the first decision after the last request before it. log: session, seq, kind, action."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("kind").over(w)
    x = log.withColumn("before", before).where("kind = 'decision' AND before = 'request'")
    return x.select("session", "seq", status_of(F.col("action")).alias("status"), "action")


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        pending, seq = state.get
        state.remove()
        if pending:
            yield pd.DataFrame({"session": [key[0]], "seq": [seq], "status": ["expired"], "action": [None]})
        return
    pending, at = state.get if state.exists else (False, -1)
    out = []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples():
        if r.kind == "request":
            pending, at = True, int(r.seq)
        elif pending:
            out.append((key[0], int(r.seq), "grounded_synthesis" if r.action in APPROVING else "refusal_redirect", r.action))
            pending = False
    state.update((bool(pending), int(at)))
    if ttl_ms:
        state.setTimeoutDuration(ttl_ms)
    if out:
        yield pd.DataFrame(out, columns=["session", "seq", "status", "action"])


def review_stream(log: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """The streaming form: session, seq, status, action as decisions arrive. Without a time to live requests never expire
    (a stream over finite input then ends by itself)."""

    def fold(key, frames, state):
        return _fold(key, frames, state, ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return log.groupBy("session").applyInPandasWithState(fold, OUTPUT, STATE, "append", timeout)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total per window of event time. Works on streams (late rows are dropped) and on tables."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a zone
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")
