"""The event rules on unbounded streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.operators.anchored import epoch_millis
from tallyframe.operators.events import QUANTILES, duration_quantiles, fold_aggregates, folded_state


def with_event_time(df: DataFrame, column: str, delay: str = "10 minutes") -> DataFrame:
    """Cast a zoneless timestamp (read as session time) and set a watermark on it."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def live_runs(frames: DataFrame, *keys: str) -> DataFrame:
    """State of each run so far, for update or complete mode: the same aggregates as in batch.

    The state of a run stays as long as the query, so this is for streams with a bounded number of runs; see ended_runs.
    """
    return folded_state(frames.groupBy(*keys).agg(*fold_aggregates()))


def ended_runs(frames: DataFrame, at: str, idle: str, *keys: str) -> DataFrame:
    """Final state of each run, for append mode: a run ends when it has had no frame for ``idle``, and its state goes once the
    watermark on ``at`` (see with_event_time) has passed that moment. A later frame begins a new run of the same key."""
    state = frames.groupBy(*keys, F.session_window(at, idle).alias("session")).agg(*fold_aggregates())
    return folded_state(state).withColumn("ended_at", F.col("session.end")).drop("session")


def live_durations(trace: DataFrame, at: str, window: str, *keys: str) -> DataFrame:
    """Durations per time window; a window is final once the watermark has passed it."""
    ms = F.round("duration_ms", 3).cast("decimal(20,3)")
    return trace.groupBy(F.window(at, window).alias("w"), *keys).agg(
        F.count("*").alias("events"), F.sum(ms).cast("double").alias("total_ms"), F.max(ms).cast("double").alias("max_ms"),
        *duration_quantiles(ms)).select(F.col("w.start").alias("window_start"), *keys, "events", "total_ms", "max_ms", *QUANTILES)


_STATE = "start bigint, count bigint, t array<bigint>, order_id array<bigint>, ok array<boolean>"


def _behind_watermark(span: int, judge, columns: list[str]):
    """Hits of a key wait until the watermark has passed them and are then judged in order of time, as in batch.

    judge(start, count, t, ok) gives the window start and count after a hit, and what is said of it. State is the open window and
    the waiting hits; it goes when none waits and the watermark has passed the window.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        start, count, *waiting = state.get if state.exists else (None, 0, [], [], [])
        waiting = list(zip(*waiting))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["t"].tolist(), rows["order_id"].tolist(), rows["ok"].tolist())
        waiting.sort()
        out, ready = [], 0
        for t, order, ok in waiting:
            if t > watermark:
                break
            ready += 1
            start, count, said = judge(start, count, t, ok)
            out.append((key[0], order, *said))
        waiting = waiting[ready:]
        if not waiting and (start is None or watermark > start + span):
            if state.exists:
                state.remove()
        else:
            state.update((start, count, *([x[i] for x in waiting] for i in range(3))))
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else start + span, watermark) + 1)
        yield pd.DataFrame(out, columns=columns)

    return run


def _limit(span: int, limit: int):
    def judge(start, count, t, ok):
        if start is None or t >= start + span:
            start, count = t, 0
        allowed = count < limit
        count += int(allowed)
        return start, count, (t, allowed, limit - count, 0 if allowed else start + span - t)
    return judge


def _cache(ttl: int):
    def judge(stored, count, t, ok):
        hit = stored is not None and t - stored <= ttl
        return (t if ok and not hit else stored), count, (hit,)
    return judge


def _timed(df: DataFrame, key: str, at: str, order: str, delay: str, *more: Column) -> DataFrame:
    marked = df.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    return marked.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("order_id"),
                         epoch_millis(at).alias("t"), "__at", *more)


def live_rate_limit(
    hits: DataFrame, key: str, at: str, order: str, span_ms: int = 60_000, limit: int = 30, delay: str = "10 minutes"
) -> DataFrame:
    """Rate limit of a stream, append mode.

    A hit is judged once the watermark has passed it, in order of time with all others of its key, so hits may arrive in any order
    within ``delay``; later ones are dropped. Times are those of a session in UTC.
    """
    timed = _timed(hits, key, at, order, delay, F.lit(True).alias("ok"))
    if limit <= 0:
        return timed.drop("__at", "ok").select("*", F.lit(True).alias("allowed"), F.lit(None).cast("bigint").alias("remaining"), F.lit(0).cast("bigint").alias("retry_after_ms"))
    columns = ["key", "order_id", "t", "allowed", "remaining", "retry_after_ms"]
    return timed.groupBy("key").applyInPandasWithState(
        _behind_watermark(span_ms, _limit(span_ms, limit), columns), "key string, order_id bigint, t bigint, allowed boolean, remaining bigint, retry_after_ms bigint",
        _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_reuse(
    requests: DataFrame, key: str, at: str, order: str, success: Column, ttl_ms: int = 900_000, delay: str = "10 minutes"
) -> DataFrame:
    """Cache hits of a stream, append mode, judged in order of time behind the watermark like live_rate_limit."""
    timed = _timed(requests, key, at, order, delay, F.coalesce(success, F.lit(False)).alias("ok"))
    return timed.groupBy("key").applyInPandasWithState(
        _behind_watermark(ttl_ms, _cache(ttl_ms), ["key", "order_id", "cache_hit"]), "key string, order_id bigint, cache_hit boolean",
        _STATE, "append", GroupStateTimeout.EventTimeTimeout)
