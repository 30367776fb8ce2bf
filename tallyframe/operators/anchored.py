"""Windows anchored at the first hit of a key: fixed-window limits and reuse within a time to live.

A window opens at a hit and closes after a fixed span; the next hit opens the next one. The
anchors of a key therefore follow from one another, yet no key is handled in one piece:
time is cut into buckets, and a bucket is reduced to a small step function from the anchor
that enters it to the anchor that leaves it. These functions are composed as a tree: a few buckets
that follow each other make a wider one, level by level, and the entering anchors come back down
the same way. No group holds more than FAN functions of one level, or the hits of one bucket.
Hits of one key and millisecond are folded first, so a bucket is bounded by its length.

A function is a run of rows: an entering window that ends at or before ``upto`` leaves as ``leave``, for the
smallest such ``upto``. A hit is the step from itself to itself. Python gets the sorted rows of many groups
at once, as most keys have few hits in a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.shared import written

SPANS_PER_BUCKET = 16
#: Buckets of a level that make one of the next.
FAN = 32
#: Rows that Python takes together, and the rest of the group they end in.
ROWS_AT_ONCE = 20_000


def epoch_millis(column: str) -> Column:
    """Milliseconds since the epoch of a timestamp without zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MICROSECOND", start, F.col(column).cast("timestamp_ntz")) / 1000).cast("bigint")


class _Steps:
    """The sorted steps of whole groups, with the anchor that enters a group as a row without ``upto`` before them."""

    def __init__(self, rows: pa.Table, span: int):
        first, entry = np.asarray(rows["first"]), np.asarray(rows["upto"].is_null())
        self.keys = rows.filter(rows["first"])["key"]
        group, leave = np.cumsum(first) - 1, np.asarray(rows["leave"])
        self.enters = np.zeros(len(self.keys), bool)
        self.enters[group[entry]] = True
        self.entering = np.zeros(len(self.keys), np.int64)
        self.entering[group[entry]] = leave[entry]
        self.rows = rows.filter(rows["upto"].is_valid())
        self.group, self.leave, self.upto = group[~entry], leave[~entry], np.asarray(self.rows["upto"])
        self.end = np.cumsum(np.bincount(self.group, minlength=len(self.keys)))
        self.begin = np.concatenate([[0], self.end[:-1]])
        some = self.begin < self.end
        self._low, self._high = np.zeros((2, len(self.keys)), np.int64)
        self._low[some], self._high[some] = self.upto[self.begin[some]], self.upto[self.end[some] - 1]
        # one ascending number for group and time: the groups' ranges one after the other
        wide = self._high - self._low + 2
        self._offset = np.cumsum(wide) - wide
        self._place = self._offset[self.group] + self.upto - self._low[self.group]
        follows = self.at_or_after(self.group, self.leave + span)
        self.ends = follows == self.end[self.group]
        self.follows = np.where(self.ends, np.arange(len(follows)), follows)

    def at_or_after(self, group: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The place of the first step of each group that is not before t; the group's end if there is none."""
        return np.searchsorted(self._place, self._offset[group] + np.clip(t, self._low[group], self._high[group] + 1) - self._low[group])

    def left_by(self) -> np.ndarray:
        """The anchor that leaves the group when each step is the first one taken."""
        chain = self.follows
        while True:
            further = chain[chain]
            if (further == chain).all():
                return self.leave[chain]
            chain = further

    def taken(self, span: int) -> np.ndarray:
        """Which steps are taken from the anchor that enters each group."""
        group = np.arange(len(self.keys))
        place = np.where(self.enters, self.at_or_after(group, self.entering + span), self.begin)
        place = place[place < self.end]
        found = np.zeros(len(self.upto), bool)
        while len(place):
            found[place] = True
            place = self.follows[place[~self.ends[place]]]
        return found


def _in_groups(work: Callable[[pa.Table], pa.Table]):
    """Run over sorted rows, many whole groups at once; ``first`` marks the first row of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in (b.slice(i, ROWS_AT_ONCE // 2) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE // 2)):
            starts = np.flatnonzero(np.asarray(batch["first"])) if count >= ROWS_AT_ONCE else []
            if len(starts):
                cut = int(starts[-1])
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()).to_batches()
                batch, held, count = batch.slice(cut), [], 0
            held.append(batch)
            count += batch.num_rows
        if count:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def _joined(span: int, width: int):
    """The steps of each bucket of this width as one function."""

    def work(rows: pa.Table) -> pa.Table:
        steps = _Steps(rows, span)
        group, upto, leave = steps.group, steps.upto, steps.left_by()
        # a window that enters ends within a span of the bucket's start
        every = np.arange(len(steps.keys))
        entries = steps.at_or_after(every, upto[steps.begin] // width * width + span)
        last = np.append((leave[1:] != leave[:-1]) | (group[1:] != group[:-1]), True)
        place = np.arange(len(upto))
        last[entries[entries < steps.end]] = True
        keep = last & (place <= entries[group])
        return pa.table({"key": steps.keys.take(pa.array(group[keep])), "upto": upto[keep], "leave": leave[keep]})

    return _in_groups(work)


def _spread(span: int, width: int):
    """The anchor that enters each bucket of this width, if any, from the one that enters the wider bucket around it."""

    def work(rows: pa.Table) -> pa.Table:
        steps = _Steps(rows, span)
        group, bucket, place = steps.group, steps.upto // width, np.arange(len(steps.upto))
        before = np.append(-1, np.maximum.accumulate(np.where(steps.taken(span), place, -1)))[:-1]
        inside = before >= steps.begin[group]
        entering = np.where(inside, steps.leave[before], steps.entering[group])
        head = np.append(True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1]))[:len(place)]
        keep = head & (inside | steps.enters[group])
        return pa.table({"key": steps.keys.take(pa.array(group[keep])), "bucket": bucket[keep], "entering": entering[keep]})

    return _in_groups(work)


def _opened(span: int):
    """The hits that open a window."""

    def work(rows: pa.Table) -> pa.Table:
        steps = _Steps(rows, span)
        taken = steps.taken(span)
        return pa.table({"key": steps.keys.take(pa.array(steps.group[taken])), "start": steps.upto[taken], "mark": steps.rows["mark"].filter(pa.array(taken))})

    return _in_groups(work)


def _bucket(t: str, width: int) -> Column:
    return F.floor(F.col(t) / width).cast("bigint")


def _sorted(steps: DataFrame, width: int, entering: DataFrame | None = None) -> DataFrame:
    """The steps of each bucket of this width in order, behind the anchor that enters it; the key once a group."""
    rows = steps.withColumn("bucket", _bucket("upto", width))
    if entering is not None:
        rows = rows.unionByName(entering.withColumnRenamed("entering", "leave"), allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy("key", "bucket").orderBy(F.col("upto").asc_nulls_first())) == 1
    rows = rows.withColumn("first", first)
    return rows.select("first", F.when(F.col("first"), F.col("key")).alias("key"), *[c for c in rows.columns if c not in ("first", "key", "bucket")])


def anchored_windows(opening: DataFrame, span: int) -> DataFrame:
    """The windows of each key (key, start, mark): ``opening`` holds distinct key and t (ms, not null) that may open one, and mark, kept with it.

    A null key is a key. Time counts from the first instant, so all of it lies in one bucket at last; how many levels that takes comes from the last one.
    """
    opening = written(opening)
    kind, mark = (opening.schema[c].dataType.simpleString() for c in ("key", "mark"))
    low, high = opening.agg(F.min("t"), F.max("t")).first()
    low, high = low or 0, high or 0
    since = F.col("t") - low
    steps = opening.select("key", since.alias("upto"), since.alias("leave"))
    levels, width = [], span * SPANS_PER_BUCKET
    while high - low >= width:
        steps = written(_sorted(steps, width).mapInArrow(_joined(span, width), f"key {kind}, upto bigint, leave bigint"))
        levels.append((steps, width))
        width *= FAN
    entering = None
    for steps, narrow in reversed(levels):
        entering = _sorted(steps, width, entering).mapInArrow(_spread(span, narrow), f"key {kind}, bucket bigint, entering bigint")
        width = narrow
    hits = opening.select("key", since.alias("upto"), since.alias("leave"), "mark")
    windows = _sorted(hits, width, entering).mapInArrow(_opened(span), f"key {kind}, start bigint, mark {mark}")
    return windows.withColumn("start", F.col("start") + low)


def _within(rows: DataFrame, key: str, at: str, windows: DataFrame, span: int) -> DataFrame:
    """The rows with ``__window`` (start, mark), the window of their key that their time lies in; null where none is open."""
    width = span * SPANS_PER_BUCKET
    reached = F.array_distinct(F.array(_bucket("start", width), F.floor((F.col("start") + (span - 1)) / width).cast("bigint")))
    near = windows.select(F.col("key").alias("__key"), F.explode(reached).alias("__near"), F.struct("start", "mark").alias("__window"))
    near = near.groupBy("__key", "__near").agg(F.collect_list("__window").alias("__windows"))
    found = rows.withColumn("__bucket", _bucket(at, width)).join(near, F.expr(f"`{key}` <=> __key AND __bucket = __near"), "left")
    open_now = F.filter("__windows", lambda w: (w["start"] <= F.col(at)) & (F.col(at) < w["start"] + span))
    return found.withColumn("__window", F.get(open_now, F.lit(0))).drop("__key", "__near", "__bucket", "__windows")


def _back(rows: DataFrame, key: str, placed: DataFrame) -> DataFrame:
    """The rows with what holds for their key and instant (columns key and t of placed, dropped); rows without a time get nulls."""
    return rows.join(placed, rows[key].eqNullSafe(placed["key"]) & (rows["__t"] == placed["t"]), "left").drop(placed["key"], placed["t"])


def rate_limit(hits: DataFrame, key: str, at: str, order: str, span_ms: int = 60_000, limit: int = 30) -> DataFrame:
    """Add allowed, remaining and retry_after_ms to each hit. A limit of zero or less turns limiting off.

    ``order`` settles hits of the same millisecond. A null key is a key of its own. A hit without a time can't be
    placed in a window: it is allowed, with no count left or spent.
    """
    if limit <= 0:
        return hits.select("*", F.lit(True).alias("allowed"), F.lit(None).cast("bigint").alias("remaining"), F.lit(0).cast("bigint").alias("retry_after_ms"))
    timed = hits.withColumn("__t", epoch_millis(at))
    folded = timed.filter(F.col("__t").isNotNull()).groupBy(F.col(key).alias("key"), F.col("__t").alias("t")).agg(F.count("*").alias("n"))
    windows = anchored_windows(folded.select("key", "t", F.lit(None).cast("bigint").alias("mark")), span_ms)
    before = F.sum("n").over(W.partitionBy("key", "start").orderBy("t").rowsBetween(W.unboundedPreceding, -1))
    placed = _within(folded, "key", "t", windows, span_ms).withColumn("start", F.col("__window.start"))
    placed = placed.select("key", "t", "start", F.coalesce(before, F.lit(0)).alias("__before"))
    # hits of one millisecond are put in order; a window of a key has at most span_ms milliseconds
    rank = F.row_number().over(W.partitionBy(key, "__t").orderBy(order))
    ranked = _back(timed.withColumn("__rank", rank), key, placed)
    position = F.col("__before") + F.col("__rank")
    return ranked.select(
        *hits.columns, F.coalesce(position <= limit, F.lit(True)).alias("allowed"), F.when(position.isNotNull(), F.greatest(F.lit(limit) - position, F.lit(0))).alias("remaining"),
        F.when(position > limit, F.col("start") + span_ms - F.col("__t")).otherwise(0).cast("bigint").alias("retry_after_ms"))


def cache_key(question: Column, *parts: Column) -> Column:
    """Normalised question joined with whatever else must agree."""
    text = F.lower(F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " ")))
    return F.concat_ws("::", text, *[p.cast("string") for p in parts])


def reuse(requests: DataFrame, key: str, at: str, order: str, success: Column, ttl_ms: int = 900_000) -> DataFrame:
    """Add ``cache_hit``: was a successful answer stored at most ``ttl_ms`` ago? Hits do not renew it, failures are not stored.

    A null key is a key of its own. A request without a time neither hits nor stores.
    """
    timed = requests.withColumn("__t", epoch_millis(at)).withColumn("__ok", F.coalesce(success, F.lit(False)))
    stored = timed.filter(F.col("__ok") & F.col("__t").isNotNull()).groupBy(F.col(key).alias("key"), F.col("__t").alias("t")).agg(F.min(order).alias("mark"))
    # a window is open up to and with its last millisecond
    placed = _within(timed, key, "__t", anchored_windows(stored, ttl_ms + 1), ttl_ms + 1)
    hit = (F.col("__t") > F.col("__window.start")) | (F.col(order) > F.col("__window.mark"))
    return placed.select(*requests.columns, F.coalesce(hit, F.lit(False)).alias("cache_hit"))
