import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators import anchored, events
from tallyframe.streaming import live

ZERO = datetime.datetime(2026, 1, 1)


def at(ms):
    return ZERO + datetime.timedelta(milliseconds=ms)


def sequential_limit(hits, span, limit):
    state, out = {}, {}
    for key, t, order in sorted(hits, key=lambda h: (h[1], h[2])):
        start, count = state.get(key, (None, 0))
        if start is None or t >= start + span:
            start, count = t, 0
        allowed = count < limit
        count += allowed
        state[key] = (start, count)
        out[order] = (bool(allowed), limit - count, 0 if allowed else start + span - t)
    return out


def sequential_reuse(requests, ttl):
    stored, out = {}, {}
    for key, t, order, ok in sorted(requests, key=lambda h: (h[1], h[2])):
        hit = key in stored and t - stored[key] <= ttl
        if not hit and ok:
            stored[key] = t
        out[order] = hit
    return out


def random_hits(seed, count, keys, horizon):
    rng = random.Random(seed)
    # one key has most hits, many at the same millisecond, some far apart
    return [(rng.choice(["hot"] * 4 + keys), rng.choice([rng.randint(0, horizon), rng.randint(0, 50) * 100]), i, rng.random() < 0.4) for i in range(count)]


@pytest.mark.parametrize("span, limit, seed", [(100, 3, 1), (7, 1, 2), (1000, 30, 3)])
def test_rate_limit_equals_the_sequential_rule(spark, span, limit, seed):
    hits = random_hits(seed, 1500, ["a", "b", "c"], 60_000)
    df = spark.createDataFrame([(k, at(t), i) for k, t, i, _ in hits], "k string, ts timestamp_ntz, id bigint")
    got = {r.id: (r.allowed, r.remaining, r.retry_after_ms) for r in anchored.rate_limit(df, "k", "ts", "id", span, limit).collect()}
    assert got == sequential_limit([h[:3] for h in hits], span, limit)


@pytest.mark.parametrize("ttl, seed", [(100, 1), (6, 2), (2500, 3)])
def test_reuse_equals_the_sequential_rule(spark, ttl, seed):
    requests = random_hits(seed, 1500, ["a", "b"], 40_000)
    df = spark.createDataFrame([(k, at(t), i, ok) for k, t, i, ok in requests], "k string, ts timestamp_ntz, id bigint, ok boolean")
    got = {r.id: r.cache_hit for r in anchored.reuse(df, "k", "ts", "id", F.col("ok"), ttl).collect()}
    assert got == sequential_reuse(requests, ttl)


def test_many_small_groups_share_a_call():
    calls = []

    def work(rows):
        calls.append(rows["first"].to_pylist())
        return rows

    whole = pa.RecordBatch.from_pydict({"first": [i % 3 == 0 and not 900 < i < 45_000 for i in range(90_000)], "n": list(range(90_000))})
    for size in (700, 90_000):
        calls.clear()
        given = [whole.slice(i, size) for i in range(0, 90_000, size)]
        out = [n for batch in anchored._in_groups(work)(iter(given)) for n in batch["n"].to_pylist()]
        assert out == list(range(90_000)) and len(calls) <= 5 and all(c[0] for c in calls)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_windows_of_many_groups_at_once(size):
    """Groups of one hit and of many, entered by a window or not, a null key, and years 1 to 9999 in one group."""
    rng, span = random.Random(size), 100
    rows, want = [], []
    for key in [None, *(f"k{i}" for i in range(300))]:
        enters = rng.choice([None, None, -30, -99, -100])
        hits = sorted(rng.sample(range(1600), rng.choice([1, 1, 2, 40, 300])))
        hits = [-62_135_596_800_000, *hits, 253_402_300_799_999] if key == "k7" and enters is None else hits
        group = ([(key, None, enters, None)] if enters is not None else []) + [(key, t, t, t % 9) for t in hits]
        rows += [(i == 0, *(r if i == 0 else (None, *r[1:]))) for i, r in enumerate(group)]
        end = None if enters is None else enters + span
        for t in hits:
            if end is None or t >= end:
                want.append((key, t, t % 9))
                end = t + span
    names = ["first", "key", "upto", "leave", "mark"]
    types = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    out = anchored._opened(span)(whole.slice(i, size) for i in range(0, len(rows), size))
    assert [tuple(r.values()) for batch in out for r in batch.to_pylist()] == want


def test_many_keys_take_no_python_call_each(spark):
    rng = random.Random(12)
    requests = [(f"k{rng.randint(0, 200)}", rng.choice([rng.randint(0, 500), rng.randint(0, 400_000)]), i, rng.random() < 0.5) for i in range(3000)]
    df = spark.createDataFrame([(k, at(t), i, ok) for k, t, i, ok in requests], "k string, ts timestamp_ntz, id bigint, ok boolean")
    reused, limited = anchored.reuse(df, "k", "ts", "id", F.col("ok"), 99), anchored.rate_limit(df.drop("ok"), "k", "ts", "id", 100, 2)
    for found in (reused, limited):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan
    assert {r.id: r.cache_hit for r in reused.collect()} == sequential_reuse(requests, 99)
    assert {r.id: (r.allowed, r.remaining, r.retry_after_ms) for r in limited.collect()} == sequential_limit([r[:3] for r in requests], 100, 2)


def test_windows_on_both_sides_of_1970(spark):
    """Buckets below zero and from zero on end in one, so the levels come to an end."""
    schema = "key string, t bigint, mark bigint"
    hits = [(k, t, t) for k in ("a", None) for t in (-5000, -4991, -3, 6, 7, 900)]
    windows = anchored.anchored_windows(spark.createDataFrame(hits, schema), 10)
    assert anchored.anchored_windows(spark.createDataFrame([], schema), 10).count() == 0
    assert sorted((r.key or "", r.start, r.mark) for r in windows.collect()) == [(k, t, t) for k in ("", "a") for t in (-5000, -3, 7, 900)]


def test_limit_of_zero_is_off(spark):
    df = spark.createDataFrame([("a", at(0), 1)], "k string, ts timestamp_ntz, id bigint")
    assert anchored.rate_limit(df, "k", "ts", "id", 100, 0).first()["allowed"]


def test_cache_key_ignores_case_and_spaces(spark):
    df = spark.createDataFrame([("  Top   Sales ",), ("top sales",)], "q string")
    assert df.select(anchored.cache_key(F.col("q"), F.lit("13:"), F.lit(100)).alias("k")).distinct().count() == 1


FRAMES = "run string, seq bigint, event string, stage string, cache_hit boolean"


def frames(*items):
    return [("r", i, e, s, c) for i, (e, s, c) in enumerate(items)]


@pytest.mark.parametrize("items, status, stages", [
    ([("@start", None, None)], "streaming", "active,idle,idle,idle,idle,idle"),
    ([("@start", None, None), ("stage", "validating", None), ("stage", "planning", None)], "streaming", "done,done,done,active,idle,idle"),
    ([("@start", None, None), ("sql", None, True), ("columns", None, None), ("done", None, None)], "done", "done,done,done,done,done,done"),
    ([("@start", None, None), ("error", None, None), ("done", None, None)], "error", "done,done,done,done,done,done"),
    ([("@start", None, None), ("columns", None, None), ("@cancelled", None, None)], "done", "active,idle,idle,idle,idle,idle"),
    ([("@start", None, None), ("@cancelled", None, None)], "idle", "active,idle,idle,idle,idle,idle"),
    ([("@start", None, None), ("error", None, None), ("@start", None, None)], "streaming", "active,idle,idle,idle,idle,idle"),
    ([("@start", None, None), ("stage", "unknown", None)], "streaming", "active,idle,idle,idle,idle,idle"),
])
def test_fold(spark, items, status, stages):
    row = events.fold_runs(spark.createDataFrame(frames(*items), FRAMES), "run").first()
    assert (row["status"], row["stages"]) == (status, stages)


def test_cache_flag_follows_the_last_word(spark):
    rows = frames(("@start", None, None), ("sql", None, True), ("sql", None, None))
    assert events.fold_runs(spark.createDataFrame(rows, FRAMES), "run").first()["cache_hit"]
    rows = frames(("@start", None, None), ("sql", None, True), ("metrics", None, None))
    assert not events.fold_runs(spark.createDataFrame(rows, FRAMES), "run").first()["cache_hit"]


def run_stream(spark, stream, mode, name, checkpoint):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def parts(spark, df, folder, column, count=3):
    """Write a table as several files in time order."""
    placed = df.withColumn("n", F.ntile(count).over(W.orderBy(column))).cache()
    edges = placed.groupBy("n").agg(F.max(column).alias("last"))
    placed = placed.join(edges, "n")
    for n in range(1, count + 1):
        # rows that equal the last value of an earlier file belong to that file
        first = placed.groupBy().agg(F.max(F.when(F.col("n") < n, F.col(column)))).first()[0]
        last = placed.filter(F.col("n") == n).agg(F.max(column)).first()[0]
        piece = df.filter(F.col(column) <= F.lit(last))
        piece = piece if first is None else piece.filter(F.col(column) > F.lit(first))
        piece.coalesce(1).write.mode("append").parquet(str(folder))


def test_streamed_fold_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["@start", "stage", "sql", "columns", "rows", "done", "error", "metrics"]
    rows = [(f"r{rng.randint(0, 20)}", i, rng.choice(kinds), rng.choice(events.STAGES), rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, FRAMES)
    parts(spark, df, tmp_path / "in", "seq")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_stream(spark, live.live_runs(stream, "run"), "complete", "folded", tmp_path / "cp")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, events.fold_runs(df, "run").collect()))


@pytest.mark.parametrize("ordered", [True, False])
def test_streamed_limit_and_reuse_equal_batch(spark, tmp_path, ordered):
    """Files in order of time or not: hits within the delay are judged as in batch. A last hit moves the watermark past all."""
    hits = random_hits(9, 800, ["a", "b"], 20_000)
    schema = "k string, ts timestamp_ntz, id bigint, ok boolean"
    df = spark.createDataFrame([(k, at(t), i, ok) for k, t, i, ok in hits], schema)
    if ordered:
        parts(spark, df, tmp_path / "in", "ts")
    else:
        for n in range(4):
            df.filter(F.col("id") % 4 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", at(2_000_000), -1, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limited = run_stream(spark, live.live_rate_limit(read(), "k", "ts", "id", 5000, 4), "append", f"limited{ordered}", tmp_path / "c1")
    assert {r.order_id: (r.allowed, r.remaining, r.retry_after_ms) for r in limited.collect() if r.key != "end"} == sequential_limit([h[:3] for h in hits], 5000, 4)
    reused = run_stream(spark, live.live_reuse(read(), "k", "ts", "id", F.col("ok"), 3000), "append", f"reused{ordered}", tmp_path / "c2")
    assert {r.order_id: r.cache_hit for r in reused.collect() if r.key != "end"} == sequential_reuse(hits, 3000)


def test_ended_runs_drop_their_state(spark, tmp_path):
    rows = [("r1", 1, "@start", None, None, at(0)), ("r1", 2, "done", None, None, at(1000)), ("r2", 3, "@start", None, None, at(2000)), ("later", 4, "@start", None, None, at(9_000_000))]
    df = spark.createDataFrame(rows, FRAMES + ", ts timestamp_ntz")
    parts(spark, df, tmp_path / "in", "ts", 2)
    stream = live.with_event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "1 minute")
    out = run_stream(spark, live.ended_runs(stream, "ts", "5 minutes", "run"), "append", "ended", tmp_path / "cp")
    assert {r.run: r.status for r in out.collect()} == {"r1": "done", "r2": "streaming"}


def test_streamed_durations_close_behind_the_watermark(spark, tmp_path):
    rows = [(at(i * 60_000), "sql.executed", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event string, duration_ms double")
    parts(spark, df, tmp_path / "in", "ts")
    stream = live.with_event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "1 minute")
    out = run_stream(spark, live.live_durations(stream, "ts", "10 minutes", "event"), "append", "durations", tmp_path / "cp")
    found = {r.window_start.minute: (r.events, r.total_ms) for r in out.collect()}
    assert found[0] == (10, 45.0) and found[10] == (10, 145.0)


def test_outcomes_and_recent_queries(spark):
    trace = spark.createDataFrame([("r", 1, "llm.failed", 1, None), ("r", 2, "sql.validation_failed", 2, None), ("r", 3, "question.completed", 2, True)],
                                  "run string, seq bigint, event string, attempt int, success boolean")
    row = events.question_outcomes(trace, "run").first()
    assert (row.attempts, row.success, row.last_failed_part) == (2, True, "validation")
    log = spark.createDataFrame([("u", f"q{i % 10}", i) for i in range(30)], "u string, q string, t bigint")
    assert [r.q for r in events.recent_queries(log, "u", "q", "t").orderBy("position").collect()] == [f"q{i}" for i in range(9, 1, -1)]


def test_durations(spark):
    df = spark.createDataFrame([(at(0), at(1234), 1)], "a timestamp_ntz, b timestamp_ntz, x int")
    assert df.select(events.duration_between(F.col("a"), F.col("b")).alias("ms")).first()["ms"] == 1234.0


def test_rows_without_key_or_time_keep_a_verdict(spark):
    hits = [("a", at(0), 1), (None, at(5), 2), (None, at(6), 3), ("a", None, 4), (None, None, 5), ("a", at(1), 6)]
    df = spark.createDataFrame(hits, "k string, ts timestamp_ntz, id bigint")
    got = {r.id: (r.allowed, r.remaining, r.retry_after_ms) for r in anchored.rate_limit(df, "k", "ts", "id", 100, 1).collect()}
    assert got == {1: (True, 0, 0), 2: (True, 0, 0), 3: (False, 0, 99), 4: (True, None, 0), 5: (True, None, 0), 6: (False, 0, 99)}
    got = {r.id: r.cache_hit for r in anchored.reuse(df, "k", "ts", "id", F.lit(True), 10).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}
    assert anchored.rate_limit(df.limit(0), "k", "ts", "id", 100, 1).count() == 0


def test_long_histories_compose_over_levels(spark):
    """One key with hits over many buckets, so that several levels are needed."""
    rng = random.Random(11)
    hits = [("a", rng.randint(0, 3_000_000), i) for i in range(2000)] + [("a", -rng.randint(1, 900_000), 5000 + i) for i in range(300)]
    df = spark.createDataFrame([(k, at(t), i) for k, t, i in hits], "k string, ts timestamp_ntz, id bigint")
    got = {r.id: (r.allowed, r.remaining, r.retry_after_ms) for r in anchored.rate_limit(df, "k", "ts", "id", 700, 2).collect()}
    assert got == sequential_limit(hits, 700, 2)
