"""Event-log rules on frames, traces and requests derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import anchored, events

_TRACE = ("question.started", "master_data.resolved", "prompt.built", "sql.validated", "sql.executed", "question.completed")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _trace_event():
    v = F.col("value")
    return (F.when(v < 2, _TRACE[0]).when(v < 5, _TRACE[1]).when(v < 10, _TRACE[2]).when(v < 15, _TRACE[3])
            .when(v < 20, _TRACE[4]).otherwise(_TRACE[5]))


def _frames(spark, d):
    """One frame per event; a run is one user's day."""
    e, v, kind = _events(spark, d), F.col("value"), F.col("event_type")
    frame = (
        F.when((kind == "signup") & (v < 1), "@start").when(kind == "signup", "stage").when((kind == "click") & (v < 5), "metrics")
        .when(kind == "click", "sql").when((kind == "view") & (v < 8), "columns").when((kind == "view") & (v < 12), "viz")
        .when(kind == "view", "insights").when(kind == "purchase", "done").when(v < 3, "error").when(v < 5, "@transport-error")
        .when(v < 8, "@cancelled").otherwise("rows")
    )
    return e.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), frame.alias("event"),
        events.stage_of(_trace_event()).alias("stage"), F.when(kind == "click", v > 4).alias("cache_hit"))


def folded_runs(spark, d):
    state = events.fold_runs(_frames(spark, d), "user_id", "day")
    return state.select("user_id", "day", "status", "stages", *[F.col(c).cast("int").alias(c) for c in state.columns[4:]])


def event_stages(spark, d):
    return _events(spark, d).groupBy(events.stage_of(_trace_event()).alias("stage")).agg(F.count("*").alias("events"))


def _trace(spark, d):
    e, v = _events(spark, d), F.col("value")
    kind = (
        F.when(F.col("event_type") == "error", F.when(v < 4, "llm.failed").when(v < 10, "sql.validation_failed").otherwise("sql.execution_failed"))
        .when(F.col("event_type") == "purchase", "question.completed").otherwise("prompt.built"))
    return e.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("seq"), kind.alias("event"),
        F.ceil(v / 10).cast("bigint").alias("attempt"), (v > 1).alias("success"), (v * 7).alias("duration_ms"))


def trace_durations(spark, d):
    return events.event_durations(_trace(spark, d), "day", "event")


def run_duration_totals(spark, d):
    return events.event_totals(_trace(spark, d), "user_id", "day").select("user_id", "day", "events", "total_ms")


def question_outcomes(spark, d):
    found = events.question_outcomes(_trace(spark, d), "user_id", "day")
    return found.select("user_id", "day", "attempts", F.col("success").cast("int").alias("success"),
                        F.coalesce("last_failed_part", F.lit("none")).alias("last_failed_part"))


def recent_user_queries(spark, d):
    query = F.concat_ws(" ", "event_type", F.floor("value").cast("string"))
    log = _events(spark, d).select("user_id", query.alias("query"), anchored.epoch_millis("ts").alias("asked_at"))
    return events.recent_queries(log, "user_id", "query", "asked_at").select(
        "user_id", F.col("position").cast("bigint").alias("position"), "query", "asked_at")


def rate_limited_hits(spark, d):
    """At most three hits per event type and six hours, counted from the first hit of a window."""
    hits = _events(spark, d).select("event_id", "event_type", "ts")
    limited = anchored.rate_limit(hits, "event_type", "ts", "event_id", 6 * 3600 * 1000, 3)
    return limited.select("event_id", F.col("allowed").cast("int").alias("allowed"), "remaining", "retry_after_ms")


def rate_limited_gaps(spark, d):
    """Hits of which some have no key and some no time: every hit keeps a verdict."""
    gap = lambda c, n: F.when(F.col("event_id") % n != 0, F.col(c))
    hits = _events(spark, d).select("event_id", gap("event_type", 3).alias("kind"), gap("ts", 7).alias("ts"))
    limited = anchored.rate_limit(hits, "kind", "ts", "event_id", 6 * 3600 * 1000, 3)
    return limited.select("event_id", F.col("allowed").cast("int").alias("allowed"), F.coalesce("remaining", F.lit(-1)).alias("remaining"), "retry_after_ms")


def reused_answers(spark, d):
    """Requests answered from an earlier success of the same user and question within a day."""
    key = anchored.cache_key(F.concat(F.lit("  "), F.upper("event_type"), F.lit("  x ")), F.floor(F.col("user_id") / 10))
    requests = _events(spark, d).select("event_id", key.alias("cache_key"), "ts", "value")
    return anchored.reuse(requests, "cache_key", "ts", "event_id", F.col("value") > 6, 86_400_000).select(
        "event_id", "cache_key", F.col("cache_hit").cast("int").alias("cache_hit"))


QUERIES = {
    f.__name__: f
    for f in (folded_runs, event_stages, trace_durations, run_duration_totals, question_outcomes, recent_user_queries,
              rate_limited_hits, rate_limited_gaps, reused_answers)
}

_STAGE_NO = "CASE WHEN value < 2 THEN 0 WHEN value < 5 THEN 1 WHEN value < 10 THEN 2 WHEN value < 15 THEN 3 WHEN value < 20 THEN 4 ELSE 5 END"
_DAY = "STRFTIME(ts, '%Y-%m-%d')"
_FRAME = """CASE WHEN event_type = 'signup' AND value < 1 THEN '@start' WHEN event_type = 'signup' THEN 'stage'
    WHEN event_type = 'click' AND value < 5 THEN 'metrics' WHEN event_type = 'click' THEN 'sql'
    WHEN event_type = 'view' AND value < 8 THEN 'columns' WHEN event_type = 'view' AND value < 12 THEN 'viz' WHEN event_type = 'view' THEN 'insights'
    WHEN event_type = 'purchase' THEN 'done' WHEN value < 3 THEN 'error' WHEN value < 5 THEN '@transport-error' WHEN value < 8 THEN '@cancelled' ELSE 'rows' END"""
_TRACE_SQL = f"""t AS (SELECT user_id, {_DAY} AS day, event_id AS seq, value, CASE WHEN event_type = 'error' THEN
        CASE WHEN value < 4 THEN 'llm.failed' WHEN value < 10 THEN 'sql.validation_failed' ELSE 'sql.execution_failed' END
        WHEN event_type = 'purchase' THEN 'question.completed' ELSE 'prompt.built' END AS event FROM events)"""
_MS = "CAST(ROUND(value * 7, 3) AS DECIMAL(20,3))"
_MILLIS = "(EPOCH_US(ts) // 1000)"


def _stage_sql(i: int) -> str:
    return f"CASE WHEN f.closed OR f.h > {i} THEN 'done' WHEN f.h = {i} THEN 'active' ELSE 'idle' END"


# An independent fold: a state machine over the ordered frames of each run.
_FOLD = f"""WITH x AS (SELECT user_id, {_DAY} AS day, event_id, {{'ev': {_FRAME}, 'no': {_STAGE_NO}, 'hit': value > 4, 'status': 'idle', 'h': -1,
        'closed': FALSE, 's': FALSE, 'c': FALSE, 'r': FALSE, 'v': FALSE, 'i': FALSE, 'cache': FALSE}} AS f FROM events),
    l AS (SELECT user_id, day, LIST(f ORDER BY event_id) AS fs FROM x GROUP BY 1, 2),
    r AS (SELECT user_id, day, LIST_REDUCE(LIST_PREPEND({{'ev': '', 'no': 0, 'hit': FALSE, 'status': 'idle', 'h': -1, 'closed': FALSE,
            's': FALSE, 'c': FALSE, 'r': FALSE, 'v': FALSE, 'i': FALSE, 'cache': FALSE}}, fs), LAMBDA a, e: {{'ev': '', 'no': 0, 'hit': FALSE,
        'status': CASE e.ev WHEN '@start' THEN 'streaming' WHEN 'error' THEN 'error' WHEN '@transport-error' THEN 'error'
            WHEN '@cancelled' THEN CASE WHEN a.c THEN 'done' ELSE 'idle' END
            WHEN 'done' THEN CASE WHEN a.status = 'error' THEN 'error' ELSE 'done' END ELSE a.status END,
        'h': CASE e.ev WHEN '@start' THEN 0 WHEN 'stage' THEN GREATEST(a.h, e.no) ELSE a.h END,
        'closed': CASE e.ev WHEN '@start' THEN FALSE WHEN 'done' THEN TRUE ELSE a.closed END,
        's': e.ev <> '@start' AND (a.s OR e.ev = 'sql'), 'c': e.ev <> '@start' AND (a.c OR e.ev = 'columns'),
        'r': e.ev <> '@start' AND (a.r OR e.ev = 'rows'), 'v': e.ev <> '@start' AND (a.v OR e.ev = 'viz'),
        'i': e.ev <> '@start' AND (a.i OR e.ev = 'insights'),
        'cache': CASE e.ev WHEN '@start' THEN FALSE WHEN 'sql' THEN e.hit WHEN 'metrics' THEN e.hit ELSE a.cache END}}) AS f FROM l)"""

ORACLES = {
    "folded_runs": f"""{_FOLD} SELECT user_id, day, f.status AS status, {" || ',' || ".join(_stage_sql(i) for i in range(6))} AS stages,
        CAST(f.s AS INT) AS has_sql, CAST(f.c AS INT) AS has_columns, CAST(f.r AS INT) AS has_rows, CAST(f.v AS INT) AS has_viz,
        CAST(f.i AS INT) AS has_insights, CAST(f.cache AS INT) AS cache_hit FROM r""",
    "event_stages": f"""SELECT ['planning', 'resolving_entities', 'generating_sql', 'validating', 'executing', 'shaping'][{_STAGE_NO} + 1] AS stage,
        COUNT(*) AS events FROM events GROUP BY 1""",
    "trace_durations": f"""WITH {_TRACE_SQL} SELECT day, event, COUNT(*) AS events, CAST(SUM({_MS}) AS DOUBLE) AS total_ms,
        ROUND(CAST(SUM({_MS}) AS DOUBLE) / COUNT(*), 3) AS mean_ms, CAST(MAX({_MS}) AS DOUBLE) AS max_ms,
        CAST(QUANTILE_DISC({_MS}, 0.5) AS DOUBLE) AS p50_ms, CAST(QUANTILE_DISC({_MS}, 0.95) AS DOUBLE) AS p95_ms FROM t GROUP BY day, event""",
    "run_duration_totals": f"""WITH {_TRACE_SQL} SELECT user_id, day, COUNT(*) AS events, CAST(SUM({_MS}) AS DOUBLE) AS total_ms FROM t GROUP BY 1, 2""",
    "question_outcomes": f"""WITH {_TRACE_SQL} SELECT user_id, day, CAST(MAX(CEIL(value / 10)) AS BIGINT) AS attempts,
        CAST(COALESCE(BOOL_OR(event = 'question.completed' AND value > 1), FALSE) AS INT) AS success,
        COALESCE(ARG_MAX(CASE event WHEN 'llm.failed' THEN 'llm' WHEN 'sql.validation_failed' THEN 'validation' WHEN 'sql.execution_failed' THEN 'execution' END,
            seq) FILTER (event IN ('llm.failed', 'sql.validation_failed', 'sql.execution_failed')), 'none') AS last_failed_part FROM t GROUP BY 1, 2""",
    "recent_user_queries": f"""WITH q AS (SELECT user_id, event_type || ' ' || CAST(FLOOR(value) AS BIGINT) AS query, MAX({_MILLIS}) AS asked_at FROM events GROUP BY 1, 2),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY asked_at DESC, query) AS position FROM q)
        SELECT user_id, position, query, asked_at FROM r WHERE position <= 8""",
    "rate_limited_hits": f"""WITH RECURSIVE e AS (SELECT event_type AS k, event_id, {_MILLIS} AS t FROM events),
        w AS (SELECT k, MIN(t) AS s FROM e GROUP BY k
              UNION ALL SELECT k, (SELECT MIN(t) FROM e WHERE e.k = w.k AND e.t >= w.s + 21600000) AS s FROM w
              WHERE EXISTS (SELECT 1 FROM e WHERE e.k = w.k AND e.t >= w.s + 21600000)),
        p AS (SELECT e.*, w.s, ROW_NUMBER() OVER (PARTITION BY e.k, w.s ORDER BY t, event_id) AS n FROM e JOIN w ON e.k = w.k AND t >= s AND t < s + 21600000)
        SELECT event_id, CAST(n <= 3 AS INT) AS allowed, GREATEST(3 - n, 0) AS remaining, CASE WHEN n > 3 THEN s + 21600000 - t ELSE 0 END AS retry_after_ms FROM p""",
    "rate_limited_gaps": f"""WITH RECURSIVE e AS (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type ELSE '(none)' END AS k, event_id, {_MILLIS} AS t FROM events WHERE event_id % 7 <> 0),
        w AS (SELECT k, MIN(t) AS s FROM e GROUP BY k
              UNION ALL SELECT k, (SELECT MIN(t) FROM e WHERE e.k = w.k AND e.t >= w.s + 21600000) AS s FROM w
              WHERE EXISTS (SELECT 1 FROM e WHERE e.k = w.k AND e.t >= w.s + 21600000)),
        p AS (SELECT e.*, w.s, ROW_NUMBER() OVER (PARTITION BY e.k, w.s ORDER BY t, event_id) AS n FROM e JOIN w ON e.k = w.k AND t >= s AND t < s + 21600000)
        SELECT event_id, CAST(n <= 3 AS INT) AS allowed, GREATEST(3 - n, 0) AS remaining, CASE WHEN n > 3 THEN s + 21600000 - t ELSE 0 END AS retry_after_ms FROM p
        UNION ALL SELECT event_id, 1, -1, 0 FROM events WHERE event_id % 7 = 0""",
    "reused_answers": f"""WITH RECURSIVE e AS (SELECT LOWER(event_type) || ' x::' || CAST(FLOOR(user_id / 10) AS BIGINT) AS k, event_id, {_MILLIS} AS t, value > 6 AS ok FROM events),
        g AS (SELECT k, t, MIN(event_id) AS id FROM e WHERE ok GROUP BY k, t),
        w AS (SELECT k, MIN(t) AS s FROM g GROUP BY k
              UNION ALL SELECT k, (SELECT MIN(t) FROM g WHERE g.k = w.k AND g.t > w.s + 86400000) AS s FROM w
              WHERE EXISTS (SELECT 1 FROM g WHERE g.k = w.k AND g.t > w.s + 86400000))
        SELECT e.event_id, e.k AS cache_key, CAST(COUNT(w.s) > 0 AS INT) AS cache_hit FROM e LEFT JOIN (SELECT w.*, g.id FROM w JOIN g ON w.k = g.k AND w.s = g.t) w
        ON w.k = e.k AND e.t <= w.s + 86400000 AND (e.t > w.s OR (e.t = w.s AND e.event_id > w.id)) GROUP BY 1, 2""",
}
