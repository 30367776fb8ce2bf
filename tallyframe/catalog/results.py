"""Profiles, insights, comparisons and checks of whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.numbers import cell_key, exact
from tallyframe.operators import compare, explore, profile, quality
from tallyframe.operators.quality import SignalChecks
from tallyframe.plans import star
from tallyframe.plans.retail import orders_as_retail


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orders(spark, d):
    return _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total"),
        F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"))


def _profiled(name):
    return lambda spark, d: profile.column_profile(_t(spark, d, name), exact=True).select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "column", "label", "type",
        F.coalesce("semantic_type", F.lit("")).alias("semantic_type"), "row_count", "non_null_count", "numeric_count",
        "date_count", "unique_count")


def order_column_samples(spark, d):
    return profile.column_samples(_orders(spark, d), ["order_id"]).select(
        "column", F.element_at("samples", 1).alias("first_value"), F.size("samples").cast("bigint").alias("sample_count"))


def order_insights(spark, d):
    found = profile.insights(_orders(spark, d), ["order_id"])
    return found.select("insight", F.coalesce("value", F.lit("")).alias("value"), F.round("amount", 2).alias("amount"), "tone")


def priority_chart_series(spark, d):
    table = _orders(spark, d)
    return profile.chart_series(table).select("chart_id", "type", "x", "series", F.round("y", 2).alias("y"))


def small_chart_series(spark, d):
    """Two metrics over a handful of priorities: bar and pie."""
    few = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(exact("o_totalprice")).alias("total"), F.count("*").alias("orders"))
    return profile.chart_series(few).select("chart_id", "type", "x", "series", F.round("y", 2).alias("y"))


def chart_exclusions(spark, d):
    """Why a kind of chart is not offered for the orders."""
    return profile.chart_choices(_orders(spark, d)).select("type", F.coalesce("chart_id", F.lit("")).alias("chart_id"), F.coalesce("excluded", F.lit("")).alias("excluded"))


def line_metric_series(spark, d):
    """A line shows every metric of a table, not the first few."""
    monthly = _t(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("ship_month")).agg(
        *[F.sum(exact(c)).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], F.count("*").alias("lines"))
    return profile.chart_series(monthly).select("type", "x", "series", F.round("y", 2).alias("y"))


def monthly_chart_series(spark, d):
    monthly = star.monthly_trend(orders_as_retail(spark, d), "net_sales")
    return profile.chart_series(monthly).select("chart_id", "type", "confidence", "x", "series", F.round("y", 2).alias("y"))


def first_thousand_orders(spark, d):
    return profile.capped(_orders(spark, d).select("order_id", "total"), 1000, ["order_id"])


def filtered_orders(spark, d):
    """Rows in which any column contains the text."""
    return explore.contains_filter(_orders(spark, d), " 5-lo ").select("order_id", "priority")


def filtered_order_insights(spark, d):
    kept = explore.contains_filter(_orders(spark, d), "urgent")
    found = profile.insights(kept, ["order_id"])
    return found.select("insight", F.coalesce("value", F.lit("")).alias("value"), F.round("amount", 2).alias("amount"), "tone")


def natural_brand_order(spark, d):
    """Brands in natural order: Brand#2 comes before Brand#10."""
    brands = _t(spark, d, "part").select("p_brand").distinct()
    key = explore.sort_key("p_brand", brands.schema["p_brand"].dataType)
    return explore.typed_sort(brands, "p_brand").select("p_brand", key.alias("natural_key"))


def event_cell_keys(spark, d):
    e = _t(spark, d, "events").withColumn("as_text", F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("e1 ")))
    key = lambda c, n=2: cell_key(F.col(c), e.schema[c].dataType, n)
    return e.select("event_id", key("value").alias("value_key"), key("value", 1).alias("coarse_key"),
                    key("as_text").alias("text_number_key"), key("event_type").alias("type_key"))


def _part_counts(spark, d, low, high):
    ship = F.col("l_shipdate")
    return _t(spark, d, "lineitem").filter(
        (ship >= F.lit(low).cast("timestamp_ntz")) & (ship < F.lit(high).cast("timestamp_ntz"))
    ).groupBy("l_partkey").agg(F.count("*").alias("n"))


def shipped_month_differences(spark, d):
    """Parts whose number of shipments differs between two months, by side."""
    a = _part_counts(spark, d, "1997-02-01", "1997-03-01")
    b = _part_counts(spark, d, "1997-03-01", "1997-04-01")
    return compare.difference_rows(a, b, ["l_partkey", "n"]).withColumnRenamed("rows", "row_count")


def rowset_comparison(spark, d):
    """The line-level total by brand against the same total under other names and with extra columns."""
    model = orders_as_retail(spark, d)
    mine = star.metric(model, "line_net_sales", by="brand", live_only=False)
    raw = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    net = exact("l_extendedprice") * (F.lit(1).cast("decimal(3,2)") - exact("l_discount", 4, 2))
    other = raw.groupBy(F.col("p_brand").alias("label")).agg(
        F.sum(net).cast("double").alias("revenue"), F.count("*").alias("lines"))
    same = compare.rowset_equal(mine, other, ["BrandName", "total_net_amount"], {"BrandName": "label", "total_net_amount": "revenue"})
    return same.select(F.col("rows_match").cast("int").alias("rows_match"), "missing_rows", "extra_rows")


def strict_comparison(spark, d):
    a = _t(spark, d, "part")
    b = a.select(*[F.col(c).alias(c.upper()) for c in reversed(a.columns)]).withColumn(
        "P_RETAILPRICE", F.col("P_RETAILPRICE") + 0.0001)
    return compare.strict_equal(a, b).select(F.col("rows_match").cast("int").alias("rows_match"))


def aligned_columns(spark, d):
    """Columns that hold the same values under other names."""
    c = _t(spark, d, "customer")
    a = compare.column_digests(c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    b = compare.column_digests(c.select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").cast("string").alias("id"),
                                        F.upper("c_name").alias("label"), F.col("c_nationkey").alias("nation")))
    keys = ["rows", "hash_sum", "hash_xor"]
    return a.withColumnRenamed("column", "expected").join(b.withColumnRenamed("column", "actual"), keys).select("expected", "actual")


def ranking_check(spark, d):
    return compare.ranking_violations(_t(spark, d, "orders"), "o_orderkey", "o_totalprice", "desc", 1000.0)


def _priced(spark, d):
    p = _t(spark, d, "part").select("p_brand", "p_retailprice", "p_size")
    moved = p.select("p_brand", (F.col("p_retailprice") + (F.col("p_size") % 7 - 3) * 0.17).alias("p_retailprice"), "p_size")
    return p, moved


def tolerance_check(spark, d):
    a, b = _priced(spark, d)
    brand = F.get(F.from_json("key", "array<string>"), F.lit(0))
    return compare.tolerance_violations(a, b, ["p_brand"], "p_retailprice", 0.4).select(brand.alias("brand_key"))


def joint_tolerance_check(spark, d):
    """Two numbers per row have to match together."""
    a, b = _priced(spark, d)
    brand = F.get(F.from_json("key", "array<string>"), F.lit(0))
    return compare.multi_tolerance_violations(a, b, ["p_brand"], ["p_retailprice", "p_size"], 0.45).select(brand.alias("brand_key"))


def full_result_comparison(spark, d):
    """Whole comparisons: columns aligned, numbers within a tolerance, order of a ranking."""
    o = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(exact("o_totalprice")).cast("double").alias("total"), F.count("*").alias("orders"))
    other = o.select(F.col("orders").alias("n"), F.upper("o_orderpriority").alias("label"), F.lit("x").alias("more"), F.col("total").alias("sum"))
    moved = other.withColumn("sum", F.col("sum") + F.when(F.col("label") == "1-URGENT", 0.9).otherwise(0.3))
    placed = o.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"))))  # a row for each priority
    turned = placed.withColumn("place", F.lit(100) - F.col("place"))
    ranked = {"mode": "ranked", "value_columns": ["total"]}
    cases = [
        ("renamed", o, other, {}, None), ("one_value_lost", o, other.withColumn("sum", F.when(F.col("n") > 0, F.lit(1.0))), {}, None),
        ("within_tolerance", o, moved, {"tolerance": 1.0}, None), ("beyond_tolerance", o, moved, {"tolerance": 0.5}, None), ("moved_without_tolerance", o, moved, {}, None),
        ("ranked", placed, placed, ranked, "place"), ("ranking_turned", placed, turned, ranked, "place")]
    # the same value counts in every column, so that only whole rows tell which column is which
    days = _t(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("m")).select(
        "o_orderkey", *[((F.col("m") + F.col("o_orderkey") * k) % 12).alias(f"m{k}") for k in (0, 1, 5, 7)])
    shuffled = days.select(F.col("m7").alias("a"), F.col("m0").alias("b"), F.col("o_orderkey").alias("key"), F.col("m5").alias("c"), F.col("m1").alias("d"))
    turn = F.col("key") % 4 == 1
    crossed = shuffled.select(F.when(turn, F.col("d")).otherwise(F.col("a")).alias("a"), "b", "key", "c", F.when(turn, F.col("a")).otherwise(F.col("d")).alias("d"))
    rows_of = _t(spark, d, "orders").agg(F.count("*").alias("n"))
    cases += [
        ("columns_permuted", days, shuffled, {}, None), ("columns_crossed", days, crossed, {}, None),
        ("scalar", rows_of, o.agg(F.sum("orders").alias("total")), {"mode": "scalar"}, None),
        ("scalar_off_by_one", rows_of, rows_of.withColumn("n", F.col("n") + 1), {"mode": "scalar"}, None)]
    rows = [(name, int(compare.compare_results(a, b, compare.Comparison.of(spec), rank))) for name, a, b, spec, rank in cases]
    return spark.createDataFrame(rows, "case string, matches int")


def large_number_comparison(spark, d):
    """Values up to 1e18, a tenth of them doubled: no two collapse."""
    e = _t(spark, d, "events").select("event_id", (F.col("value") * 1e16).alias("v"))
    b = e.withColumn("v", F.when(F.col("event_id") % 10 == 0, F.col("v") * 2).otherwise(F.col("v")))
    same = compare.rowset_equal(e, b, ["event_id", "v"])
    return same.select(F.col("rows_match").cast("int").alias("rows_match"), "missing_rows", "extra_rows")


_CHECKS = SignalChecks(5_000_000_000, ("l_discount", "l_tax"), ("l_partkey", "l_shipdate"), {"l_returnflag": 4, "l_linenumber": 3})


def lineitem_check_failures(spark, d):
    return quality.check_failures(_t(spark, d, "lineitem"), _CHECKS).select(
        "code", F.coalesce("column", F.lit("")).alias("column"), F.coalesce("expected", F.lit(-1)).alias("expected"), "actual", "message")


def empty_result_check(spark, d):
    none = _t(spark, d, "lineitem").filter(F.col("l_quantity") < 0)
    return quality.check_failures(none, SignalChecks(None, ("l_tax",))).select("code", "actual", "message")


def verified_results(spark, d):
    model = orders_as_retail(spark, d)
    by_type = star.metric(model, "document_count", by="document_type")
    by_segment = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    regions = _t(spark, d, "region")
    return quality.verify_results([
        ("count_by_type", by_type, 5, SignalChecks(3, ("document_count",), ("DocumentTypeName",), {"DocumentTypeName": 3})),
        ("segments", by_segment, 4, SignalChecks(1)),
        ("regions", regions, None, SignalChecks(6, (), ("r_name",), {"r_name": 9})),
    ]).select("case_id", "row_count", "failed_checks", F.col("passed").cast("int").alias("passed"))


QUERIES = {
    "lineitem_profile": _profiled("lineitem"),
    "events_profile": _profiled("events"),
    "documents_profile": _profiled("documents"),
    **{
        f.__name__: f
        for f in (
            order_column_samples, order_insights, priority_chart_series, monthly_chart_series, small_chart_series, chart_exclusions, line_metric_series, first_thousand_orders,
            filtered_orders, filtered_order_insights, natural_brand_order, event_cell_keys, shipped_month_differences,
            rowset_comparison, strict_comparison, aligned_columns, ranking_check, tolerance_check, joint_tolerance_check,
            full_result_comparison, large_number_comparison,
            lineitem_check_failures, empty_result_check, verified_results,
        )
    },
}


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """Labels and roles are worked out by SQL patterns of their own."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        numeric = f"COUNT({c})" if kind == "number" else "0"
        dates = f"COUNT({c})" if kind == "date" else "0"
        label = f"UPPER('{c[0]}') || REPLACE('{c[1:]}', '_', ' ')"
        role = f"""CASE WHEN REGEXP_MATCHES('{c}', '(^|_)(week|month|quarter|period|date|day)(_|$)') THEN 'temporal_bucket'
            WHEN REGEXP_MATCHES('{c}', '(^|_)(id|code)$') THEN 'identifier' ELSE '' END"""
        parts.append(
            f"""SELECT {i} AS ordinal, '{c}' AS "column", {label} AS label, '{kind}' AS type, {role} AS semantic_type,
            COUNT(*) AS row_count, COUNT({c}) AS non_null_count, {numeric} AS numeric_count, {dates} AS date_count,
            COUNT(DISTINCT {c}) AS unique_count FROM {table}""")
    return " UNION ALL ".join(parts)


_NUM = lambda *names: [(n, "number") for n in names]
_TXT = lambda *names: [(n, "text") for n in names]

_INSIGHTS = """SELECT 'row-count' AS insight, 'all rows' AS value, CAST(COUNT(*) AS DOUBLE) AS amount,
        CASE WHEN COUNT(*) > 500 THEN 'warning' ELSE 'neutral' END AS tone FROM o
    UNION ALL SELECT 'total-total', '', ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE), 2), 'positive' FROM o
    UNION ALL SELECT 'mean-total', '', ROUND(CAST(SUM(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) / COUNT(*), 2), 'positive' FROM o
    UNION ALL SELECT * FROM (SELECT 'top-priority-total', o_orderpriority, o_totalprice, 'positive' FROM o ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
    UNION ALL SELECT 'trend-order_date-total', CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END, ROUND(d, 2),
        CASE WHEN d >= 0 THEN 'positive' ELSE 'warning' END FROM (
        SELECT (SELECT o_totalprice FROM o ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
             - (SELECT o_totalprice FROM o ORDER BY o_orderdate, o_orderkey LIMIT 1) AS d)"""
_Q = "CAST(o_totalprice AS DECIMAL(18,2))"
_FLOOR = lambda x, f: f"FLOOR(({x} + 2.220446049250313e-16) * {f}.0 + 0.5) / {f}.0"
_NETSQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"

ORACLES = {
    "lineitem_profile": _profile_sql("lineitem", [
        *_NUM("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        *_TXT("l_returnflag", "l_linestatus"), ("l_shipdate", "date")]),
    "events_profile": _profile_sql("events", [
        *_NUM("event_id"), ("ts", "date"), *_NUM("user_id"), *_TXT("event_type"), *_NUM("value"), *_TXT("props")]),
    "documents_profile": _profile_sql("documents", [*_NUM("doc_id"), *_TXT("text", "lang", "source"), *_NUM("n_chars")]),
    "order_column_samples": " UNION ALL ".join(
        f"""SELECT '{a}' AS "column", (SELECT CAST({c} AS VARCHAR) FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 1) AS first_value,
        (SELECT COUNT(*) FROM (SELECT 1 FROM orders WHERE {c} IS NOT NULL LIMIT 5)) AS sample_count"""
        for a, c in (("order_id", "o_orderkey"), ("customer_id", "o_custkey"), ("total", "o_totalprice"),
                     ("order_date", "o_orderdate"), ("priority", "o_orderpriority"))),
    "order_insights": f"WITH o AS (SELECT * FROM orders) {_INSIGHTS}",
    "filtered_order_insights": f"WITH o AS (SELECT * FROM orders WHERE o_orderpriority ILIKE '%urgent%') {_INSIGHTS}",
    "priority_chart_series": f"""SELECT 'bar-priority-total' AS chart_id, 'bar' AS type, o_orderpriority AS x, 'total' AS series,
        ROUND(CAST(SUM({_Q}) AS DOUBLE), 2) AS y FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT kind || '-order_date-total', kind, CAST(o_orderdate AS VARCHAR), 'total', ROUND(CAST(SUM({_Q}) AS DOUBLE), 2)
        FROM orders, (VALUES ('line'), ('area')) c(kind) GROUP BY kind, o_orderdate""",
    "small_chart_series": f"""SELECT kind || '-o_orderpriority-total' AS chart_id, kind AS type, o_orderpriority AS x, 'total' AS series, ROUND(CAST(SUM({_Q}) AS DOUBLE), 2) AS y
        FROM orders, (VALUES ('bar'), ('pie')) c(kind) GROUP BY kind, o_orderpriority""",
    "chart_exclusions": """SELECT type, CASE WHEN excluded = '' THEN chart_id ELSE '' END AS chart_id, excluded FROM (SELECT 'line' AS type, 'line-order_date-total' AS chart_id, '' AS excluded
        UNION ALL SELECT 'area', 'area-order_date-total', '' UNION ALL SELECT 'bar', 'bar-priority-total', CASE WHEN COUNT(DISTINCT o_orderpriority) NOT BETWEEN 2 AND 50 THEN 'values' ELSE '' END FROM orders
        UNION ALL SELECT 'pie', 'pie-priority-total', CASE WHEN COUNT(*) > 10 THEN 'more than 10 rows' ELSE '' END FROM orders)""",
    "line_metric_series": """WITH m AS (SELECT STRFTIME(l_shipdate, '%Y-%m') AS x, SUM(CAST(l_quantity AS DECIMAL(18,2))) AS l_quantity, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS l_extendedprice,
            SUM(CAST(l_discount AS DECIMAL(18,2))) AS l_discount, SUM(CAST(l_tax AS DECIMAL(18,2))) AS l_tax, CAST(COUNT(*) AS DECIMAL(38,2)) AS lines FROM lineitem GROUP BY 1)
        SELECT 'line' AS type, x, series, ROUND(CAST(y AS DOUBLE), 2) AS y FROM (UNPIVOT (SELECT x, CAST(l_quantity AS DECIMAL(38,2)) AS l_quantity, CAST(l_extendedprice AS DECIMAL(38,2)) AS l_extendedprice,
            CAST(l_discount AS DECIMAL(38,2)) AS l_discount, CAST(l_tax AS DECIMAL(38,2)) AS l_tax, lines FROM m) ON l_quantity, l_extendedprice, l_discount, l_tax, lines INTO NAME series VALUE y)""",
    "monthly_chart_series": f"""WITH m AS (SELECT CAST(CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS VARCHAR) AS x,
            ROUND(CAST(SUM({_Q}) AS DOUBLE), 2) AS y FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
        SELECT chart_id, type, confidence, x, 'total_net_amount' AS series, y FROM m,
        (VALUES ('line-month_start-total_net_amount', 'line', 0.9), ('area-month_start-total_net_amount', 'area', 0.74)) c(chart_id, type, confidence)""",
    "first_thousand_orders": """SELECT o_orderkey AS order_id, o_totalprice AS total, (SELECT COUNT(*) FROM orders) AS total_row_count,
        (SELECT COUNT(*) > 1000 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000""",
    "filtered_orders": """SELECT o_orderkey AS order_id, o_orderpriority AS priority FROM orders WHERE CONTAINS(LOWER(o_orderpriority), '5-lo')
        OR CONTAINS(LOWER(CAST(o_orderdate AS VARCHAR)), '5-lo')""",
    "natural_brand_order": """SELECT p_brand, 'brand#0' || LPAD(CAST(LENGTH(n) AS VARCHAR), 6, '0') || n AS natural_key
        FROM (SELECT DISTINCT p_brand, REGEXP_EXTRACT(p_brand, '[0-9]+') AS n FROM part)""",
    "event_cell_keys": f"""SELECT event_id, 'n:' || ({_FLOOR('value', 100)}) AS value_key, 'n:' || ({_FLOOR('value', 10)}) AS coarse_key,
        'n:' || (CAST(user_id AS DOUBLE) * 10) AS text_number_key, 's:' || event_type AS type_key FROM events""",
    "shipped_month_differences": """WITH a AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-02-01'
            AND l_shipdate < TIMESTAMP '1997-03-01' GROUP BY 1),
        b AS (SELECT l_partkey, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01'
            AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1),
        u AS (SELECT *, 'expected_only' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'actual_only' FROM (FROM b EXCEPT FROM a))
        SELECT 'n:' || CAST(l_partkey AS DOUBLE) AS l_partkey, 'n:' || CAST(n AS DOUBLE) AS n, side, 1 AS row_count FROM u""",
    "rowset_comparison": f"""WITH a AS (SELECT p_brand, ROUND(SUM({_NETSQL}), 2) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        b AS (SELECT p_brand, ROUND(CAST(SUM({_NETSQL}) AS DOUBLE), 2) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT CAST(COUNT(*) = 0 AS INT) AS rows_match, 0 AS missing_rows, 0 AS extra_rows FROM a FULL JOIN b
        ON a.p_brand = b.p_brand AND ABS(a.t - b.t) < 0.005 WHERE a.t IS NULL OR b.t IS NULL""",
    "strict_comparison": """SELECT CAST(COUNT(*) = 0 AS INT) AS rows_match FROM (
        (SELECT p_partkey, ROUND(p_retailprice, 3) FROM part EXCEPT ALL SELECT p_partkey, ROUND(p_retailprice + 0.0001, 3) FROM part))""",
    "aligned_columns": """WITH e(expected, v) AS (SELECT 'c_custkey', STRING_AGG(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey) FROM customer
        UNION ALL SELECT 'c_name', STRING_AGG(c_name, '|' ORDER BY c_name) FROM customer
        UNION ALL SELECT 'c_nationkey', STRING_AGG(CAST(c_nationkey AS VARCHAR), '|' ORDER BY c_nationkey) FROM customer
        UNION ALL SELECT 'c_acctbal', STRING_AGG(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_acctbal) FROM customer),
        a(actual, v) AS (SELECT 'balance', STRING_AGG(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_acctbal) FROM customer
        UNION ALL SELECT 'id', STRING_AGG(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey) FROM customer
        UNION ALL SELECT 'label', STRING_AGG(UPPER(c_name), '|' ORDER BY UPPER(c_name)) FROM customer
        UNION ALL SELECT 'nation', STRING_AGG(CAST(c_nationkey AS VARCHAR), '|' ORDER BY c_nationkey) FROM customer)
        SELECT expected, actual FROM e JOIN a USING (v)""",
    "ranking_check": """SELECT COUNT(*) AS violations FROM (SELECT o_totalprice AS v, LAG(o_totalprice) OVER (ORDER BY o_orderkey) AS p
        FROM orders WHERE o_totalprice IS NOT NULL) WHERE v > p + 1000.0""",
    "tolerance_check": """WITH a AS (SELECT p_brand, p_retailprice AS v, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS k FROM part),
        b AS (SELECT p_brand, v, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY v) AS k
              FROM (SELECT p_brand, p_retailprice + (p_size % 7 - 3) * 0.17 AS v FROM part))
        SELECT DISTINCT 's:' || p_brand AS brand_key FROM a JOIN b USING (p_brand, k) WHERE ABS(a.v - b.v) > 0.4 + 1e-9""",
    # sizes are whole numbers, so within 0.45 they are equal
    "joint_tolerance_check": """WITH a AS (SELECT p_brand, p_size, p_retailprice AS v, ROW_NUMBER() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice) AS k FROM part),
        b AS (SELECT p_brand, p_size, v, ROW_NUMBER() OVER (PARTITION BY p_brand, p_size ORDER BY v) AS k
              FROM (SELECT p_brand, p_size, p_retailprice + (p_size % 7 - 3) * 0.17 AS v FROM part))
        SELECT DISTINCT 's:' || p_brand AS brand_key FROM a JOIN b USING (p_brand, p_size, k) WHERE ABS(a.v - b.v) > 0.45 + 1e-9""",
    "full_result_comparison": f"""WITH o AS (SELECT o_orderpriority AS p, CAST(SUM({_Q}) AS DOUBLE) AS t, COUNT(*) AS n FROM orders GROUP BY 1),
        m AS (SELECT *, CASE WHEN p = '1-URGENT' THEN 0.9 ELSE 0.3 END AS step FROM o),
        r AS (SELECT t, ROW_NUMBER() OVER (ORDER BY t DESC) AS k FROM o),
        s AS (SELECT MAX(step) AS far, BOOL_AND(ROUND(t, 2) = ROUND(t + step, 2)) AS same, BOOL_AND(ROUND(t, 2) = 1) AS ones FROM m),
        w AS (SELECT t, LAG(t) OVER (ORDER BY k) AS before, LAG(t) OVER (ORDER BY k DESC) AS behind FROM r)
        SELECT 'renamed' AS "case", 1 AS matches
        UNION ALL SELECT 'one_value_lost', CAST(ones AS INT) FROM s UNION ALL SELECT 'within_tolerance', CAST(far <= 1.0 AS INT) FROM s
        UNION ALL SELECT 'beyond_tolerance', CAST(far <= 0.5 AS INT) FROM s UNION ALL SELECT 'moved_without_tolerance', CAST(same AS INT) FROM s
        UNION ALL SELECT 'columns_permuted', 1
        UNION ALL SELECT 'columns_crossed', CAST(COUNT(*) FILTER (o_orderkey % 4 = 1) = 0 AS INT) FROM orders
        UNION ALL SELECT 'scalar', CAST(SUM(n) = (SELECT COUNT(*) FROM orders) AS INT) FROM o UNION ALL SELECT 'scalar_off_by_one', CAST(COUNT(*) = COUNT(*) + 1 AS INT) FROM orders
        UNION ALL SELECT 'ranked', CAST(COUNT(*) FILTER (t > before) = 0 AS INT) FROM w UNION ALL SELECT 'ranking_turned', CAST(COUNT(*) FILTER (t > behind) = 0 AS INT) FROM w""",
    "large_number_comparison": """WITH c AS (SELECT COUNT(*) FILTER (event_id % 10 = 0 AND value <> 0) AS n FROM events)
        SELECT CAST(n = 0 AS INT) AS rows_match, n AS missing_rows, n AS extra_rows FROM c""",
    "lineitem_check_failures": """WITH m AS (SELECT COUNT(*) AS n, COUNT(DISTINCT l_returnflag) AS f FROM lineitem)
        SELECT 'min_row_count' AS code, '' AS "column", 5000000000 AS expected, n AS actual,
        'Expected at least 5000000000 rows but found ' || n || '.' AS message FROM m WHERE n < 5000000000
        UNION ALL SELECT 'min_distinct_counts', 'l_returnflag', 4, f,
        'Column l_returnflag had ' || f || ' distinct non-null value(s); expected at least 4.' FROM m WHERE f < 4""",
    "empty_result_check": """SELECT 'empty_result_set' AS code, COUNT(*) AS actual,
        'Signal checks could not be validated because the result set is empty.' AS message
        FROM lineitem WHERE l_quantity < 0 HAVING COUNT(*) = 0""",
    "verified_results": """SELECT 'count_by_type' AS case_id, COUNT(DISTINCT o_orderpriority) AS row_count, 0 AS failed_checks,
            CAST(COUNT(DISTINCT o_orderpriority) = 5 AS INT) AS passed FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'segments', COUNT(DISTINCT c_mktsegment), 0, CAST(COUNT(DISTINCT c_mktsegment) = 4 AS INT) FROM customer
        UNION ALL SELECT 'regions', COUNT(*), CAST(COUNT(*) < 6 AS INT) + CAST(COUNT(DISTINCT r_name) < 9 AS INT), 0 FROM region""",
}
