"""Relational and scalar building blocks that questions may use, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import exact, rounded


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def filter_predicates(spark, d):
    """=, <, >=, AND/OR/NOT, BETWEEN, IN, IS NULL and case-insensitive LIKE in one filter."""
    p = _t(spark, d, "part")
    kept = p.filter(
        F.col("p_size").between(5, 40)
        & (F.col("p_type").isin("ECONOMY", "SMALL", "LARGE") | F.col("p_name").ilike("%RING"))
        & ~(F.col("p_brand") == "Brand#2")
        & F.col("p_retailprice").isNotNull()
        & (F.col("p_retailprice") >= 905)
        & (F.col("p_partkey") < 1_000_000_000)
    )
    return kept.select("p_partkey", F.col("p_name").alias("product_name"), "p_brand")


def right_join_counts(spark, d):
    """Suppliers kept even where no line of the month refers to them."""
    lines = _t(spark, d, "lineitem").filter(
        (F.col("l_shipdate") >= F.lit("1997-03-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1997-03-08").cast("timestamp_ntz"))
    )
    per = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = _t(spark, d, "supplier").select("s_suppkey", "s_name")
    return per.join(s, per.l_suppkey == s.s_suppkey, "right").select(
        "s_name", F.coalesce("n", F.lit(0)).alias("line_count")
    )


def full_join_customer_supplier_nations(spark, d):
    """Nations with customers, with suppliers, or with either."""
    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, ["nationkey"], "full").select(
        F.col("nationkey").cast("bigint").alias("nationkey"),
        F.coalesce("customers", F.lit(0)).alias("customers"),
        F.coalesce("suppliers", F.lit(0)).alias("suppliers"),
    )


def customers_with_open_orders(spark, d):
    """EXISTS as a semi-join."""
    open_orders = _t(spark, d, "orders").filter(F.col("o_orderstatus") == "O").select("o_custkey")
    c = _t(spark, d, "customer")
    return c.join(open_orders, c.c_custkey == open_orders.o_custkey, "left_semi").select("c_custkey", "c_name")


def customers_without_orders(spark, d):
    """NOT EXISTS as an anti-join."""
    o = _t(spark, d, "orders").select("o_custkey")
    c = _t(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def derived_table_average(spark, d):
    """Average of per-customer totals (a derived table under an aggregate)."""
    per = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sum(exact("o_totalprice")).alias("spent"))
    return per.agg(F.count("*").alias("buyers"), rounded(F.max("spent"), 2).alias("largest"),
                   rounded(F.min("spent"), 2).alias("smallest"))


def orders_per_year_recursive(spark, d):
    """Every calendar year between the first and last order, empty years included."""
    _t(spark, d, "orders").createOrReplaceTempView("tallyframe_orders")
    return spark.sql(
        """WITH RECURSIVE span AS (
               SELECT CAST(YEAR(MIN(o_orderdate)) AS BIGINT) AS lo, CAST(YEAR(MAX(o_orderdate)) AS BIGINT) AS hi
               FROM tallyframe_orders),
             years(y, hi) AS (
               SELECT lo, hi FROM span UNION ALL SELECT y + 1, hi FROM years WHERE y < hi),
             counts AS (
               SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS oy, COUNT(*) AS n FROM tallyframe_orders GROUP BY 1)
           SELECT y AS order_year, COALESCE(n, 0) AS order_count FROM years LEFT JOIN counts ON y = oy"""
    )


def orders_above_average(spark, d):
    """Count of orders above the average order (scalar subquery)."""
    _t(spark, d, "orders").createOrReplaceTempView("tallyframe_orders")
    return spark.sql(
        """SELECT COUNT(*) AS order_count FROM tallyframe_orders
           WHERE CAST(o_totalprice AS DECIMAL(18,2)) >
                 (SELECT AVG(CAST(o_totalprice AS DECIMAL(18,2))) FROM tallyframe_orders)"""
    )


def distinct_brand_types(spark, d):
    return _t(spark, d, "part").select("p_brand", "p_type").distinct()


def customers_having_many_orders(spark, d):
    return (
        _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("order_count"))
        .filter(F.col("order_count") >= 12)
    )


def second_page_of_orders(spark, d):
    """LIMIT with OFFSET over a total order."""
    o = _t(spark, d, "orders")
    return (
        o.orderBy(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc())
        .offset(20).limit(20).select("o_orderkey", "o_totalprice")
    )


def union_of_parties(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("party"))
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("party"))
    return c.unionByName(s).groupBy("party").agg(F.count("*").alias("n"), F.count_distinct("nationkey").alias("nations"))


def union_distinct_keys(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return o.union(l).distinct().agg(F.count("*").alias("keys"))


def except_months(spark, d):
    """Customers who ordered in February 1997 EXCEPT those of March."""
    return _month_customers(spark, d, "1997-02-01", "1997-03-01").subtract(
        _month_customers(spark, d, "1997-03-01", "1997-04-01"))


def intersect_months(spark, d):
    return _month_customers(spark, d, "1997-02-01", "1997-03-01").intersect(
        _month_customers(spark, d, "1997-03-01", "1997-04-01"))


def _month_customers(spark, d, low, high):
    date = F.col("o_orderdate")
    return _t(spark, d, "orders").filter(
        (date >= F.lit(low).cast("timestamp_ntz")) & (date < F.lit(high).cast("timestamp_ntz"))
    ).select("o_custkey")


def aggregate_vocabulary(spark, d):
    """COUNT(*), COUNT(x), SUM, AVG, MIN, MAX and COUNT DISTINCT by flag and status."""
    q = exact("l_quantity")
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("row_count"),
        F.count("l_shipdate").alias("shipped"),
        rounded(F.sum(q), 2).alias("sum_qty"),
        F.round((F.sum(q) / F.count(q)).cast("double"), 4).alias("avg_qty"),
        F.min(q).cast("double").alias("min_qty"),
        F.max(q).cast("double").alias("max_qty"),
        F.count_distinct("l_suppkey").alias("suppliers"),
    )


def status_columns_by_priority(spark, d):
    """Conditional aggregation: one column per status."""
    status, total = F.col("o_orderstatus"), exact("o_totalprice")
    return _t(spark, d, "orders").groupBy("o_orderpriority").agg(
        *[rounded(F.sum(F.when(status == s, total).otherwise(0)), 2).alias(f"total_{s.lower()}") for s in "OFP"]
    )


def natural_join_nation_region(spark, d):
    """Join on equally named columns (USING / NATURAL)."""
    n = _t(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("regionkey"))
    r = _t(spark, d, "region").select("r_name", F.col("r_regionkey").alias("regionkey"))
    return n.join(r, ["regionkey"]).select("n_name", "r_name")


def order_number_functions(spark, d):
    """ABS, ROUND, COALESCE, NULLIF, IF, CASE and CAST per order."""
    total = exact("o_totalprice")
    return _t(spark, d, "orders").select(
        "o_orderkey",
        F.abs(total - 250000).cast("double").alias("distance"),
        F.round(total, -2).cast("double").alias("hundreds"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("status"),
        F.when(total > 300000, "large").when(total > 100000, "middle").otherwise("small").alias("size"),
        F.ifnull(F.substring("o_orderpriority", 1, 1).cast("bigint"), F.lit(0)).alias("rank"),
    )


def customer_text_functions(spark, d):
    """CONCAT, LOWER, UPPER and LIKE with an escape character."""
    c = _t(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.concat(F.lower("c_mktsegment"), F.lit("/"), F.upper("c_name")).alias("label"),
        F.col("c_name").ilike(r"customer#%\_%").alias("has_underscore"),
        F.expr(r"c_name ILIKE 'customer#%7' ESCAPE '!'").alias("ends_in_seven"),
    )


def order_date_functions(spark, d):
    """DATE, DATE_ADD, DATE_SUB, INTERVAL, DATE_FORMAT, DAY, MONTH, YEAR and CURRENT_DATE."""
    day = F.to_date("o_orderdate")
    return (
        _t(spark, d, "orders").filter(day < F.current_date())
        .select(
            "o_orderkey",
            F.date_format("o_orderdate", "yyyy-MM").alias("year_month"),
            F.dayofmonth(day).cast("bigint").alias("day"),
            F.month(day).cast("bigint").alias("month"),
            F.year(day).cast("bigint").alias("year"),
            F.date_format(F.date_add(day, 45), "yyyy-MM-dd").alias("due"),
            F.date_format(F.date_sub(day, 7), "yyyy-MM-dd").alias("week_before"),
            F.date_format(F.add_months(day, 1), "yyyy-MM-dd").alias("month_after"),
        )
    )


def aging_buckets(spark, d):
    """Open orders by days overdue at a given day, in 30-day steps."""
    age = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate"))
    bucket = (
        F.when(age < 0, "not due").when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90")
        .otherwise("over 90")
    )
    return (
        _t(spark, d, "orders").filter(F.col("o_orderstatus") == "O")
        .groupBy(bucket.alias("bucket"))
        .agg(F.count("*").alias("document_count"), rounded(F.sum(exact("o_totalprice")), 2).alias("balance"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        filter_predicates, right_join_counts, full_join_customer_supplier_nations, customers_with_open_orders,
        customers_without_orders, derived_table_average, orders_per_year_recursive, orders_above_average,
        distinct_brand_types, customers_having_many_orders, second_page_of_orders, union_of_parties,
        union_distinct_keys, except_months, intersect_months, aggregate_vocabulary, status_columns_by_priority,
        natural_join_nation_region, order_number_functions, customer_text_functions, order_date_functions,
        aging_buckets,
    )
}

_FEB = "o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'"
_MAR = "o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'"
_TOT = "CAST(o_totalprice AS DECIMAL(18,2))"
_Q = "CAST(l_quantity AS DECIMAL(18,2))"

ORACLES = {
    "filter_predicates": """SELECT p_partkey, p_name AS product_name, p_brand FROM part
        WHERE p_size BETWEEN 5 AND 40 AND (p_type IN ('ECONOMY','SMALL','LARGE') OR p_name ILIKE '%ring')
        AND NOT p_brand = 'Brand#2' AND p_retailprice IS NOT NULL AND p_retailprice >= 905 AND p_partkey < 1000000000""",
    "right_join_counts": """SELECT s_name, COUNT(l_suppkey) AS line_count FROM lineitem RIGHT JOIN supplier
        ON l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-03-08'
        GROUP BY s_suppkey, s_name""",
    "full_join_customer_supplier_nations": """SELECT CAST(COALESCE(c.k, s.k) AS BIGINT) AS nationkey,
        COALESCE(c.n, 0) AS customers, COALESCE(s.n, 0) AS suppliers
        FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1) c
        FULL JOIN (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""",
    "customers_with_open_orders": """SELECT c_custkey, c_name FROM customer WHERE EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""",
    "customers_without_orders": """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
        (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "derived_table_average": f"""SELECT COUNT(*) AS buyers, CAST(MAX(s) AS DOUBLE) AS largest, CAST(MIN(s) AS DOUBLE) AS smallest
        FROM (SELECT SUM({_TOT}) AS s FROM orders GROUP BY o_custkey)""",
    "orders_per_year_recursive": """WITH RECURSIVE years(y, hi) AS (
        SELECT MIN(YEAR(o_orderdate)), MAX(YEAR(o_orderdate)) FROM orders
        UNION ALL SELECT y + 1, hi FROM years WHERE y < hi)
        SELECT y AS order_year, COUNT(o_orderkey) AS order_count FROM years LEFT JOIN orders ON YEAR(o_orderdate) = y GROUP BY y""",
    "orders_above_average": f"""SELECT COUNT(*) AS order_count FROM orders
        WHERE {_TOT} > (SELECT SUM({_TOT}) / COUNT(*) FROM orders)""",
    "distinct_brand_types": "SELECT DISTINCT p_brand, p_type FROM part",
    "customers_having_many_orders": """SELECT o_custkey, COUNT(*) AS order_count FROM orders GROUP BY 1 HAVING COUNT(*) >= 12""",
    "second_page_of_orders": """SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 20""",
    "union_of_parties": """SELECT party, COUNT(*) AS n, COUNT(DISTINCT k) AS nations FROM (
        SELECT c_nationkey AS k, 'customer' AS party FROM customer
        UNION ALL SELECT s_nationkey, 'supplier' FROM supplier) GROUP BY party""",
    "union_distinct_keys": """SELECT COUNT(*) AS keys FROM (SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem)""",
    "except_months": f"SELECT o_custkey FROM orders WHERE {_FEB} EXCEPT SELECT o_custkey FROM orders WHERE {_MAR}",
    "intersect_months": f"SELECT o_custkey FROM orders WHERE {_FEB} INTERSECT SELECT o_custkey FROM orders WHERE {_MAR}",
    "aggregate_vocabulary": f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count, COUNT(l_shipdate) AS shipped,
        CAST(ROUND(SUM({_Q}), 2) AS DOUBLE) AS sum_qty,
        ROUND(CAST(SUM({_Q}) AS DOUBLE) / COUNT({_Q}), 4) AS avg_qty,
        CAST(MIN({_Q}) AS DOUBLE) AS min_qty, CAST(MAX({_Q}) AS DOUBLE) AS max_qty,
        COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2""",
    "status_columns_by_priority": "SELECT o_orderpriority, " + ", ".join(
        f"CAST(SUM(CASE WHEN o_orderstatus = '{s}' THEN {_TOT} ELSE 0 END) AS DOUBLE) AS total_{s.lower()}" for s in "OFP"
    ) + " FROM orders GROUP BY 1",
    "natural_join_nation_region": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "order_number_functions": f"""SELECT o_orderkey, CAST(ABS({_TOT} - 250000) AS DOUBLE) AS distance,
        CAST(ROUND({_TOT}, -2) AS DOUBLE) AS hundreds,
        COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS status,
        CASE WHEN {_TOT} > 300000 THEN 'large' WHEN {_TOT} > 100000 THEN 'middle' ELSE 'small' END AS size,
        IFNULL(CAST(SUBSTR(o_orderpriority, 1, 1) AS BIGINT), 0) AS rank FROM orders""",
    "customer_text_functions": """SELECT c_custkey, CONCAT(LOWER(c_mktsegment), '/', UPPER(c_name)) AS label,
        c_name ILIKE 'customer#%!_%' ESCAPE '!' AS has_underscore, c_name ILIKE 'customer#%7' AS ends_in_seven FROM customer""",
    "order_date_functions": """SELECT o_orderkey, STRFTIME(o_orderdate, '%Y-%m') AS year_month, DAY(o_orderdate) AS day,
        MONTH(o_orderdate) AS month, YEAR(o_orderdate) AS year,
        STRFTIME(CAST(o_orderdate AS DATE) + INTERVAL 45 DAY, '%Y-%m-%d') AS due,
        STRFTIME(CAST(o_orderdate AS DATE) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before,
        STRFTIME(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_after
        FROM orders WHERE CAST(o_orderdate AS DATE) < CURRENT_DATE""",
    "aging_buckets": f"""WITH a AS (SELECT DATE_DIFF('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') AS age, {_TOT} AS t
        FROM orders WHERE o_orderstatus = 'O')
        SELECT CASE WHEN age < 0 THEN 'not due' WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60'
        WHEN age <= 90 THEN '61-90' ELSE 'over 90' END AS bucket,
        COUNT(*) AS document_count, CAST(SUM(t) AS DOUBLE) AS balance FROM a GROUP BY 1""",
}
