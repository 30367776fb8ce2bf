"""Gold analytics questions on the orders/lineitem tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.numbers import exact, rounded
from tallyframe.plans import star
from tallyframe.plans.retail import orders_as_retail

MARCH, FEBRUARY, JANUARY = star.month("1997-03"), star.month("1997-02"), star.month("1997-01")


def _by(name, **options):
    return lambda spark, d: star.metric(orders_as_retail(spark, d), name, **options)


def documents_without_lines(spark, d):
    model = orders_as_retail(spark, d)
    return star.without_related(model, model.tables["AccountingPosting"])


def active_customers(spark, d):
    customers = orders_as_retail(spark, d).tables["Customer"]
    return customers.filter(F.col("AccountBalance") > 0).agg(F.count("*").alias("active_customer_count"))


def posted_documents_count(spark, d):
    """Documents with a posting in the month, whatever the document's own date."""
    model = orders_as_retail(spark, d)
    posted = model.tables["AccountingPosting"].filter(star.in_period("PostingDate", MARCH)).select("SalesDocumentId")
    return (
        star.live_headers(model).select("SalesDocumentId").join(posted, "SalesDocumentId", "left_semi")
        .agg(F.count("*").alias("document_count"))
    )


def matching_products_sold(spark, d):
    return star.products_sold_matching(
        orders_as_retail(spark, d), MARCH, {"ProductName": ["RED", "bolt"], "CategoryName": ["econ"]}
    )


def customer_balance_by_segment(spark, d):
    """Account balances above zero by customer segment."""
    customers = orders_as_retail(spark, d).tables["Customer"].filter(F.col("AccountBalance") > 0)
    return (
        customers.groupBy("CustomerSegment")
        .agg(F.sum("AccountBalance").alias("raw"))
        .orderBy(F.col("raw").desc(), "CustomerSegment")
        .select("CustomerSegment", rounded(F.col("raw"), 2).alias("outstanding_balance"))
    )


def header_measures(spark, d):
    """Header totals side by side in one pass."""
    model = orders_as_retail(spark, d)
    h = star.live_headers(model)
    return h.agg(
        *[
            rounded(F.sum(F.coalesce(F.col(c), F.lit(0))), 2).alias(a)
            for c, a in (
                ("NetAmount", "total_net_amount"),
                ("BalanceAmount", "outstanding_balance"),
                ("PaidAmount", "total_paid"),
            )
        ]
    )


QUERIES = {
    "top_customers_net_sales": _by("net_sales", by="customer", period=MARCH, top=10),
    "top_products_quantity": _by("quantity_sold", by="product", period=MARCH, top=10),
    "document_count_by_type": _by("document_count", by="document_type", period=MARCH),
    "products_churned_count": lambda s, d: star.sold_not_in(orders_as_retail(s, d), FEBRUARY, MARCH),
    "ledger_top_debit": _by("debit_amount", by="ledger_account", period=MARCH, top=10),
    "documents_without_lines": documents_without_lines,
    "active_customers": active_customers,
    "top_products_net_sales": _by("line_net_sales", by="product", period=MARCH, top=10),
    "ledger_top_credit": _by("credit_amount", by="ledger_account", period=MARCH, top=10),
    "brand_net_sales": _by("net_sales", by="brand", period=MARCH, top=10),
    "region_net_sales_scalar": _by("net_sales", where={"campaign": ["europ"]}, period=MARCH),
    "matching_products_sold": matching_products_sold,
    "posted_documents_count": posted_documents_count,
    "top_customers_gross": _by("bill_total", by="customer", period=MARCH, top=10),
    "category_net_sales": _by("net_sales", by="product_category", period=MARCH),
    "category_quantity": _by("quantity_sold", by="product_category", period=MARCH, top=10),
    "customer_two_month_columns": _by(
        "net_sales", by="customer", order_by_name=True,
        periods_as_columns={"jan_net_amount": JANUARY, "feb_net_amount": FEBRUARY},
    ),
    "outstanding_by_customer": _by("outstanding", by="customer", row_filter="BalanceAmount > 0"),
    "ledger_debit_credit": _by("debit_credit", by="ledger_account_or_none", live_only=False),
    "document_count_by_type_all": _by("document_count", by="document_type"),
    "monthly_sales_trend": lambda s, d: star.monthly_trend(orders_as_retail(s, d), "net_sales", terms=["widget", "small"]),
    "monthly_document_sales_trend": lambda s, d: star.monthly_trend(orders_as_retail(s, d), "net_sales"),
    "due_in_range_balance": _by("outstanding", by="customer", period=MARCH, dated_by="DueDate",
                                row_filter="BalanceAmount > 0"),
    "customer_balance_by_segment": customer_balance_by_segment,
    "location_net_sales": _by("net_sales", by="store_location", period=MARCH),
    "region_net_sales": _by("net_sales", by="campaign", period=MARCH),
    "header_measures": header_measures,
}

_M = "o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01'"
_F = "o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'"
_J = "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'"
_LIVE = "o_orderstatus <> 'P'"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"
_GROSS = "CAST(l_extendedprice AS DECIMAL(18,2))"
_NET = f"({_GROSS} * (1 - CAST(l_discount AS DECIMAL(4,2))))"
_QTY = "CAST(l_quantity AS DECIMAL(18,2))"
_BILL = f"({_TOTAL} + (o_custkey % 7) * 1000)"
_DUE = "o_orderdate + TO_DAYS(CAST(o_orderkey % 45 AS INTEGER)) >= TIMESTAMP '1997-03-01' AND o_orderdate + TO_DAYS(CAST(o_orderkey % 45 AS INTEGER)) < TIMESTAMP '1997-04-01'"
_OPEN = f"CASE WHEN o_orderstatus = 'O' THEN {_TOTAL} ELSE 0 END"
_DEBIT = f"CASE WHEN l_linestatus = 'O' THEN {_GROSS} ELSE 0 END"
_CREDIT = f"CASE WHEN l_linestatus = 'F' THEN {_GROSS} ELSE 0 END"
_LINES = f"lineitem JOIN orders ON l_orderkey = o_orderkey AND {_LIVE}"


def _r(expression: str, decimals: int = 2) -> str:
    return f"CAST(ROUND(SUM({expression}), {decimals}) AS DOUBLE)"


ORACLES = {
    "top_customers_net_sales": f"""SELECT c_name AS "CustomerName", {_r(_TOTAL)} AS total_net_amount
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_LIVE} AND {_M}
        GROUP BY c_custkey, c_name ORDER BY SUM({_TOTAL}) DESC, c_name LIMIT 10""",
    "top_products_quantity": f"""SELECT p_name AS "ProductName", {_r(_QTY, 3)} AS total_qty
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE {_M}
        GROUP BY p_partkey, p_name ORDER BY SUM({_QTY}) DESC, p_name LIMIT 10""",
    "document_count_by_type": f"""SELECT o_orderpriority AS "DocumentTypeName", COUNT(*) AS document_count
        FROM orders WHERE {_LIVE} AND {_M} GROUP BY 1""",
    "products_churned_count": f"""WITH feb AS (SELECT DISTINCT l_partkey FROM {_LINES} WHERE {_F}),
        mar AS (SELECT DISTINCT l_partkey FROM {_LINES} WHERE {_M})
        SELECT COUNT(*) AS product_count FROM feb LEFT JOIN mar USING (l_partkey) WHERE mar.l_partkey IS NULL""",
    "ledger_top_debit": f"""SELECT CAST(s_suppkey AS VARCHAR) AS "AccountCode", s_name AS "AccountName", {_r(_DEBIT)} AS total_debit
        FROM {_LINES} JOIN supplier ON l_suppkey = s_suppkey WHERE {_M}
        GROUP BY s_suppkey, s_name ORDER BY SUM({_DEBIT}) DESC, 1 LIMIT 10""",
    "documents_without_lines": f"""SELECT COUNT(*) AS document_count FROM orders
        LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE {_LIVE} AND l_orderkey IS NULL""",
    "active_customers": "SELECT COUNT(*) AS active_customer_count FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 0",
    "top_products_net_sales": f"""SELECT p_name AS "ProductName", {_r(_NET)} AS total_net_amount
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE {_M}
        GROUP BY p_partkey, p_name ORDER BY SUM({_NET}) DESC, p_name LIMIT 10""",
    "ledger_top_credit": f"""SELECT CAST(s_suppkey AS VARCHAR) AS "AccountCode", s_name AS "AccountName", {_r(_CREDIT)} AS total_credit
        FROM {_LINES} JOIN supplier ON l_suppkey = s_suppkey WHERE {_M}
        GROUP BY s_suppkey, s_name ORDER BY SUM({_CREDIT}) DESC, 1 LIMIT 10""",
    "brand_net_sales": f"""SELECT p_brand AS "BrandName", {_r(_NET)} AS total_net_amount
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE {_M}
        GROUP BY p_brand ORDER BY SUM({_NET}) DESC, p_brand LIMIT 10""",
    "region_net_sales_scalar": f"""SELECT {_r(_NET)} AS total_net_amount FROM {_LINES}
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE {_M} AND r_name ILIKE '%europ%'""",
    "matching_products_sold": f"""SELECT DISTINCT p_name AS "ProductName" FROM {_LINES}
        JOIN part ON l_partkey = p_partkey WHERE {_M}
        AND (p_name ILIKE '%red%' OR p_name ILIKE '%bolt%' OR p_type ILIKE '%econ%')""",
    "posted_documents_count": f"""SELECT COUNT(*) AS document_count FROM orders WHERE {_LIVE} AND EXISTS (
        SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
        AND l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-04-01')""",
    "category_net_sales": f"""SELECT p_type AS "CategoryName", {_r(_NET)} AS total_net_amount
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE {_M} GROUP BY p_type""",
    "category_quantity": f"""SELECT p_type AS "CategoryName", {_r(_QTY, 3)} AS total_qty
        FROM {_LINES} JOIN part ON l_partkey = p_partkey WHERE {_M}
        GROUP BY p_type ORDER BY SUM({_QTY}) DESC, p_type LIMIT 10""",
    "customer_two_month_columns": f"""SELECT c_name AS "CustomerName",
        {_r(f"CASE WHEN {_J} THEN {_TOTAL} ELSE 0 END")} AS jan_net_amount,
        {_r(f"CASE WHEN {_F} THEN {_TOTAL} ELSE 0 END")} AS feb_net_amount
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_LIVE} AND (({_J}) OR ({_F}))
        GROUP BY c_custkey, c_name""",
    "outstanding_by_customer": f"""SELECT c_name AS "CustomerName", {_r(_OPEN)} AS outstanding_balance
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_LIVE} AND {_OPEN} > 0 GROUP BY c_custkey, c_name""",
    "ledger_debit_credit": f"""SELECT CAST(s_suppkey AS VARCHAR) AS "AccountCode", s_name AS "AccountName",
        {_r(_DEBIT)} AS total_debit, {_r(_CREDIT)} AS total_credit
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name""",
    "document_count_by_type_all": f"""SELECT o_orderpriority AS "DocumentTypeName", COUNT(*) AS document_count
        FROM orders WHERE {_LIVE} GROUP BY 1""",
    "monthly_sales_trend": f"""SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start, {_r(_NET)} AS total_net_amount
        FROM {_LINES} JOIN part ON l_partkey = p_partkey
        WHERE p_name ILIKE '%widget%' OR p_name ILIKE '%small%' OR p_type ILIKE '%widget%' OR p_type ILIKE '%small%'
        GROUP BY 1""",
    "monthly_document_sales_trend": f"""SELECT CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS month_start,
        {_r(_TOTAL)} AS total_net_amount FROM orders WHERE {_LIVE} GROUP BY 1""",
    "due_in_range_balance": f"""SELECT c_name AS "CustomerName", {_r(_OPEN)} AS outstanding_balance
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_LIVE} AND {_DUE} AND {_OPEN} > 0 GROUP BY c_custkey, c_name""",
    "customer_balance_by_segment": f"""SELECT c_mktsegment AS "CustomerSegment",
        {_r("CAST(c_acctbal AS DECIMAL(18,2))")} AS outstanding_balance
        FROM customer WHERE CAST(c_acctbal AS DECIMAL(18,2)) > 0 GROUP BY 1""",
    "location_net_sales": f"""SELECT n_name AS "LocationName", {_r(_TOTAL)} AS total_net_amount
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE {_LIVE} AND {_M} GROUP BY n_nationkey, n_name""",
    "region_net_sales": f"""SELECT r_name AS "CampaignName", {_r(_NET)} AS total_net_amount FROM {_LINES}
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE {_M} GROUP BY r_regionkey, r_name""",
    "header_measures": f"""SELECT {_r(_TOTAL)} AS total_net_amount, {_r(_OPEN)} AS outstanding_balance,
        {_r(f"CASE WHEN o_orderstatus = 'F' THEN {_TOTAL} ELSE 0 END")} AS total_paid FROM orders WHERE {_LIVE}""",
    "top_customers_gross": f"""SELECT c_name AS "CustomerName", {_r(_BILL)} AS total_bill
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_LIVE} AND {_M}
        GROUP BY c_custkey, c_name ORDER BY SUM({_BILL}) DESC, c_name LIMIT 10""",
}
