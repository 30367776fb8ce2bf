"""Audit of a SQL log derived from the orders: one statement per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import sqltext
from tallyframe.operators import sqlaudit
from tallyframe.plans.retail_layer import RETAIL_LAYER
from tallyframe.sources.retail_schema import references, schemas

REGISTRY = sqlaudit.Registry(
    columns={t: [f.name for f in s.fields] for t, s in schemas().items()},
    joins=[(r.table, r.column, r.to_table, r.to_column) for r in references(schemas())[0]],
    metrics={m.name: m.columns for m in RETAIL_LAYER.metrics if not m.counts},
)

_OK = ("SELECT c.CustomerName, SUM(d.NetAmount) AS total FROM SalesDocument d JOIN Customer c ON d.CustomerId = c.CustomerId "
       "WHERE d.SalesDocumentId = ", " GROUP BY c.CustomerName;")
_CTE = ("WITH feb AS (SELECT l.ProductId FROM SalesDocumentLine l), mar AS (SELECT ProductId FROM (SELECT * FROM Product) x, Brand b) "
        "SELECT COUNT(*) FROM feb f, mar, Product p WHERE p.ProductId IN (", ", 7) AND f.ProductId = 3")
_WRITE = ("DELETE FROM Customer WHERE note = '", "'")
_SLEEP = ("SELECT SLEEP(", ") FROM Customer")
_TWO = ("SELECT ", "; SELECT 2 FROM Brand")
_FENCED = ("```sql\nSELECT p.ProductName, p.Colour FROM Product p JOIN Customer c ON p.ProductId = c.CustomerId -- DELETE\n"
           "WHERE p.ProductName = 'DROP it ", "'\n```")
_NAMES = ("SELECT NetPayableAmount, UnknownThing FROM SalesDocument WHERE IsCanceled = 0 AND SalesDocumentId > ", "")

SPELLINGS = (
    ("JOIN Customer c ", "JOIN `Customer` AS c "), ("FROM Product p", "FROM  Product\tp"), ("FROM SalesDocument ", "from SalesDocument, Campaign "),
    ("SELECT ", "SELECT /* FROM Brand, 'x */ "), ("FROM Customer", "FROM Customer, (SELECT ')' AS s FROM Brand b, StoreLocation) y"),
)

_ALLOWED = ["SalesDocument", "SalesDocumentLine", "Customer", "Product", "Brand"]


def sql_log(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    around = lambda t: F.concat(F.lit(t[0]), key, F.lit(t[1]))
    sql = (
        F.when(priority == "1-URGENT", around(_OK)).when(priority == "2-HIGH", around(_CTE))
        .when((priority == "3-MEDIUM") & (status == "O"), around(_WRITE)).when((priority == "3-MEDIUM") & (status == "F"), around(_SLEEP))
        .when(priority == "3-MEDIUM", around(_TWO)).when(priority == "4-NOT SPECIFIED", around(_FENCED)).otherwise(around(_NAMES))
    )
    # the same statement in several spellings: quoted names, other aliases, small letters, comments, a third table in a list
    turn = F.col("o_orderkey") % 6
    for n, (old, new) in enumerate(SPELLINGS, 1):
        sql = F.when(turn == n, F.replace(sql, F.lit(old), F.lit(new))).otherwise(sql)
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    return o.select(
        F.col("o_orderkey").alias("query_id"), sql.alias("sql"),
        names(*_ALLOWED).alias("allowed_tables"),
        F.when(status == "O", names("SalesDocument", "Customer")).when(status == "F", names("Campaign")).alias("declared_tables"),
        F.when(status == "P", names("quantity_sold")).otherwise(names("net_sales", "line_net_sales")).alias("metrics"),
        F.array(F.col("o_custkey"), F.lit(3)).alias("candidates"),
        names("NetPayableAmount", "Product.ProductName", "Colour").alias("disallowed"),
    )


def _audited(spark, d):
    return sqlaudit.audit_by_template(sql_log(spark, d), REGISTRY, metrics="metrics", candidates="candidates", declared="declared_tables")


def stripped_sql(spark, d):
    return sql_log(spark, d).select("query_id", F.md5(sqltext.strip_for_scan(sqltext.clean_output(F.col("sql")))).alias("scan_md5"))


def sql_tables_used(spark, d):
    return sqlaudit.statements(sql_log(spark, d)).select("query_id", F.array_join(F.array_sort("tables_used"), "|").alias("tables_used"))


def read_only_verdicts(spark, d):
    return sqlaudit.statements(sql_log(spark, d)).select("query_id", F.coalesce("read_only_issue", F.lit("ok")).alias("verdict"))


def _listed(column):
    return lambda spark, d: _audited(spark, d).select("query_id", F.explode_outer(column).alias("issue")).filter("issue IS NOT NULL")


def table_contract_issues(spark, d):
    return _audited(spark, d).select("query_id", F.col("contract_issue").alias("issue")).filter("issue IS NOT NULL")


def disallowed_columns(spark, d):
    used = sqlaudit.disallowed_columns_used(F.col("sql"), F.col("disallowed"))
    return sql_log(spark, d).select("query_id", F.explode_outer(used).alias("column_name")).filter("column_name IS NOT NULL")


def first_issues(spark, d):
    return _audited(spark, d).select("query_id", F.coalesce("first_issue", F.lit("ok")).alias("first_issue"))


def error_headlines(spark, d):
    kind = sqlaudit.headline_class(F.col("first_issue")).alias("headline")
    return _audited(spark, d).groupBy(kind).agg(F.count("*").alias("queries"))


QUERIES = {
    **{f.__name__: f for f in (stripped_sql, sql_tables_used, read_only_verdicts, table_contract_issues, disallowed_columns,
                               first_issues, error_headlines)},
    "tables_outside_allowed": _listed("outside_tables"),
    "unknown_columns": _listed("column_issues"),
    "unknown_identifiers": _listed("identifier_issues"),
    "undeclared_joins": _listed("join_issues"),
    "unused_metric_columns": _listed("metric_issues"),
    "unresolved_product_ids": _listed("id_issues"),
}

_Q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || CHR(10) || '") + "'"
_AROUND = lambda t: f"{_Q(t[0])} || o_orderkey || {_Q(t[1])}"
_LOG = f"""spelt AS (SELECT o_orderkey AS query_id, o_orderpriority AS p, o_orderstatus AS st, o_custkey, CASE
    WHEN o_orderpriority = '1-URGENT' THEN {_AROUND(_OK)} WHEN o_orderpriority = '2-HIGH' THEN {_AROUND(_CTE)}
    WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN {_AROUND(_WRITE)}
    WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN {_AROUND(_SLEEP)}
    WHEN o_orderpriority = '3-MEDIUM' THEN {_AROUND(_TWO)} WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {_AROUND(_FENCED)}
    ELSE {_AROUND(_NAMES)} END AS plain FROM orders),
    log AS (SELECT *, CASE query_id % 6 {" ".join(f"WHEN {n} THEN REPLACE(plain, {_Q(a)}, {_Q(b)})" for n, (a, b) in enumerate(SPELLINGS, 1))} ELSE plain END AS sql FROM spelt)"""
def _stripped(*removals: tuple[str, str]) -> str:
    text = "sql"
    for pattern, other in (
        (r"^\s*```(json|sql)?\s*", "''"), (r"\s*```\s*$", "''"), (r"'([^'\\]|\\.)*'", "CHR(39) || CHR(39)"), (r'"([^"\\]|\\.)*"', "CHR(34) || CHR(34)"), *removals):
        text = f"REGEXP_REPLACE({text}, {_Q(pattern)}, {other}, 'g')"
    return text


_SCAN = _stripped((r"`([^`]|``)*`", "CHR(96) || CHR(96)"), (r"--[^\n]*", "' '"), (r"#[^\n]*", "' '"), (r"(?s)/\*.*?\*/", "' '"))
_BARE = _stripped((r"--[^\n]*", "''"), (r"(?s)/\*.*?\*/", "''"))
_CLEAN = f"REGEXP_REPLACE(REGEXP_REPLACE(sql, {_Q(r'^\s*```(json|sql)?\s*')}, ''), {_Q(r'\s*```\s*$')}, '')"
_INNER, _END = r"\([^()]*\)", r"(?i)\b(WHERE|GROUP|ORDER|HAVING|LIMIT|OFFSET|UNION|EXCEPT|INTERSECT|WINDOW|FOR|INTO|ON|USING|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|NATURAL|STRAIGHT_JOIN)\b"
# Tables from the text: names behind FROM and JOIN, and the heads of comma lists in the outer text and in each parenthesis, three deep.
_USED = f"""u0 AS (SELECT *, {_CLEAN} AS clean FROM log),
    u1 AS (SELECT *, REGEXP_EXTRACT_ALL(clean, '{_INNER}') AS p0, REGEXP_REPLACE(clean, '{_INNER}', ' ? ', 'g') AS r0 FROM u0),
    u2 AS (SELECT *, REGEXP_EXTRACT_ALL(r0, '{_INNER}') AS p1, REGEXP_REPLACE(r0, '{_INNER}', ' ? ', 'g') AS r1 FROM u1),
    u3 AS (SELECT *, REGEXP_EXTRACT_ALL(r1, '{_INNER}') AS p2, REGEXP_REPLACE(r1, '{_INNER}', ' ? ', 'g') AS r2 FROM u2),
    u4 AS (SELECT *, LIST_CONCAT([r2], LIST_CONCAT(p0, LIST_CONCAT(p1, p2))) AS parts FROM u3),
    u5 AS (SELECT *, FLATTEN(LIST_TRANSFORM(parts, LAMBDA x: LIST_TRANSFORM(STRING_SPLIT_REGEX(RTRIM(LTRIM(x, '('), ')'), '(?i)\\bFROM\\b')[2:], LAMBDA y: STRING_SPLIT_REGEX(y, '{_END}')[1]))) AS lists FROM u4),
    u AS (SELECT *, LIST_SORT(LIST_DISTINCT(LIST_FILTER(LIST_CONCAT(
        REGEXP_EXTRACT_ALL(clean, '(?i)\\b(?:FROM|STRAIGHT_JOIN|JOIN)\\s+`?([A-Za-z][A-Za-z0-9_]*)', 1),
        FLATTEN(LIST_TRANSFORM(lists, LAMBDA l: LIST_TRANSFORM(STRING_SPLIT(l, ','), LAMBDA h: REGEXP_EXTRACT(h, '^\\s*`?([A-Za-z][A-Za-z0-9_]*)', 1))))), LAMBDA n: n <> ''))) AS used FROM u5)"""
# The verdict from the text: the published deny patterns in their order, tried by another engine.
_VERDICT = "CASE " + " ".join(f"WHEN REGEXP_MATCHES(scan, {_Q('(?i)' + p)}) THEN {_Q(m)}" for p, m in sqltext.DENIED) + """
    WHEN NOT REGEXP_MATCHES(scan, '(?i)^\\s*(WITH|SELECT)\\b') THEN 'Only SELECT or WITH queries are allowed.'
    WHEN REGEXP_MATCHES(scan, ';\\s*[^;\\s]') THEN 'Only a single SQL statement is allowed.' ELSE 'ok' END"""
_SCANNED = f"v AS (SELECT *, {_SCAN} AS scan, {_BARE} AS bare FROM log)"
_OUT = f"LIST_SORT(LIST_FILTER(used, LAMBDA t: t NOT IN ({', '.join(_Q(t) for t in _ALLOWED)})))"
# A table in a comma list takes the alias, so the columns of `d` have no table.
_COLUMNS = """SELECT query_id, 'unknown column Colour on Product' AS issue FROM v WHERE CONTAINS(bare, 'p.Colour')
    UNION ALL SELECT query_id, 'unknown qualifier p.ProductId' FROM v WHERE CONTAINS(bare, ', Product p')
    UNION ALL SELECT query_id, 'unknown qualifier d.' || c FROM v, (VALUES ('NetAmount'), ('CustomerId'), ('SalesDocumentId')) x(c) WHERE CONTAINS(bare, ', Campaign d ')"""
_JOIN = "CONTAINS(bare, 'p.ProductId = c.CustomerId')"
_METRIC = "CASE st WHEN 'P' THEN CASE WHEN NOT REGEXP_MATCHES(bare, '\\bQuantity\\b') THEN 'quantity_sold' END ELSE CASE WHEN NOT REGEXP_MATCHES(bare, '\\bNetAmount\\b') THEN 'line_net_sales' END END"
_MISSED = "LIST_SORT(LIST_FILTER(used, LAMBDA x: x NOT IN ('SalesDocument', 'Customer')))"
_FIRST = f"""COALESCE(NULLIF({_VERDICT}, 'ok'), 'outside the allowed table set: ' || {_OUT}[1],
    CASE WHEN CONTAINS(bare, 'p.Colour') THEN 'unknown column Colour on Product' END,
    CASE WHEN CONTAINS(bare, ' UnknownThing ') THEN 'unknown identifier UnknownThing' END,
    CASE WHEN {_JOIN} THEN 'not an in-scope relationship: Product.ProductId->Customer.CustomerId' END,
    'preferred column for semantic metric missing: ' || {_METRIC},
    CASE WHEN st = 'F' THEN 'declared outside allowed: Campaign' WHEN st = 'O' AND LEN({_MISSED}) > 0 THEN 'omitted: ' || ARRAY_TO_STRING({_MISSED}, ', ') END, 'ok')"""
_AUDIT = f"{_LOG}, {_USED}, {_SCANNED}, f AS (SELECT query_id, {_FIRST} AS m FROM v JOIN (SELECT query_id, used FROM u) USING (query_id))"

ORACLES = {
    "stripped_sql": f"WITH {_LOG} SELECT query_id, MD5({_SCAN}) AS scan_md5 FROM log",
    "sql_tables_used": f"WITH {_LOG}, {_USED} SELECT query_id, ARRAY_TO_STRING(used, '|') AS tables_used FROM u",
    "read_only_verdicts": f"WITH {_LOG}, {_SCANNED} SELECT query_id, {_VERDICT} AS verdict FROM v",
    "tables_outside_allowed": f"WITH {_LOG}, {_USED} SELECT query_id, UNNEST({_OUT}) AS issue FROM u",
    "unknown_columns": f"WITH {_LOG}, {_SCANNED} {_COLUMNS}",
    "unknown_identifiers": f"WITH {_LOG}, {_SCANNED} SELECT query_id, 'UnknownThing' AS issue FROM v WHERE CONTAINS(bare, ' UnknownThing ')",
    "undeclared_joins": f"WITH {_LOG}, {_SCANNED} SELECT query_id, 'Product.ProductId->Customer.CustomerId' AS issue FROM v WHERE {_JOIN}",
    "unused_metric_columns": f"WITH {_LOG}, {_SCANNED} SELECT query_id, {_METRIC} AS issue FROM v WHERE {_METRIC} IS NOT NULL",
    "unresolved_product_ids": f"""WITH {_LOG} SELECT query_id, i AS issue FROM (SELECT query_id, o_custkey, UNNEST([query_id, 7, 3]) AS i FROM log WHERE p = '2-HIGH')
        WHERE i <> o_custkey AND i <> 3 GROUP BY ALL""",
    "table_contract_issues": f"""WITH {_LOG}, {_USED}, m AS (SELECT *, LIST_FILTER(used, LAMBDA x: x NOT IN ('SalesDocument', 'Customer')) AS miss FROM u)
        SELECT query_id, 'declared outside allowed: Campaign' AS issue FROM m WHERE st = 'F'
        UNION ALL SELECT query_id, 'omitted: ' || ARRAY_TO_STRING(LIST_SORT(miss), ', ') FROM m WHERE st = 'O' AND LEN(miss) > 0""",
    "disallowed_columns": f"""WITH {_LOG} SELECT query_id, c AS column_name FROM log, (VALUES ('NetPayableAmount'), ('Product.ProductName'), ('Colour')) v(c)
        WHERE REGEXP_MATCHES(sql, '(?i)\\b' || REPLACE(c, '.', '\\.') || '\\b')""",
    "first_issues": f"WITH {_AUDIT} SELECT query_id, m AS first_issue FROM f",
    "error_headlines": f"""WITH {_AUDIT}
        SELECT CASE WHEN m = 'ok' THEN 'no_message' WHEN m LIKE 'Use of%' THEN 'unsafe_query' WHEN m LIKE 'Only%' THEN 'unsafe_query' WHEN m LIKE 'declared%' OR m LIKE 'omitted%' THEN 'unanswered'
        ELSE 'invalid_query' END AS headline, COUNT(*) AS queries FROM f GROUP BY 1""",
}
