import pytest
from pyspark.sql import functions as F

from tallyframe.catalog.sqllog import REGISTRY
from tallyframe.functions import sqltext as S
from tallyframe.operators import sqlaudit as A


def one(spark, expression, sql):
    return spark.createDataFrame([(sql,)], "sql string").select(expression.alias("x")).first()["x"]


def verdict(spark, sql):
    return one(spark, S.read_only_issue(S.clean_output(F.col("sql"))), sql)


@pytest.mark.parametrize("sql", [
    "SELECT 1", "with a as (select 1) select * from a;", "```sql\nSELECT 1\n```", "SELECT * FROM t WHERE note = 'DELETE later; DROP'",
    "SELECT 1 -- DROP TABLE x", "SELECT update_time, \"DELETE\" FROM t", "SELECT `drop` FROM t", "SELECT a FROM t UNION SELECT b FROM u"])
def test_accepted(spark, sql):
    assert verdict(spark, sql) is None


@pytest.mark.parametrize("sql, part", [
    ("", "did not return"), ("DELETE FROM t", "read-only"), ("SELECT 1; DROP TABLE t", "read-only"), ("SELECT 1; SELECT 2", "single"),
    ("SELECT /*!50000 1 */", "Executable"), ("SELECT * INTO OUTFILE 'x' FROM t", "files"), ("SELECT * FROM t FOR UPDATE", "Only read-only"),
    ("SELECT * FROM t LOCK IN SHARE MODE", "SHARE MODE"), ("SELECT @@version", "variables"), ("SELECT * FROM information_schema.tables", "metadata"),
    ("SELECT sleep (5)", "restricted"), ("SELECT user()", "session information"), ("SHOW TABLES", "SELECT or WITH")])
def test_rejected(spark, sql, part):
    assert part in verdict(spark, sql)


def test_long_literal_does_not_break_the_matcher(spark):
    assert verdict(spark, "SELECT '" + "a" * 200_000 + "' FROM t") is None


@pytest.mark.parametrize("sql, tables", [
    ("SELECT a, b FROM x, y z, `w` WHERE c IN (1, 2)", {"x", "y", "w"}),
    ("SELECT * FROM a STRAIGHT_JOIN b JOIN c ON a.i = c.i", {"a", "b", "c"}),
    ("SELECT * FROM (SELECT i FROM a, b) d, c", {"a", "b", "c"}),
    ("SELECT (SELECT MAX(q) FROM deep, er) FROM top ORDER BY 1, 2", {"deep", "er", "top"}),
    ("SELECT 1", set())])
def test_tables(spark, sql, tables):
    assert set(one(spark, S.referenced_tables(F.col("sql")), sql)) == tables


def issues(spark, sql, **columns):
    df = spark.createDataFrame([(sql, REGISTRY.tables)], "sql string, allowed_tables array<string>").withColumns(columns)
    return A.audit(df, REGISTRY, **{k: k for k in columns}).first()


def test_good_query_has_no_issue(spark):
    sql = ("SELECT c.CustomerName, ROUND(SUM(COALESCE(d.NetAmount, 0)), 2) AS TotalNet FROM SalesDocument d JOIN Customer AS c "
           "ON d.CustomerId = c.CustomerId WHERE IFNULL(d.IsCanceled, 0) = 0 GROUP BY c.CustomerId, c.CustomerName ORDER BY TotalNet DESC")
    assert issues(spark, sql)["first_issue"] is None


@pytest.mark.parametrize("sql, part", [
    ("SELECT c.Colour FROM Customer c", "unknown column Colour on Customer"), ("SELECT z.CustomerName FROM Customer c", "unknown qualifier z.CustomerName"),
    ("SELECT MadeUp FROM Customer", "unknown identifier MadeUp"), ("SELECT 1 FROM nowhere", "outside the allowed table set: nowhere"),
    ("SELECT 1 FROM Product p JOIN Customer c ON p.ProductId = c.CustomerId", "not an in-scope relationship: Product.ProductId->Customer.CustomerId")])
def test_issue(spark, sql, part):
    assert issues(spark, sql)["first_issue"] == part


def test_either_direction_of_a_relationship_is_fine(spark):
    assert issues(spark, "SELECT 1 FROM Customer c JOIN SalesDocument d ON c.CustomerId = d.CustomerId")["first_issue"] is None


def test_cte_names_count_as_tables_unless_exempt(spark):
    sql = "WITH feb AS (SELECT ProductId FROM SalesDocumentLine) SELECT COUNT(*) AS n FROM feb"
    df = spark.createDataFrame([(sql, REGISTRY.tables)], "sql string, allowed_tables array<string>")
    assert A.audit(df, REGISTRY).first()["first_issue"] == "outside the allowed table set: feb"
    assert A.audit(df, REGISTRY, exempt_ctes=True).first()["first_issue"] is None


def test_metric_needs_a_preferred_column(spark):
    names = F.array(F.lit("net_sales"))
    assert "net_sales" in issues(spark, "SELECT SUM(GrossAmount) FROM SalesDocument", metrics=names)["first_issue"]
    assert issues(spark, "SELECT SUM(netamount) FROM SalesDocument", metrics=names)["first_issue"] is None
    both = F.array(F.lit("net_sales"), F.lit("line_net_sales"))
    assert issues(spark, "SELECT SUM(NetAmount) FROM SalesDocumentLine", metrics=both)["metric_issues"] == []


def test_product_ids_must_be_candidates(spark):
    known = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    sql = "SELECT 1 FROM Product p WHERE p.`ProductId` IN (1, 5) OR ProductId = 2"
    assert issues(spark, sql, candidates=known)["id_issues"] == [5]
    assert issues(spark, sql, candidates=F.expr("cast(array() as array<bigint>)"))["id_issues"] == []


def test_declared_tables(spark):
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    sql = "SELECT 1 FROM Product, Brand"
    assert issues(spark, sql, declared=names("Product"))["contract_issue"] == "omitted: Brand"
    assert issues(spark, sql, declared=names("Product", "Brand", "Other"))["contract_issue"] == "declared outside allowed: Other"
    assert issues(spark, sql, declared=names("Brand", "Product"))["contract_issue"] is None


def test_disallowed_columns_match_whole_words(spark):
    used = A.disallowed_columns_used(F.col("sql"), F.array(F.lit("NetAmount"), F.lit("a.b"), F.lit("x+y")))
    assert one(spark, used, "select netamount, NetAmountX, aXb from t") == ["NetAmount"]


@pytest.mark.parametrize("message, kind", [
    ("", "no_message"), ("ECONNREFUSED 1", "service_unreachable"), ("Too many requests", "rate_limited"), ("Forbidden", "unauthorized"),
    ("Only read-only SQL is allowed.", "unsafe_query"), ('SQL references table "x" which is outside the allowed table set.', "invalid_query"), ("boom", "unanswered")])
def test_headlines(spark, message, kind):
    assert one(spark, A.headline_class(F.col("sql")), message) == kind


def test_templates_give_what_statements_give(spark):
    """Numbers in every place: names, strings, comments, decimals, lists of ids, functions, fences."""
    registry = A.Registry(
        {"Product": ["ProductId", "Name2"], "Sale": ["SaleId", "ProductId", "Net"], "T2": ["C3"]}, [("Sale", "ProductId", "Product", "ProductId")],
        {"net_sales": ["Sale.Net"]})
    bodies = [
        "SELECT Name2 FROM Product WHERE ProductId = {n}", "SELECT C{n} FROM T2 WHERE C3 > {n}.5", "SELECT x.C3 FROM T{n} x", "SELECT SLEEP({n})", "SELECT {n}; SELECT 2 FROM T2",
        "SELECT Net FROM Sale s JOIN Product p ON s.ProductId = p.ProductId WHERE p.ProductId IN ({n}, 7,{n}) -- {n} FROM T9", "```sql\nSELECT '{n} FROM T{n}', \"{n}\" FROM Product\n```",
        "SELECT 1e{n}, Name{n} FROM Product LIMIT {n}", "SELECT Net FROM Sale JOIN Product ON Sale.SaleId = Product.ProductId AND Sale.Net={n}", "", "DELETE FROM T2 WHERE C3 = {n}",
        "WITH a{n} AS (SELECT Net FROM Sale) SELECT * FROM a{n}, Product WHERE ProductId={n}", "/*!{n} x */ SELECT 1 FROM `Product` WHERE `ProductId` = {n}"]
    rows = [(i, b.replace("{n}", str(n)), allowed, ["net_sales"] if n % 2 else [], [2, 7] if n < 30 else [], declared)
            for i, (b, n, allowed, declared) in enumerate(
                (b, n, a, d) for b in bodies for n in (1, 2, 13, 300) for a, d in ((["Product", "Sale", "T2"], None), (["Product"], ["Product", "T2"])))]
    rows.append((len(rows), None, ["Product"], [], [], None))
    log = spark.createDataFrame(rows, "id int, sql string, allowed_tables array<string>, metrics array<string>, candidates array<bigint>, declared array<string>")
    options = {"metrics": "metrics", "candidates": "candidates", "declared": "declared"}
    columns = ["id", "tables_used", "read_only_issue", "outside_tables", "column_issues", "identifier_issues", "join_issues", "metric_issues", "id_issues", "contract_issue", "first_issue"]
    one, other = (sorted(f(log, registry, **options).select(*columns).collect(), key=lambda r: r.id) for f in (A.audit, A.audit_by_template))
    assert one == other and len({r.first_issue for r in one}) > 8 and any(r.id_issues for r in one)
