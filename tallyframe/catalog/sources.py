"""Contracts, signatures, cases and round trips on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.catalog.questions import questions
from tallyframe.catalog.sqllog import _CTE, _OK
from tallyframe.plans.retail import orders_as_retail
from tallyframe.shared import shared_folder
from tallyframe.sources import contract, readers, semantic, sinks
from tallyframe.sources.retail_schema import Reference, conform, registry_frames


def _t(spark, d, name):
    return readers.read_table(spark, d, name)


def lineitem_contract(spark, d):
    """Null, domain and length rules on all lines."""
    return contract.contract_violations(
        _t(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_shipdate"],
        {"l_returnflag": ["A", "R"], "l_linestatus": ["O", "F"]}, {"l_returnflag": 1})


def duplicate_line_keys(spark, d):
    return contract.duplicate_keys(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).withColumnRenamed("rows", "row_count").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "row_count")


def layer_file_relations(spark, d):
    """The brands and sizes of the parts as a semantic-layer file, written, read again and split into its relations."""
    parts = _t(spark, d, "part")
    brands = parts.groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size").cast("string"))).alias("sizes"))
    entity = F.struct(F.concat(F.lit(" "), F.col("p_brand")).alias("name"), F.col("sizes").alias("synonyms"), F.array(F.lit("part"), F.lit("part")).alias("preferred_tables"))
    metric = F.struct(F.concat(F.lit("units of "), F.col("p_brand")).alias("name"), F.lit("COUNT(*)").alias("preferred_expression"), F.array(F.col("p_brand")).alias("synonyms"))
    unnamed = F.array(F.struct(F.lit(" ").alias("name"), F.array(F.lit("x")).alias("synonyms"), F.array(F.lit("y")).alias("preferred_tables")))
    file = brands.agg(F.to_json(F.struct(F.concat(F.sort_array(F.collect_list(entity)), unnamed).alias("entities"), F.sort_array(F.collect_list(metric)).alias("metrics"))).alias("value"))
    path = shared_folder(spark, "layer")
    file.coalesce(1).write.text(path)
    frames = semantic.layer_frames(spark, semantic.read_layer_at(spark, path))
    joined = lambda c: F.array_join(c, "|")
    return frames["entities"].select(F.lit("entity").alias("relation"), "name", joined("synonyms").alias("synonyms"), joined("tables").alias("tables"), F.lit(0).alias("counts")).union(
        frames["metrics"].select(F.lit("metric"), "name", joined("synonyms"), joined("tables"), F.col("counts").cast("int")))


def orphan_references(spark, d):
    tables = {t: _t(spark, d, t) for t in ("orders", "lineitem", "customer", "part", "supplier", "labels", "documents")}
    small = tables["part"].filter("p_size <= 25")
    return contract.orphans(dict(tables, small_part=small), [
        Reference("orders", "o_custkey", "customer", "c_custkey"), Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Reference("lineitem", "l_partkey", "small_part", "p_partkey"), Reference("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Reference("labels", "doc_id", "documents", "doc_id")])


def registry_references(spark, d):
    """References between the tables that the lines use, split into known and missing targets."""
    named = (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))
    counted = _t(spark, d, "lineitem").agg(*[F.count(c).alias(c) for c, _ in named])
    edges = counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("from_column"), F.lit(t).alias("to_table"), F.col(c).alias("row_count")) for c, t in named])))
    tables = spark.createDataFrame([("orders",), ("part",)], "table string")
    known, missing = contract.split_references(edges, tables)
    return known.withColumn("state", F.lit("known")).unionByName(missing.withColumn("state", F.lit("missing")))


def table_signatures(spark, d):
    """Two differently laid out copies of the orders have the same signature; a changed copy has not."""
    o = _t(spark, d, "orders")
    base = contract.table_signature(o)
    again = contract.table_signature(o.hint("rebalance", "o_custkey"))
    changed = contract.table_signature(o.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    same = lambda other: base.unionByName(other).distinct().agg((F.count("*") == 1).cast("int").alias("same"))
    return same(again).select(F.lit("moved").alias("copy"), "same").unionByName(same(changed).select(F.lit("changed").alias("copy"), "same"))


def signature_sees_nulls(spark, d):
    """The same values with their nulls in the other column make another signature."""
    p, gone = _t(spark, d, "part"), F.col("p_partkey") % 3 == 0
    one, other = F.when(~gone, F.col("p_name")), F.when(gone, F.col("p_name"))
    a = contract.table_signature(p.select("p_partkey", one.alias("a"), other.alias("b")))
    b = contract.table_signature(p.select("p_partkey", other.alias("a"), one.alias("b")))
    return a.unionByName(b).distinct().agg((F.count("*") == 1).cast("int").alias("same"))


def files_signature_checks(spark, d):
    """Documents as files: their order doesn't matter, a swapped or a lost one does."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("value"))
    base = contract.files_signature(docs)
    variants = {
        "moved": docs.hint("rebalance", "value"), "changed": docs.withColumn("value", F.when(F.col("path") == "1", "other").otherwise(F.col("value"))), "lost": docs.filter("path <> '1'")}
    parts = [base.unionByName(contract.files_signature(v)).distinct().agg((F.count("*") == 1).cast("int").alias("same")).select(F.lit(k).alias("copy"), "same") for k, v in variants.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def case_file_by_tag(spark, d):
    """Cases written as files of JSON arrays, read back and narrowed to one tag."""
    folder = shared_folder(spark, "cases")
    part = F.floor(F.regexp_extract("id", "[0-9]+", 0).cast("bigint") / 1000)
    arrays = _cases(spark, d).withColumn("part", part).groupBy("part").agg(F.to_json(F.collect_list(F.struct(*[c for c in _cases(spark, d).columns]))).alias("value"))
    arrays.write.partitionBy("part").text(folder)
    return readers.read_cases(spark, f"{folder}/*", tag="1-urgent").select("id", F.array_join("tags", "|").alias("tags"))


def seeded_nations(spark, d):
    """A table that is replaced by given rows twice, the second time without some of them; missing fields get their default."""
    schema = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("region", T.StringType(), True, {"default": "none"})])
    rows = [r.asDict() for r in _t(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region")).collect()]  # 25 rows
    sinks.seed_table(spark, rows, schema, "tallyframe_seeded_nations")
    return sinks.seed_table(spark, [r for r in rows if r["n_nationkey"] % 2 == 0], schema, "tallyframe_seeded_nations")


def narrowed_registry(spark, d):
    """Foreign keys inside three of the tables, with the rows of the referring table."""
    model = orders_as_retail(spark, d)
    _, _, edges = registry_frames(spark, ["SalesDocument", "SalesDocumentLine", "Product"])
    counts = [model.tables[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("from_table"), "rows") for t in ("SalesDocument", "SalesDocumentLine")]
    return edges.join(counts[0].unionByName(counts[1]), "from_table").select("from_table", "from_column", "to_table", F.col("rows").alias("row_count"))


def typed_orders(spark, d):
    """Orders as text, brought back to their declared logical types."""
    text = _t(spark, d, "orders").select(*[F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")])
    typed = conform(text, {"o_orderkey": "INTEGER(10)", "o_totalprice": "DECIMAL", "o_orderdate": "DATEONLY", "o_orderpriority": "STRING(20)"})
    return typed.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("o_totalprice"),
                        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


def _cases(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderpriority", "o_orderstatus")
    q = questions(spark, d).join(o, "question_id")
    key = F.col("question_id").cast("string")
    sql = F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(_CTE[0]), key, F.lit(_CTE[1]))).otherwise(F.concat(F.lit(_OK[0]), key, F.lit(_OK[1])))
    none = F.lit(None).cast("array<string>")
    return q.select(
        F.concat(F.lit(" case-"), key, F.lit(" ")).alias("id"), F.when(F.col("o_orderstatus") == "O", F.lit(" shared ")).alias("intentId"),
        F.col("text").alias("question"), F.lit(None).cast("string").alias("canonicalQuestion"),
        F.array(F.lit(" ranking"), F.lit(""), F.lit("ranking "), F.lower("o_orderpriority")).alias("tags"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Brand "), F.lit("Brand"))).otherwise(none).alias("expected_tables"),
        none.alias("expected_columns"), none.alias("disallowed_columns"), sql.alias("expected_sql"))


def normalized_cases(spark, d):
    return readers.normalize_cases(_cases(spark, d)).select(
        "id", "intentId", F.array_join("tags", "|").alias("tags"), F.array_join(F.array_sort("expected_tables"), "|").alias("expected_tables"))


def trace_round_trip(spark, d):
    """Events appended as JSON lines in two writes and read back with a declared schema."""
    e = _t(spark, d, "events")
    lines = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("web").alias("pipeline"),
                     F.col("user_id").cast("string").alias("runId"), F.col("event_type").alias("event"), F.col("value").alias("durationMs"),
                     F.col("props").alias("payload"))
    folder = shared_folder(spark, "trace")
    sinks.append_trace(lines.filter("event = 'click'"), folder)
    sinks.append_trace(lines.filter("event <> 'click'"), folder)
    back = readers.read_trace(spark, folder)
    return back.groupBy("runId", "event").agg(F.count("*").alias("events"), F.sum(F.col("durationMs").cast("decimal(18,2)")).cast("double").alias("total_ms"))


def report_round_trip(spark, d):
    """Order counts per priority written as a report and read back by its path parts."""
    o = _t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    folder = shared_folder(spark, "report")
    sinks.write_report(o, folder, F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), F.concat(F.lit("core / "), "o_orderpriority"), F.lit("gpt 5!"))
    return spark.read.json(folder).groupBy("dataset", "model").agg(F.sum("n").alias("orders"))


def csv_round_trip(spark, d):
    """Part names with quotes, commas and gaps exported as CSV and read back."""
    p = _t(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('say "'), "p_name", F.lit('", ok'))).when(F.col("p_size") % 3 == 1, F.col("p_name")).alias("p_name"))
    folder = shared_folder(spark, "csv")
    sinks.export_csv(p, folder, ["p_partkey", "p_name"])
    back = spark.read.csv(folder, header=True, quote='"', escape='"')
    return back.select(F.col("P partkey").cast("bigint").alias("p_partkey"), F.coalesce("P name", F.lit("")).alias("p_name"))


QUERIES = {
    f.__name__: f
    for f in (lineitem_contract, duplicate_line_keys, layer_file_relations, orphan_references, registry_references, table_signatures, signature_sees_nulls, files_signature_checks, case_file_by_tag,
              seeded_nations, narrowed_registry, typed_orders,
              normalized_cases, trace_round_trip, report_round_trip, csv_round_trip)
}


def _orphan(child: str, column: str, parent: str, key: str, label: str | None = None) -> str:
    return f"""SELECT '{label or child + '.' + column}' AS reference, COUNT(DISTINCT {column}) AS orphan_values, COUNT(*) AS orphan_rows
        FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"""


ORACLES = {
    "lineitem_contract": """SELECT 'domain' AS rule, 'l_returnflag' AS "column", COUNT(*) AS rows FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') HAVING COUNT(*) > 0""",
    "duplicate_line_keys": """SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "layer_file_relations": """WITH s AS (SELECT DISTINCT p_brand, CAST(p_size AS VARCHAR) AS size FROM part)
        SELECT 'entity' AS relation, p_brand AS name, STRING_AGG(size, '|' ORDER BY size) AS synonyms, 'part' AS tables, 0 AS counts FROM s GROUP BY p_brand
        UNION ALL SELECT DISTINCT 'metric', 'units of ' || p_brand, p_brand, '', 1 FROM part""",
    "orphan_references": " UNION ALL ".join((
        _orphan("orders", "o_custkey", "customer", "c_custkey"), _orphan("lineitem", "l_orderkey", "orders", "o_orderkey"),
        _orphan("lineitem", "l_partkey", "(SELECT * FROM part WHERE p_size <= 25)", "p_partkey"),
        _orphan("lineitem", "l_suppkey", "supplier", "s_suppkey"), _orphan("labels", "doc_id", "documents", "doc_id"))),
    "registry_references": """SELECT c AS from_column, t AS to_table, (SELECT COUNT(*) FROM lineitem) AS row_count,
        CASE WHEN t = 'supplier' THEN 'missing' ELSE 'known' END AS state FROM (VALUES ('l_orderkey', 'orders'), ('l_partkey', 'part'), ('l_suppkey', 'supplier')) v(c, t)""",
    "table_signatures": """SELECT 'moved' AS copy, CAST(COUNT(*) = 0 AS INT) AS same FROM (FROM orders EXCEPT ALL SELECT * FROM (FROM orders ORDER BY o_custkey))
        UNION ALL SELECT 'changed', CAST(COUNT(*) = 0 AS INT) FROM (FROM orders EXCEPT ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM orders)""",
    "case_file_by_tag": """SELECT 'case-' || o_orderkey AS id, 'ranking|' || LOWER(o_orderpriority) AS tags FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "seeded_nations": """SELECT n_nationkey, n_name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) ELSE 'none' END AS region FROM nation WHERE n_nationkey % 2 = 0""",
    "narrowed_registry": """SELECT 'SalesDocumentLine' AS from_table, c AS from_column, t AS to_table, (SELECT COUNT(*) FROM lineitem) AS row_count
        FROM (VALUES ('SalesDocumentId', 'SalesDocument'), ('ProductId', 'Product')) v(c, t)""",
    "signature_sees_nulls": """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS b FROM part),
        b AS (SELECT p_partkey, b AS a, a AS b FROM a) SELECT CAST(COUNT(*) = 0 AS INT) AS same FROM (FROM a EXCEPT ALL FROM b)""",
    "files_signature_checks": """SELECT 'moved' AS copy, CAST(COUNT(*) = 0 AS INT) AS same FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, text FROM (FROM documents ORDER BY text))
        UNION ALL SELECT 'changed', CAST(COUNT(*) = 0 AS INT) FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id = 1 THEN 'other' ELSE text END FROM documents)
        UNION ALL SELECT 'lost', CAST(COUNT(*) = 0 AS INT) FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, text FROM documents WHERE doc_id <> 1)""",
    "typed_orders": "SELECT o_orderkey, o_totalprice, STRFTIME(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
    "normalized_cases": """SELECT 'case-' || o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'shared' ELSE 'case-' || o_orderkey END AS "intentId",
        'ranking|' || LOWER(o_orderpriority) AS tags, CASE WHEN o_orderstatus = 'F' THEN 'Brand'
        WHEN o_orderpriority = '2-HIGH' THEN 'Brand|Product|SalesDocumentLine|feb|mar' ELSE 'Customer|SalesDocument' END AS expected_tables FROM orders""",
    "trace_round_trip": """SELECT CAST(user_id AS VARCHAR) AS "runId", event_type AS event, COUNT(*) AS events,
        CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_ms FROM events GROUP BY 1, 2""",
    "report_round_trip": """SELECT 'core-' || REPLACE(o_orderpriority, ' ', '-') AS dataset, 'gpt-5' AS model, COUNT(*) AS orders FROM orders GROUP BY 1""",
    "csv_round_trip": """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'say "' || p_name || '", ok' WHEN 1 THEN p_name ELSE '' END AS p_name FROM part""",
}
