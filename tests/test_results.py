import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import evals, explore, pricing, profile, resolve
from tallyframe.sources import contract, readers, sinks
from tallyframe.sources.retail_schema import Reference, conform, references, registry_frames, schemas, spark_type
from tallyframe.sources.semantic import Alias


def profiled(df):
    return {r.column: r for r in profile.column_profile(df).collect()}


def test_types_and_roles(spark):
    rows = [("2026-03-01", 10.0, 1, "a", True, "1"), ("2026-03-02", 20.0, 2, "b", False, "2"), ("2026-02-30", 5.0, 3, None, True, "x")]
    df = spark.createDataFrame(rows, "Day string, NetAmount double, CustomerId int, label string, flag boolean, code string")
    p = profiled(df)
    assert {c: r.type for c, r in p.items()} == {
        "Day": "text", "NetAmount": "number", "CustomerId": "number", "label": "text", "flag": "boolean", "code": "text"}
    assert p["Day"].date_count == 2 and p["label"].non_null_count == 2 and p["label"].unique_count == 2
    assert [p[c].semantic_type for c in ("Day", "NetAmount", "CustomerId", "code")] == ["temporal_bucket", None, "identifier", "identifier"]
    assert p["NetAmount"].label == "Net Amount"


@pytest.mark.parametrize("name, bucket, identifier", [
    ("year_week", True, False), ("sales month", True, False), ("SalesDocumentPaid", False, False), ("AccountCode", False, True),
    ("id", False, True), ("CODE", False, True), ("order_ID", False, True), ("weekly", False, False)])
def test_names(name, bucket, identifier):
    assert (profile.is_bucket(name), profile.is_identifier(name)) == (bucket, identifier)


def test_samples_of_all_columns_in_one_scan(spark):
    rows = [(i * 7 % 50, None if i % 3 else f"t{i * 7 % 50}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, t string, v double").repartition(5)
    found = {r.column: r.samples for r in profile.column_samples(df, ["k"], 4).collect()}
    by = sorted(rows)
    assert found == {"k": ["0", "1", "2", "3"], "t": [t for _, t, _ in by if t][:4], "v": [str(v) for _, _, v in by][:4]}
    assert profile.column_samples(df.where("false"), ["k"]).count() == 0


def test_repeated_append_leaves_no_double_line(spark, tmp_path):
    lines = spark.range(6).select(F.lit("question.started").alias("event"), F.col("id").cast("int").alias("attempt"))
    folder = str(tmp_path / "trace")
    for batch in (0, 1, 1):  # the writer of batch 1 died before it could say so
        sinks.append_trace(lines.where(F.col("attempt") % 2 == batch), folder, batch)
    assert sorted(r.attempt for r in readers.read_trace(spark, folder).collect()) == list(range(6))


def test_insights(spark):
    rows = [(1, datetime.date(2026, 1, 1), "x", 5.0), (2, datetime.date(2026, 2, 1), "y", 9.0), (3, datetime.date(2026, 3, 1), "z", 9.0)]
    df = spark.createDataFrame(rows, "order_id int, day date, name string, total double")
    found = {r.insight: (r.value, r.amount) for r in profile.insights(df, ["order_id"]).collect()}
    assert found["total-total"] == (None, 23.0) and found["top-name-total"] == ("y", 9.0) and found["trend-day-total"] == ("up", 4.0)
    assert [r.insight for r in profile.insights(df.limit(0), ["order_id"]).collect()] == ["empty-result"]
    assert {r.value for r in profile.insights(df, ["order_id"], row_limit=3).collect()} >= {"limit reached"}


def test_chart_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", None, 2), ("a", 2.0, 3)], "name string, total double, row_id int")
    kinds = {r.type for r in profile.chart_series(df).collect()}
    assert kinds == {"bar", "pie"}
    assert {(r.x, r.y) for r in profile.chart_series(df).filter("type = 'bar'").collect()} == {("a", 3.0), ("b", 0.0)}
    assert profile.chart_series(df.limit(1)).count() == 0
    why = {r.type: r.excluded for r in profile.chart_choices(df).collect()}
    assert why == {"line": "no column of dates", "area": "no column of dates", "bar": None, "pie": None}
    wide = df.select("name", *[F.col("total").alias(f"m{i}") for i in range(5)], F.lit("2026-01-01").cast("date").alias("day"))
    assert {r.series for r in profile.chart_series(wide).filter("type = 'line'").collect()} == {f"m{i}" for i in range(5)}


def test_exact_distinct_counts(spark):
    df = spark.createDataFrame([(i % 7, None if i % 2 else f"v{i % 3}") for i in range(50)], "a int, b string")
    assert [r.unique_count for r in profile.column_profile(df, exact=True).orderBy("ordinal").collect()] == [7, 3]
    assert "Expand" not in profile.column_profile(df)._jdf.queryExecution().executedPlan().toString()


def test_samples_skip_nulls(spark):
    df = spark.createDataFrame([(i, None if i < 3 else f"v{i}") for i in range(20)], "i int, v string").repartition(4)
    rows = {r.column: r.samples for r in profile.column_samples(df, ["i"]).collect()}
    assert rows == {"i": ["0", "1", "2", "3", "4"], "v": ["v3", "v4", "v5", "v6", "v7"]}


def test_explore(spark):
    df = spark.createDataFrame([("item 10", 3), ("Item 2", None), ("item 2b", -1)], "n string, v int")
    assert [r.n for r in explore.typed_sort(df, "n").collect()] == ["Item 2", "item 2b", "item 10"]
    assert [r.v for r in explore.typed_sort(df, "v").collect()] == [-1, None, 3]
    assert [r.n for r in explore.contains_filter(df, " ITEM 2 ").collect()] == ["Item 2", "item 2b"]
    assert explore.contains_filter(df, "  ").count() == 3


ALIASES = (Alias("product", "sparkling water", ("seltzer", "carbonated water", "fizzy water")),)
PRODUCTS = [(1, "Sparkling Water 12 Pack", "SW-12", "seltzer carbonated fizzy water"), (2, "Protein Bar Box", "PB", "energy bar"),
            (3, "Seltzer", "SZ", None), (4, "Bar", "B-1", None), (5, "Rebar Kit", "RK", None)]


def test_resolution(spark):
    master = spark.createDataFrame(PRODUCTS, "id int, name string, code string, tags string")
    mentions = spark.createDataFrame([("sparkling water",), ("bar",), ("ar",), ("nothing like it",), ("!!",)], "mention string")
    rows = {r.mention: r for r in resolve.resolve_entities(mentions, master, "id", ["name", "code", "tags"], ALIASES).collect()}
    assert rows["sparkling water"].terms == ["sparkling water", "seltzer", "carbonated water", "fizzy water"]
    assert [(c.key, c.score, c.match_type) for c in rows["sparkling water"].candidates] == [
        (3, 100, "exact_field"), (1, 85, "field_prefix")]
    assert [(c.key, c.score) for c in rows["bar"].candidates] == [(4, 100), (2, 75), (5, 60)]
    assert {c.key for c in rows["ar"].candidates} == {1, 2, 4, 5}
    assert rows["nothing like it"].candidate_count == 0 and rows["!!"].candidate_count == 0


def test_candidates_equal_a_full_scan(spark):
    words = ["red", "bolt", "rod", "big", "a", "ring"]
    master = spark.createDataFrame([(i, f"{words[i % 6]} {words[(i * 5 + 1) % 6]}{i % 7}", f"{i:03d}") for i in range(200)], "id int, name string, code string")
    terms = ["red", "d b", "rin", "7", "g3", "bolt r", "zz", "00", "o"]
    mentions = spark.createDataFrame([(t,) for t in terms], "mention string")
    got = {(r.mention, r["__key"]) for r in resolve.find_candidates(resolve.expand_mentions(mentions, ()), master, "id", ["name", "code"]).collect()}
    want = {(t, r.id) for r in master.collect() for t in terms if t in r.name or t in r.code}
    assert got == want


def test_candidates_send_no_rows_to_every_task(spark, tmp_path):
    spark.createDataFrame([(i, f"red bolt {i % 3}") for i in range(3000)], "id int, name string").write.parquet(str(tmp_path / "m"))
    mentions = resolve.expand_mentions(spark.createDataFrame([("red",), ("bolt 1",)], "mention string"), ())
    found = resolve.find_candidates(mentions, spark.read.parquet(str(tmp_path / "m")), "id", ["name"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    # small files, many rows: only pieces may travel, which joins of rows can't do
    assert "Inner, Build" not in plan and "Inner" in plan
    assert sorted(r.mention for r in found.collect()) == ["bolt 1"] * 1000 + ["red"] * 3000


STATUS = [(True, True, ["a"], ["a"], [], "pass"), (True, True, ["a"], ["a"], ["x"], "disallowed_column_used"), (True, False, ["a"], ["a"], [], "low_signal_success"),
          (False, True, ["a"], ["b"], [], "retrieval_miss"), (False, True, ["a"], ["a", "b"], ["x"], "result_mismatch")]


@pytest.mark.parametrize("ok, signals, expected, retrieved, used, status", STATUS)
def test_status(spark, ok, signals, expected, retrieved, used, status):
    df = spark.createDataFrame([(ok, signals, expected, retrieved, used)], "o boolean, s boolean, e array<string>, r array<string>, u array<string>")
    assert df.select(evals.classify(*[F.col(c) for c in "oseru"]).alias("x")).first()["x"] == status


@pytest.mark.parametrize("passes, attempts, low, high", [(6, 6, 0.5, 0.7), (0, 0, 0, 0), (600, 600, 0.99, 1), (0, 5, 0, 0)])
def test_wilson(spark, passes, attempts, low, high):
    value = spark.createDataFrame([(passes, attempts)], "p int, n int").select(evals.wilson_lower(F.col("p"), F.col("n")).alias("w")).first()["w"]
    assert low <= value <= high


def test_reliability(spark):
    rows = [(1, "a", "pass"), (1, "b", "result_mismatch"), (2, "a", "pass"), (2, "b", "pass")]
    df = spark.createDataFrame(rows, "repetition int, case_id string, status string")
    r = evals.reliability(df).first()
    assert (r.mean_accuracy, r.min_accuracy, r.max_accuracy, r.all_cases_passed_rate, r.pass_rate) == (0.75, 0.5, 1.0, 0.5, 0.75)
    cases = {x.case_id: x for x in evals.per_case(df).collect()}
    assert cases["b"].statuses == {"pass": 1, "result_mismatch": 1} and cases["b"].pass_rate == 0.5


def test_costs(spark):
    calls = [("GPT-5.4 mini", 1000, 200, 400), ("gpt-5.4-2026-01", 1000, 200, 5000), ("gpt-5.40", 1, 1, None), ("gpt-4o-mini", 10, None, None)]
    df = spark.createDataFrame([(*c, None) for c in calls], "model string, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, total_tokens bigint")
    rows = pricing.call_costs(df).collect()
    assert rows[0].total_cost == pytest.approx(600e-6 * 0.75 + 400e-6 * 0.075 + 200e-6 * 4.5)
    assert rows[1].price.model == "gpt-5.4" and rows[1].cached_prompt_tokens == 1000
    assert rows[2].total_cost is None and rows[3].total_cost is None
    used = pricing.usage_totals(df).first()
    assert (used.prompt_tokens, used.total_tokens, used.cached_tokens) == (2001, 2402, 1400)
    prices = pricing.with_overrides(pricing.PRICES, {"gpt-5.4": {"currency": "EUR"}})
    with pytest.raises(Exception, match="cannot add"):
        pricing.cost_totals(pricing.call_costs(df, prices)).collect()


def test_schema_contract(spark):
    made = schemas(["Customer", "SalesDocument"])
    inside, missing = references(made)
    assert [(r.column, r.to_table) for r in inside] == [("CustomerId", "Customer")] and len(missing) == 3
    tables, columns, edges = registry_frames(spark, ["Customer", "SalesDocument"])
    assert (tables.count(), columns.count(), edges.count()) == (2, 22, 1)
    assert [spark_type(t).simpleString() for t in ("INTEGER(1)", "STRING(40)", "DATE", "DATEONLY", "DECIMAL", None, "BLOB", "ENUM('a')")] == [
        "int", "string", "timestamp_ntz", "date", "decimal(24,8)", "string", "binary", "string"]
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "CustomerId int, CustomerCode string")
    full = rows.selectExpr("*", "'n' as CustomerName", "'s' as CustomerSegment", "1 as IsActive")
    broken = {(r.rule, r.column, r["rows"]) for r in contract.schema_violations(full, made["Customer"]).collect()}
    assert broken == {("not_null", "CustomerId", 1), ("unique", "CustomerId", 1), ("unique", "CustomerCode", 1)}


def test_orphans_and_signatures(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int")
    row = contract.orphans({"c": child, "p": parent}, [Reference("c", "k", "p", "k")]).first()
    assert (row.orphan_values, row.orphan_rows) == (1, 2)
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, value string")
    sign = lambda df: contract.files_signature(df).first()["signature"]
    assert sign(files) == sign(files.orderBy(F.desc("path"))) != sign(files.withColumn("value", F.lit("1")))
    assert contract.is_stale("a", "b") and not contract.is_stale("a", None)


def test_cases_file(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([
        {"id": "c1", "question": " Q? ", "expected_sql": "SELECT 1 FROM a JOIN b ON 1 = 1", "tags": [" x", "x", ""]},
        {"id": "c2", "question": "R", "expected_sql": "SELECT 1 FROM a", "expected_tables": ["z"], "intentId": "i", "tags": ["y"]}]))
    rows = {r.id: r for r in readers.read_cases(spark, str(path)).collect()}
    assert rows["c1"].expected_tables == ["a", "b"] and rows["c1"].intentId == "c1" and rows["c1"].tags == ["x"] and rows["c1"].canonicalQuestion == "Q?"
    assert rows["c2"].expected_tables == ["z"]
    assert [r.id for r in readers.read_cases(spark, str(path), tag="y").collect()] == ["c2"]
    with pytest.raises(ValueError):
        readers.read_cases(spark, str(path), case_id="none")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, None), (3, "plain")], "rowId int, netText string")
    sinks.export_csv(df.coalesce(1), str(tmp_path / "csv"), needle="")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text == 'Row Id,Net Text\n1,"say ""hi"", ok"\n2,\n3,plain\n'
    seeded = sinks.seed_table(spark, [{"CustomerId": 1, "CustomerName": "n"}], schemas()["Customer"], "seeded_customer")
    assert seeded.first().asDict() == {"CustomerId": 1, "CustomerCode": None, "CustomerName": "n", "CustomerSegment": None, "IsActive": 1}
    assert conform(df, {"rowId": "STRING(9)"}).schema["rowId"].dataType.simpleString() == "string"


def test_trace_lines_in_batch_and_as_a_stream(spark, tmp_path):
    lines = spark.createDataFrame([("2026-01-01T00:00:00.000", "web", "r1", "question.started", 1.5), ("2026-01-01T00:00:01.000", "web", "r1", "sql.executed", 2.0)],
                                  "timestamp string, pipeline string, runId string, event string, durationMs double")
    source, copy = str(tmp_path / "trace"), str(tmp_path / "copy")
    sinks.append_trace(lines, source)
    sinks.append_trace(lines.limit(1), source)
    batch = readers.read_trace(spark, source)
    assert batch.count() == 3 and batch.filter("timestamp IS NULL").count() == 0
    query = sinks.stream_trace_to(readers.stream_trace(spark, source, 1), copy, str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted((r.event, r.durationMs) for r in df.collect())
    assert key(readers.read_trace(spark, copy)) == key(batch)


def test_report_path_parts(spark, tmp_path):
    report = spark.createDataFrame([(1,)], "n int")
    sinks.write_report(report, str(tmp_path / "r"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), F.lit(" core/public! "), F.lit("m 1"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert (row.run_ts, row.dataset, row.model) == ("2026-01-02T03-04-05", "core-public", "m-1")
