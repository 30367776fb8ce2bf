import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import dates, words
from tallyframe.operators import matching
from tallyframe.operators.matching import Matcher, nearest_examples, once_per_text, question_context
from tallyframe.operators.paths import shortest_paths
from tallyframe.operators.prefixes import prefix_groups
from tallyframe.plans.retail_layer import EXAMPLES, RETAIL_CATALOGUE, RETAIL_LAYER
from tallyframe.sources.semantic import layer_from, layer_frames


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("SKUs sold", ["skus", "sold"]), ("HTTPServer BrandName2X", ["http", "server", "brand", "name2", "x"]),
    ("fooSKUs", ["foo", "sk", "us"]), ("  ", []), (None, []), ("Straße-1", ["stra", "e", "1"]),
])
def test_split_words(spark, text, expected):
    assert one(spark, words.split_words(F.col("t")), text) == expected


@pytest.mark.parametrize("token, expected", [
    ("bus", "bus"), ("ties", "tie"), ("categories", "category"), ("boxes", "box"), ("classes", "class"), ("glass", "glass"), ("sales", "sale")])
def test_singular(spark, token, expected):
    assert one(spark, words.singular(F.col("t")), token) == expected


@pytest.mark.parametrize("token, some, none", [
    ("moved", ["moved", "move"], ["mov"]), ("selling", ["sell", "selle"], []), ("bring", ["bring"], ["br", "bre"]),
    ("buyers", ["buyer", "buye"], ["buy"]), ("it", [], ["it"])])
def test_variants(spark, token, some, none):
    found = one(spark, words.token_variants(F.col("t")), token)
    assert set(some) <= set(found) and not set(none) & set(found)


def test_tokens_keep_order_and_drop_stop_words(spark):
    assert one(spark, words.normalize_tokens(F.col("t")), "Show the top Sales of sales by brands") == ["top", "sales", "sale", "brands", "brand"]


@pytest.mark.parametrize("text, expected", [
    ("in Mar, 26", "in March 2026"), ("in Mar 26", "in Mar 26"), ("Sept. 1999 and may , 70", "September 1999 and May 1970"),
    ("feb 2026 vs Feb 2026", "February 2026 vs February 2026"), ("march 123", "march 123"), ("smarch 2026", "smarch 2026")])
def test_months(spark, text, expected):
    refs = dates.month_references(F.col("t"))
    assert one(spark, dates.normalize_months(F.col("t"), refs), text) == expected


def test_month_range_over_the_year_end(spark):
    r = one(spark, dates.month_references(F.col("t")), "Dec 2025")[0]
    assert (str(r["start_date"]), str(r["end_exclusive"]), r["month"]) == ("2025-12-01", "2026-01-01", 12)


@pytest.fixture(scope="module")
def matcher(spark):
    return Matcher(RETAIL_LAYER, RETAIL_CATALOGUE, EXAMPLES)


def plan(spark, matcher, text):
    df = question_context(spark.createDataFrame([(text,)], "text string"))
    return matcher.plan(df).first().asDict(True)


def test_product_terms_come_in_dictionary_order(spark, matcher):
    found = plan(spark, matcher, "Show protein bar, sparkling water or cold brew sales")
    assert found["filters"][0]["matched"] == ["sparkling water", "protein bar", "cold brew"]


def test_inflected_synonym_matches(spark, matcher):
    names = [e["name"] for e in plan(spark, matcher, "who was our biggest buyer")["metrics"]]
    assert "net_sales" in names


def test_shorter_alias_inside_a_longer_hit_is_dropped(spark):
    layer = layer_from({"filter_hints": [{"name": "f", "synonyms": ["still water"], "target_table": "Product"}],
                        "value_aliases": [{"entity": "product", "canonical_value": "water", "aliases": ["fizzy water"]}]})
    found = plan(spark, Matcher(layer), "fizzy water please")
    assert found["filters"][0]["matched"] == ["fizzy water"]


def test_product_context_brings_the_line_metric(spark, matcher):
    metrics = {m["name"]: m["score"] for m in plan(spark, matcher, "seltzer revenue")["metrics"]}
    assert metrics["line_net_sales"] == 5


def test_required_tables_survive_the_cap(spark, matcher):
    df = spark.createDataFrame([("Show the top brands by net sales in March 2026.",)], "text string")
    row = matcher.retrieve(df, max_tables=1).first()
    assert row["selected"][0] == "SalesDocument" and {"SalesDocumentLine", "Brand"} <= set(row["selected"])


def test_nothing_matches_selects_the_first_tables(spark, matcher):
    row = matcher.retrieve(spark.createDataFrame([("xyzzy",)], "text string")).first()
    assert row["selected"] == [t.name for t in RETAIL_CATALOGUE.tables[:4]]


def test_examples_need_a_shared_token(spark, matcher):
    df = question_context(spark.createDataFrame([("active customers",), ("xyzzy",)], "text string"))
    assert [len(r["examples"]) for r in matcher.examples_for(df).collect()] == [2, 0]


def test_paths_prefer_names_and_stop_at_the_limit(spark):
    edges = spark.createDataFrame([("a", "c"), ("c", "d"), ("a", "b"), ("b", "d"), ("d", "e"), ("e", "f"), ("f", "a2")], "u string, v string")
    rows = {(r.src, r.dst): r.path for r in shortest_paths(edges, edges.select("u").union(edges.select("v")).distinct()).collect()}
    assert rows[("a", "d")] == ["a", "b", "d"] and rows[("a", "e")] == ["a", "b", "d", "e"] and ("a", "f") not in rows


def test_paths_from_chosen_sources_with_a_hub(spark):
    edges = spark.range(500).selectExpr("'hub' as u", "concat('leaf', id) as v")
    found = shortest_paths(edges, spark.createDataFrame([("leaf1",)], "s string"), 2)
    assert found.count() == 500


def test_prefix_groups(spark):
    df = spark.createDataFrame([("aa",), ("aa",), ("bbbbb",)], "p string")
    rows = prefix_groups(df, F.col("p")).collect()
    assert [(r.case_count, r.estimated_tokens) for r in rows] == [(2, 1), (1, 2)]


def test_layer_frames(spark):
    frames = layer_frames(spark, RETAIL_LAYER)
    assert {n: f.count() for n, f in frames.items()} == {
        "entities": 10, "metrics": 7, "filter_hints": 2, "value_aliases": 3, "join_paths": 13, "clarification_rules": 1}


def test_a_dictionary_of_any_size(spark):
    """Twenty thousand synonyms, of which a text means two."""
    from tallyframe.operators.matching import Dictionary, _tokenised
    names = tuple(f"gadget{i} frames" for i in range(20_000))
    lexicon, dictionary = _tokenised(names), Dictionary()
    for n in names:
        dictionary.add("entities", n, (n,), (), (), lexicon)
    df = question_context(spark.createDataFrame([("sales of gadget19999 frame and gadget7 frames",), (None,), ("nothing",)], "text string"))
    rows = [[m["name"] for m in r["matches"]] for r in dictionary.matched(df).collect()]
    assert sorted(rows) == [[], [], ["gadget7 frames", "gadget19999 frames"]]


def test_nearest_examples_against_brute_force(spark):
    rng = random.Random(6)
    pool = ["brand", "customer", "region", "march", "1997", "alpha", "beta", "gamma", "delta", "sigma"]
    said = lambda n: " ".join(rng.sample(pool, n))
    stored = sorted({said(rng.randint(1, 5)) for _ in range(60)} | {"brand customer", "customer brand", "Customer  brand", "xyzzy"})
    asked = [said(rng.randint(1, 7)) for _ in range(40)] + ["nothing known", "xyzzy", ""]
    store = spark.createDataFrame([(q, ["T"]) for q in stored] * 2, "question string, tables array<string>")
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, text string")
    got = {r.id: [e["question"] for e in r.examples] for r in nearest_examples(question_context(rows), store, 2).collect()}
    words = lambda t: set(t.lower().split())
    for i, a in enumerate(asked):
        best = sorted((-len(words(a) & words(q)), q) for q in stored if words(a) & words(q))[:2]
        assert got[i] == [q for _, q in best], (a, got[i], best)
    assert {len(r.examples) for r in nearest_examples(question_context(rows), store.limit(0)).collect()} == {0}


def test_examples_are_folded_to_the_asked_tokens(spark, monkeypatch):
    """Stored questions that differ in tokens nobody asks for are looked up once, however many they are."""
    store = spark.createDataFrame([(f"backlog of customer x{i:05d} in {m}", ["T"]) for i in range(2000) for m in ("march", "june")], "question string, tables array<string>")
    rows = spark.createDataFrame([(1, "best customer"), (2, "customer in june")], "id int, text string")
    sizes, real = [], matching.written
    monkeypatch.setattr(matching, "written", lambda df: sizes.append((made := real(df)).count()) or made)
    got = {r.id: [e["question"] for e in r.examples] for r in nearest_examples(question_context(rows), store, 2).collect()}
    assert got == {1: [f"backlog of customer x00000 in {m}" for m in ("june", "march")], 2: [f"backlog of customer x0000{i} in june" for i in (0, 1)]}
    assert max(sizes) < 50


def test_each_text_is_worked_on_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, text string")
    seen = []
    out = once_per_text(rows, "text", lambda t: seen.append(t.count()) or t.withColumn("size", F.length("text")))
    assert sorted((r.id, r.size) for r in out.collect()) == [(1, 1), (2, 1), (3, None), (4, 1)] and seen == [2]
