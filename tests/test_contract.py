from pyspark.sql import functions as F

from tallyframe.functions.numbers import cell_key, round_half_up
from tallyframe.operators import compare, prefixes, resolve
from tallyframe.sources import contract


def test_signature_tells_where_a_null_is(spark):
    a = spark.createDataFrame([(None, "x")], "a string, b string")
    b = spark.createDataFrame([("x", None)], "a string, b string")
    assert contract.table_signature(a).first() != contract.table_signature(b).first()


def test_no_rules_no_violations(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert contract.contract_violations(df).collect() == []
    assert contract.schema_violations(df, df.schema).collect() == []


def test_files_signature_ignores_order_only(spark):
    rows = [("p1", "a"), ("p2", "b"), ("p3", None)]
    of = lambda r: contract.files_signature(spark.createDataFrame(r, "path string, value string")).first()[0]
    assert of(rows) == of(rows[::-1])
    assert len({of(rows), of([("p1", "b"), ("p2", "a"), ("p3", None)]), of([*rows[:2], ("p3", "")]), of(rows + rows[:1])}) == 4


def test_large_numbers_stay_apart(spark):
    df = spark.createDataFrame([(1e17, 2e17, -3e18, 1.005, 2.675)], "a double, b double, c double, d double, e double")
    row = df.select(*[round_half_up(F.col(c), 2) for c in "abcde"]).first()
    assert tuple(row) == (1e17, 2e17, -3e18, 1.01, 2.68)
    x, y = (df.select(F.col(c).alias("v")) for c in "ab")
    assert not compare.rowset_equal(x, y, ["v"], {"v": "v"}).first()["rows_match"]
    assert x.select(cell_key(F.col("v"), x.schema["v"].dataType)).first()[0] == "n:1.0E17"


def test_prefixes_group_by_the_whole_text(spark):
    rows = prefixes.prefix_groups(spark.createDataFrame([("abc",), ("abc",), ("abd",)], "p string"), F.col("p")).collect()
    assert [(r.case_count, len(r.prefix_hash)) for r in rows] == [(2, 16), (1, 16)]


def test_master_rows_with_null_or_repeated_keys_are_found(spark):
    master = spark.createDataFrame([(None, "red chair"), (1, "red table"), (1, "red lamp")], "k int, name string")
    mentions = resolve.expand_mentions(spark.createDataFrame([("red",)], "mention string"), ())
    found = resolve.find_candidates(mentions, master, "k", ["name"]).collect()
    assert sorted(r["name"] for r in found) == ["red chair", "red lamp", "red table"]
