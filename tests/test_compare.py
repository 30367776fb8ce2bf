import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import compare as C
from tallyframe.operators.pairing import candidate_pairs, unpaired_keys
from tallyframe.operators.quality import SignalChecks, check_failures, verify_results


def frame(spark, rows, schema="name string, total double"):
    return spark.createDataFrame(rows, schema)


GOLD = [("a", 10.0), ("b", 5.0), ("c", None)]


@pytest.mark.parametrize("rows, schema, expected", [
    ([("b", 5.0), ("c", None), ("a", 10.001)], "label string, revenue double", True),
    ([(1, "b", 5.0), (2, "c", None), (3, "a", 10.0)], "id int, label string, revenue double", True),
    ([("b", "5.000"), ("c", None), ("a", " 10 ")], "label string, revenue string", True),
    ([("a", 10.0), ("b", 5.1), ("c", None)], "l string, r double", False),
    ([("a", 5.0), ("b", 10.0), ("c", None)], "l string, r double", False),
    ([("a", 10.0), ("b", 5.0)], "l string, r double", False),
    ([("a",), ("b",), ("c",)], "l string", False),
])
def test_rowset(spark, rows, schema, expected):
    assert C.compare_results(frame(spark, GOLD), frame(spark, rows, schema), C.Comparison()) is expected


def test_duplicates_count(spark):
    a, b = frame(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0)]), frame(spark, [("a", 1.0), ("b", 1.0), ("b", 1.0)])
    assert not C.compare_results(a, b, C.Comparison())
    rows = {(r.name, r.side, r["rows"]) for r in C.difference_rows(a, b, ["name", "total"]).collect()}
    assert rows == {("s:a", "expected_only", 1), ("s:b", "actual_only", 1)}


def test_scalar(spark):
    spec = C.Comparison(mode="scalar")
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "n int")
    assert C.compare_results(one(27), one(27).withColumnRenamed("n", "m"), spec)
    assert not C.compare_results(one(27), one(26), spec)
    assert not C.compare_results(one(27), one(27, 27), spec)


@pytest.mark.parametrize("values, order, breaks", [
    ([9, 5, 5, 1], "desc", 0), ([1, 5, 9], "desc", 2), ([1, 5, 9], "asc", 0), ([9, None, 10], "desc", 1), ([9, 4, None], "desc", 0)])
def test_ranking(spark, values, order, breaks):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "place int, v double").repartition(3)
    assert C.ranking_violations(df, "place", "v", order).first()["violations"] == breaks


def test_ranked_comparison_allows_swapped_ties(spark):
    gold = spark.createDataFrame([(1, "a", 5.0), (2, "b", 5.0), (3, "c", 1.0)], "place int, n string, v double")
    swapped = spark.createDataFrame([(1, "b", 5.0), (2, "a", 5.0), (3, "c", 1.0)], "place int, n string, v double")
    turned = spark.createDataFrame([(3, "b", 5.0), (2, "a", 5.0), (1, "c", 1.0)], "place int, n string, v double")
    spec = C.Comparison.of({"mode": "ranked", "value_columns": ["v"]})
    assert C.compare_results(gold, swapped, spec, rank="place") and not C.compare_results(gold, turned, spec, rank="place")


def brute(left, right, tolerance):
    """Is there a bijection with every number within the tolerance?"""
    if len(left) != len(right):
        return False
    near = lambda a, b: all(x == y or (x is not None and y is not None and abs(x - y) <= tolerance + 1e-9) for x, y in zip(a, b))
    return any(all(near(a, b) for a, b in zip(left, p)) for p in itertools.permutations(right))


@pytest.mark.parametrize("width", [1, 2])
def test_tolerance_against_brute_force(spark, width):
    rng = random.Random(7 + width)
    left, right, expected = [], [], set()
    for key in range(60):
        n = rng.randint(1, 5)
        a = [tuple(round(rng.uniform(0, 6), 1) if rng.random() > 0.05 else None for _ in range(width)) for _ in range(n)]
        b = [tuple(None if x is None else x + rng.choice([-1.2, -0.9, 0, 0.5, 1]) for x in row) for row in a]
        rng.shuffle(b)
        if rng.random() < 0.1:
            b.pop()
        left += [(f"k{key}", *r) for r in a]
        right += [(f"k{key}", *r) for r in b]
        if not brute(a, b, 1.0):
            expected.add(f'["s:k{key}"]')
    schema = "k string, " + ", ".join(f"v{i} double" for i in range(width))
    left_df, right_df = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    # a key without rows on one side is uneven too
    expected |= {f'["s:{k}"]' for k in {r[0] for r in left} ^ {r[0] for r in right}}
    multi = C.multi_tolerance_violations(left_df, right_df, ["k"], [f"v{i}" for i in range(width)], 1.0)
    assert {r.key for r in multi.collect()} == expected
    if width == 1:
        single = C.tolerance_violations(left_df, right_df, ["k"], "v0", 1.0)
        assert {r.key for r in single.collect()} == expected


@pytest.mark.parametrize("block_pairs", [0, 6, 100_000])
def test_pairing_over_the_cluster(spark, block_pairs):
    """Blocks in one task and blocks by augmenting rounds give what trying all pairings gives; equal rows count as often as they are."""
    rng = random.Random(31)
    rows, want = [], set()
    for key in range(14):
        a = [(rng.randint(0, 4) * 0.8, rng.choice([0.0, 0.5, None])) for _ in range(rng.randint(1, 6))]
        b = [(x + rng.choice([-0.8, 0, 0.8, 0.9]), y if y is None else y + rng.choice([0, 0.4])) for x, y in rng.sample(a, len(a))]
        if key == 3:
            b.pop()
        rows += [(f"k{key}", 0, *r) for r in a] + [(f"k{key}", 1, *r) for r in b]
        if not brute(a, b, 1.0):
            want.add(f"k{key}")
    table = spark.createDataFrame(rows, "key string, side int, v0 double, v1 double")
    got = unpaired_keys(table, ["v0", "v1"], 1.0 + 1e-9, block_pairs=block_pairs)
    assert sorted(r.key for r in got.collect()) == sorted(want) and 0 < len(want) < 14
    assert unpaired_keys(table.limit(0), ["v0", "v1"], 1.0).count() == 0


def test_a_chain_needs_long_ways(spark):
    """Left rows 0.9 apart, right rows shifted: with one more at the end only the way through the whole chain pairs all."""
    def chain(n, shift):
        return spark.createDataFrame([("k", 0, 0.9 * i, 0.0) for i in range(n)] + [("k", 1, 0.9 * (i + shift), 0.0) for i in range(n)], "key string, side int, v0 double, v1 double")
    assert unpaired_keys(chain(12, 1), ["v0", "v1"], 1.0, block_pairs=0).isEmpty()
    assert [r.key for r in unpaired_keys(chain(12, 2), ["v0", "v1"], 1.0, block_pairs=0).collect()] == ["k"]


def test_one_summary_a_key_and_task(spark):
    """Small batches: a key's sums go on from batch to batch, within a task and over tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = spark.range(600).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), (F.col("id") * 0.7).alias("v"))
        for shift, want in ((0.5, []), (1.4, ['["s:a"]', '["s:b"]'])):
            moved = left.withColumn("v", F.col("v") + shift)
            assert sorted(r.key for r in C.tolerance_violations(left, moved, ["k"], "v", 0.6).collect()) == want
        one = left.withColumn("v", F.when((F.col("k") == "b") & (F.col("v") > 200) & (F.col("v") < 203), F.col("v") + 9).otherwise(F.col("v")))
        assert [r.key for r in C.tolerance_violations(left, one, ["k"], "v", 0.6).collect()] == ['["s:b"]']
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_dense_key_spreads(spark):
    """One key, rows that all hang together: no task gets most of them."""
    left = spark.range(20_000).select(F.lit("k").alias("key"), F.lit(0).alias("side"), (F.col("id") * 0.5).alias("v0"), F.lit(0.0).alias("v1"))
    nodes = left.union(left.withColumn("side", F.lit(1))).withColumn("units", F.lit(1)).withColumn("id", F.monotonically_increasing_id())
    joined = candidate_pairs(nodes, ["v0", "v1"], 1.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in joined) > 90_000 and max(r["count"] for r in joined) < 40_000
    assert unpaired_keys(left.union(left.withColumn("side", F.lit(1)).withColumn("v0", F.col("v0") + 0.4)), ["v0", "v1"], 1.0).isEmpty()


def test_tolerance_comparison(spark):
    spec = C.Comparison(tolerance=1.0)
    gold = frame(spark, [("a", 100.5)])
    assert C.compare_results(gold, frame(spark, [("a", 99.6)]), spec)
    assert C.compare_results(gold, frame(spark, [("a", 101.4)]), spec)
    assert not C.compare_results(gold, frame(spark, [("a", 102.0)]), spec)


def test_tolerance_tries_few_assignments(spark):
    """Five columns and one value that differs: a handful of jobs, not one for each order of the columns."""
    schema = "a double, b double, c double, d double, e string"
    rows = [(float(i), 100.0 + 3 * i, float(i % 7), -2.0 * i, f"t{i}") for i in range(20)]
    moved = [(e, d + 0.3, c, b - 0.2, a) for a, b, c, d, e in rows]
    names = "p string, q double, r double, s double, t double"
    tracker = spark.sparkContext.statusTracker()
    for changed, want in ((None, True), (5, False)):
        other = list(moved)
        if changed:
            other[changed] = (*other[changed][:2], other[changed][2] + 0.9, *other[changed][3:])
        spark.sparkContext.setJobGroup(f"few-{changed}", "")
        assert C.compare_results(spark.createDataFrame(rows, schema), spark.createDataFrame(other, names), C.Comparison(tolerance=0.5)) is want
        # adaptive execution counts each shuffle as a job
        assert len(tracker.getJobIdsForGroup(f"few-{changed}")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_tolerance_tells_similar_columns_apart(spark):
    """Two columns of the same range: only the pass over sorted values says which is which."""
    a = [(float(i), float(i * i % 21)) for i in range(21)]
    left = spark.createDataFrame(a, "u double, v double")
    pairs = [("u", "x"), ("u", "y"), ("v", "x"), ("v", "y")]
    right = spark.createDataFrame([(v + 0.2, u - 0.1) for u, v in a], "x double, y double")
    assert C.near_columns(left, right, pairs, 0.5) == {("u", "y"), ("v", "x")}
    assert C.compare_results(left, right, C.Comparison(tolerance=0.5))
    assert not C.compare_results(left, right.withColumn("y", F.col("y") + F.when(F.col("y") > 19, 0.0).otherwise(0.9) * (F.col("y") > 18).cast("int")), C.Comparison(tolerance=0.05))


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_eight_columns_with_the_same_values(spark):
    """All columns hold 0 to 39 in other orders: a few jobs say that no mapping exists, and find the one that does."""
    rng = random.Random(5)
    columns = [rng.sample(range(40), 40) for _ in range(8)]
    rows = list(zip(*columns))
    names = [f"c{i}" for i in range(8)]
    gold = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    order = rng.sample(range(8), 8)
    other = [tuple(r[i] for i in order) for r in rows]
    swapped = [list(r) for r in other]
    swapped[3][2], swapped[9][2] = swapped[9][2], swapped[3][2]
    schema = ", ".join(f"x{i} int" for i in range(8))
    for case, table, want in (("same", other, True), ("swapped", [tuple(r) for r in swapped], False)):
        got, n = jobs(spark, f"eight-{case}", lambda table=table: C.compare_results(gold, spark.createDataFrame(table, schema), C.Comparison()))
        assert got is want and n < 12, (case, n)
    found = list(C.column_assignments(gold, spark.createDataFrame(other, schema), names, C.Comparison()))
    assert found == [{f"c{order[i]}": f"x{i}" for i in range(8)}]


def test_alignment_against_brute_force(spark):
    """Few values, equal columns, columns beyond the expected ones, and every mapping tried."""
    rng = random.Random(12)
    seen = set()
    for case in range(14):
        n, width, extra = rng.randint(1, 5), rng.randint(1, 4), rng.randint(0, 1)
        rows = [tuple(rng.randint(0, 1 + case % 2) for _ in range(width)) for _ in range(n)]
        if case % 3 == 0:
            rows = [(*r[:-1], r[0]) for r in rows]
        order = rng.sample(range(width), width)
        other = [[r[i] for i in order] + [rng.randint(0, 1) for _ in range(extra)] for r in rng.sample(rows, n)]
        if case % 2:
            other[0][0], other[-1][0] = other[-1][0], other[0][0]
        want = any(sorted(tuple(r[i] for i in p) for r in other) == sorted(rows) for p in itertools.permutations(range(width + extra), width))
        a = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(width)))
        b = spark.createDataFrame([tuple(r) for r in other], ", ".join(f"x{i} int" for i in range(width + extra)))
        assert C.compare_results(a, b, C.Comparison()) is want, (rows, other)
        seen.add(want)
    assert seen == {True, False}


def test_symmetric_columns_are_parted_by_trial(spark):
    """Each column is the other's mirror, so digests of columns never differ; the ranked column may be either."""
    rows = [(0, 1, 5.0, 5.0), (1, 0, 5.0, 5.0), (2, 2, 1.0, 1.0)]
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, u int, v int, t double, w double")
    b = a.select("place", F.col("v").alias("p"), F.col("w").alias("q"), F.col("u").alias("r"), F.col("t").alias("s"))
    assert C.compare_results(a, b, C.Comparison.of({"mode": "ranked", "value_columns": ["t"]}), rank="place")
    firsts = [m["t"] for m in C.column_assignments(a.drop("place"), b.drop("place"), ["u", "v", "t", "w"], C.Comparison(), first="t")]
    assert sorted(firsts) == ["q", "s"]
    broken = b.withColumn("s", F.when(F.col("place") == 0, 1.0).when(F.col("place") == 2, 5.0).otherwise(F.col("s")))
    assert not C.compare_results(a, broken, C.Comparison.of({"mode": "ranked", "value_columns": ["t"]}), rank="place")


def test_strict(spark):
    a = frame(spark, GOLD)
    assert C.strict_equal(a, a.select(F.col("total").alias("TOTAL"), F.col("name").alias("Name"))).first()["rows_match"]
    assert not C.strict_equal(a, a.withColumnRenamed("total", "sum")).first()["rows_match"]


def test_spec_defaults():
    spec = C.Comparison.of({"mode": "odd", "order": "up", "tolerance": "2"})
    assert (spec.mode, spec.order, spec.tolerance, spec.decimals) == ("rowset", "desc", 2.0, 2)


def failures(df, **checks):
    return [(r.code, r.column, r.actual) for r in check_failures(df, SignalChecks(**checks)).collect()]


def test_signal_checks(spark):
    df = frame(spark, [("a", 0.0), (None, 0.0)])
    assert failures(df, require_nonzero_columns=("total",)) == [("require_nonzero_columns", "total", 0)]
    assert failures(df, require_nonnull_columns=("name",)) == [("require_nonnull_columns", "name", 1)]
    assert failures(df, min_distinct_counts={"name": 2}) == [("min_distinct_counts", "name", 1)]
    assert failures(df, min_row_count=3) == [("min_row_count", None, 2)]
    assert failures(df.limit(0), require_nonnull_columns=("name",)) == [("empty_result_set", None, 0)]
    assert failures(df.limit(0), min_row_count=1, require_nonnull_columns=("name",)) == [("min_row_count", None, 0)]
    text = frame(spark, [("a", "0.00"), ("b", "7")], "name string, total string")
    assert failures(text, require_nonzero_columns=("total",)) == []


def test_verify_results(spark):
    df = frame(spark, GOLD)
    rows = verify_results([("ok", df, 3, SignalChecks(1)), ("short", df, 4, SignalChecks(1))]).collect()
    assert [(r.case_id, r.passed) for r in rows] == [("ok", True), ("short", False)]
