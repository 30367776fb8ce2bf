"""Value-aware comparison of two tables."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbers import cell_key, is_numeric_type, numeric_value, round_half_up
from tallyframe.operators.align import Colouring, alignments
from tallyframe.operators.pairing import unpaired_keys

SLACK = 1e-6


@dataclass(frozen=True)
class Comparison:
    mode: str = "rowset"  # rowset, scalar or ranked
    order: str = "desc"
    decimals: int = 2
    tolerance: float = 0.0
    compare_columns: tuple[str, ...] = ()
    value_columns: tuple[str, ...] = ()

    @classmethod
    def of(cls, raw: Mapping | None) -> Comparison:
        """Fill defaults; unknown modes and orders fall back."""
        raw = raw or {}
        mode = raw.get("mode")
        decimals = raw.get("decimals")
        return cls(
            mode if mode in ("rowset", "scalar", "ranked") else "rowset",
            "asc" if raw.get("order") == "asc" else "desc",
            decimals if isinstance(decimals, int) else 2,
            float(raw.get("tolerance") or 0),
            tuple(raw.get("compare_columns") or ()),
            tuple(raw.get("value_columns") or ()),
        )


def _keys(df: DataFrame, columns: Sequence[str], decimals: int) -> list[Column]:
    return [cell_key(F.col(f"`{c}`"), df.schema[c].dataType, decimals).alias(f"k{i}") for i, c in enumerate(columns)]


def _difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with the surplus on the left (negative: on the right).

    Both sides are folded in one aggregate, so a row that occurs very often is counted
    map-side and shuffled once.
    """
    names = left.columns
    both = left.withColumn("__n", F.lit(1)).unionByName(right.withColumn("__n", F.lit(-1)))
    return both.groupBy(*names).agg(F.sum("__n").alias("surplus")).filter("surplus <> 0")


def difference_rows(
    expected: DataFrame, actual: DataFrame, columns: Sequence[str], mapping: Mapping[str, str] | None = None, decimals: int = 2
) -> DataFrame:
    """Compared rows that are missing on one side: cell keys, side, and how many."""
    right = [(mapping or {}).get(c, c) for c in columns]
    diff = _difference(
        expected.select(*_keys(expected, columns, decimals)), actual.select(*_keys(actual, right, decimals))
    )
    return diff.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)],
        F.when(F.col("surplus") > 0, "expected_only").otherwise("actual_only").alias("side"),
        F.abs("surplus").alias("rows"),
    )


def rowset_equal(expected: DataFrame, actual: DataFrame, columns: Sequence[str], mapping=None, decimals: int = 2) -> DataFrame:
    """One row: do the compared tuples match one to one, whatever their order?"""
    return difference_rows(expected, actual, columns, mapping, decimals).agg(
        (F.count("*") == 0).alias("rows_match"),
        F.coalesce(F.sum(F.when(F.col("side") == "expected_only", F.col("rows"))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.when(F.col("side") == "actual_only", F.col("rows"))), F.lit(0)).alias("extra_rows"),
    )


def strict_equal(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: same column names ignoring case, and the same rows with numbers at three decimals."""
    def normal(df: DataFrame) -> DataFrame:
        return df.select(*[
            (round_half_up(F.col(f"`{f.name}`").cast("double"), 3).cast("string") if is_numeric_type(f.dataType)
             else F.col(f"`{f.name}`").cast("string")).alias(f.name.lower())
            for f in sorted(df.schema.fields, key=lambda f: f.name.lower())
        ])

    left, right = normal(expected), normal(actual)
    if left.columns != right.columns:
        return expected.sparkSession.createDataFrame([(False,)], "rows_match boolean")
    return _difference(left, right).agg((F.count("*") == 0).alias("rows_match"))


def column_digests(df: DataFrame, decimals: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free digest of the values of each column: count, hash sum and hash xor, in one pass."""
    columns = list(columns or df.columns)
    hashed = df.select(*[F.xxhash64(k).alias(f"h{i}") for i, k in enumerate(_keys(df, columns, decimals))])
    one = hashed.agg(*[
        F.struct(F.count("*").alias("rows"), F.sum(F.col(f"h{i}").cast("decimal(20,0)")).alias("hash_sum"),
                 F.bit_xor(f"h{i}").alias("hash_xor")).alias(f"d{i}")
        for i in range(len(columns))
    ])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d{i}.rows"), F.col(f"d{i}.hash_sum"), F.col(f"d{i}.hash_xor"))
                     for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


_FACTS = ("sum", "xor", "numbers", "other", "nulls", "low", "high")


def _facts_row(df: DataFrame, decimals: int) -> DataFrame:
    wanted = [F.count("*").alias("rows")]
    for i, (f, key) in enumerate(zip(df.schema.fields, _keys(df, df.columns, decimals))):
        h, v, c = F.xxhash64(key), numeric_value(F.col(f"`{f.name}`"), f.dataType), F.col(f"`{f.name}`")
        wanted += [
            F.sum(h.cast("decimal(20,0)")).alias(f"sum{i}"), F.bit_xor(h).alias(f"xor{i}"), F.count(v).alias(f"numbers{i}"),
            F.count_if(c.isNotNull() & v.isNull()).alias(f"other{i}"), F.count_if(c.isNull()).alias(f"nulls{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}")]
    return df.agg(*wanted).select("rows", F.array(*[F.struct(*[F.col(f"{k}{i}").alias(k) for k in _FACTS]) for i in range(len(df.columns))]).alias("facts"))


def column_facts(*tables: DataFrame, decimals: int = 2) -> list[tuple[int, dict[str, dict]]]:
    """For each table its rows, and of each column its digest, numbers, other values, nulls and range: one aggregate a table, all in
    one job, and one row of each for the driver."""
    rows = [_facts_row(df, decimals).withColumn("at", F.lit(i)) for i, df in enumerate(tables)]
    found = {r["at"]: r for r in functools.reduce(DataFrame.union, rows).collect()}
    return [
        (found[i]["rows"], {f.name: fact.asDict() | {"typed": is_numeric_type(f.dataType)} for f, fact in zip(df.schema.fields, found[i]["facts"])})
        for i, df in enumerate(tables)]


def _is_number(fact: dict) -> bool:
    """A column of numbers: by its type, or because its text holds some numbers and nothing else."""
    return fact["typed"] or fact["numbers"] > 0 and fact["other"] == 0


def near_columns(expected: DataFrame, actual: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float) -> set[tuple[str, str]]:
    """The (expected, actual) pairs whose values can be paired within the tolerance, each by itself: one pass for all of them."""
    if not pairs:
        return set()

    def long(df: DataFrame, side: int) -> DataFrame:
        cells = [F.struct(F.lit(n).cast("string").alias("pair"), numeric_value(F.col(f"`{p[side]}`"), df.schema[p[side]].dataType).alias("v")) for n, p in enumerate(pairs)]
        return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")

    far = tolerance_violations(long(expected, 0), long(actual, 1), ["pair"], "v", tolerance)
    broken = {r[0] for r in far.select(F.get(F.from_json("key", "array<string>"), F.lit(0))).collect()}  # a row a pair at most
    # a key of digits counts as a number
    return {p for n, p in enumerate(pairs) if not {f"n:{float(n)}", f"s:{n}"} & broken}


def column_assignments(
    expected: DataFrame, actual: DataFrame, columns: Sequence[str], spec: Comparison, facts: tuple[dict, dict] | None = None, first: str | None = None,
) -> Iterator[dict[str, str]]:
    """Injective mappings of expected to actual columns that have the same values, or numbers within the tolerance.

    Without a tolerance, partition refinement gives mappings under which the rows agree (`align.alignments`), one for each column
    that `first` can stand for. Under a tolerance a number column may stand for another if counts, ranges and then, where several
    are left, the sorted values agree, which one pass decides for all pairs; every other column has to have the same digest.
    """
    if facts is None:
        (_, left), (_, right) = column_facts(expected.select(*[f"`{c}`" for c in columns]), actual, decimals=spec.decimals)
    else:
        left, right = facts
    if spec.tolerance <= 0:
        signs = [{c: (str(f["sum"]), f["xor"]) for c, f in side.items()} for side in (left, right)]
        yield from alignments(expected.select(*[f"`{c}`" for c in columns]), actual, Colouring.of(*signs), spec.decimals, first)
        return
    same = lambda c, a: (left[c]["sum"], left[c]["xor"]) == (right[a]["sum"], right[a]["xor"])
    bound = spec.tolerance + 1e-9

    def close(c: str, a: str) -> bool:
        x, y = left[c], right[a]
        if (x["numbers"], x["nulls"], x["other"]) != (y["numbers"], y["nulls"], y["other"]):
            return False
        return not x["numbers"] or abs(x["low"] - y["low"]) <= bound and abs(x["high"] - y["high"]) <= bound

    maybe = [(c, a) for c in columns if _is_number(left[c]) for a in actual.columns if close(c, a)]
    several = len({c for c, _ in maybe}) < len(maybe)  # else the check of the one assignment decides anyway
    near = near_columns(expected, actual, maybe, spec.tolerance) if several else set(maybe)
    options = {c: [a for a in actual.columns if ((c, a) in near if _is_number(left[c]) else same(c, a))] for c in columns}

    def choose(i: int, used: tuple[str, ...]) -> Iterator[dict[str, str]]:
        if i == len(columns):
            yield dict(zip(columns, used))
            return
        # a column of the same name is tried first
        for a in sorted(options[columns[i]], key=lambda n: n != columns[i]):
            if a not in used:
                yield from choose(i + 1, (*used, a))

    yield from choose(0, ())


def _ordered_batches(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def ranking_violations(actual: DataFrame, rank: str, value: str, order: str = "desc", tolerance: float = 0.0) -> DataFrame:
    """One row: how many values break the declared order along ``rank``. Nulls are skipped.

    The table is range-partitioned by rank; each partition reports its first and last value and
    its own breaks in one row, and only these rows, as many as partitions, are put in one sequence.
    """
    slack = tolerance if tolerance > 0 else SLACK
    sign = 1.0 if order == "asc" else -1.0
    rows = actual.select(
        F.col(rank).cast("double").alias("r"), (F.lit(sign) * numeric_value(F.col(value), actual.schema[value].dataType)).alias("v")
    ).filter("v IS NOT NULL")

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = first = last = None
        breaks = 0
        for b in batches:
            if len(b):
                v = b["v"].to_numpy()
                if last is None:
                    start, first = b["r"].iloc[0], v[0]
                else:
                    breaks += int(v[0] < last - slack)
                breaks += int((v[1:] < v[:-1] - slack).sum())
                last = v[-1]
        if last is not None:
            yield pd.DataFrame({"r": [start], "first": [first], "last": [last], "breaks": [breaks]})

    reports = _ordered_batches(rows, ["r"]).mapInPandas(report, "r double, first double, last double, breaks bigint")
    before = F.lag("last").over(W.orderBy("r"))
    seam = F.when(F.col("first") < before - slack, 1).otherwise(0)
    return reports.select("breaks", seam.alias("seam")).agg(
        F.coalesce(F.sum(F.col("breaks") + F.col("seam")), F.lit(0)).alias("violations")
    )


def tolerance_violations(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float,
    mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per exact key whose numbers cannot be paired within the tolerance.

    On one number the best pairing is in sorted order, so it exists exactly when at every
    point no more values of one side lie at or below x than of the other at or below
    x + tolerance. Equal values are folded first; the prefix sums are taken over ranges of
    (key, value), so a hot key spreads over many tasks and each sends one summary of it.
    """
    mapping = mapping or {}
    bound = tolerance + 1e-9

    def side(df: DataFrame, cols: Sequence[str], v: str, name: str) -> DataFrame:
        number = numeric_value(F.col(f"`{v}`"), df.schema[v].dataType)
        key = F.to_json(F.array(*_keys(df, cols, 2))) if cols else F.lit("")
        return df.select(key.alias("key"), number.alias("v"), F.lit(name).alias("side")).groupBy("key", "v", "side").agg(
            F.count("*").alias("n"))

    left = side(expected, keys, value, "e")
    right = side(actual, [mapping.get(k, k) for k in keys], mapping.get(value, value), "a")
    both = left.unionByName(right)
    signed = F.when(F.col("side") == "e", F.col("n")).otherwise(-F.col("n"))
    counts = both.groupBy("key").agg(
        F.sum(signed).alias("surplus"), F.sum(F.when(F.col("v").isNull(), signed).otherwise(0)).alias("null_surplus"))
    uneven = counts.filter("surplus <> 0 OR null_surplus <> 0").select("key")

    # test "e": expected values are demands moved up by the bound, actual values are supply; test "a": the reverse
    events = both.filter("v IS NOT NULL").select(
        "key", F.explode(F.array(*[
            F.struct(
                F.lit(test).alias("test"),
                F.when(F.col("side") == test, F.col("v") + bound).otherwise(F.col("v")).alias("at"),
                F.when(F.col("side") == test, 1).otherwise(0).alias("demand"),
                F.when(F.col("side") == test, -F.col("n")).otherwise(F.col("n")).alias("step"),
            )
            for test in ("e", "a")
        ])).alias("x")
    ).select("key", "x.*")

    none = 2**62

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each key and test in the partition: its sum, and the lowest sum reached at a demand."""
        part, held = TaskContext.get().partitionId(), None
        columns = ["key", "test", "total", "low"]
        for b in batches:
            if not len(b):
                continue
            grouped = b.groupby(["key", "test"], sort=False)
            low = grouped["step"].cumsum().where(b["demand"] == 1, none)
            out = b.assign(low=low).groupby(["key", "test"], sort=False).agg(total=("step", "sum"), low=("low", "min")).reset_index()[columns]
            if held is not None:  # sorted by key, so only the first may go on from the batch before
                key, test, total, lowest = held
                if (out.at[0, "key"], out.at[0, "test"]) == (key, test):
                    here = out.at[0, "low"]
                    out.loc[0, ["total", "low"]] = [total + out.at[0, "total"], min(lowest, none if here >= none else total + here)]
                else:
                    yield pd.DataFrame([held], columns=columns).assign(part=part)[["key", "test", "part", "total", "low"]]
            held = tuple(out.iloc[-1])
            if len(out) > 1:
                yield out.iloc[:-1].assign(part=part)[["key", "test", "part", "total", "low"]]
        if held is not None:
            yield pd.DataFrame([held], columns=columns).assign(part=part)[["key", "test", "part", "total", "low"]]

    laid = _ordered_batches(events, ["key", "test", "at", "demand"])
    reports = laid.mapInPandas(summarise, "key string, test string, part int, total bigint, low bigint")
    before = F.coalesce(F.sum("total").over(W.partitionBy("key", "test").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    short = reports.withColumn("before", before).filter((F.col("low") < 2**62) & (F.col("before") + F.col("low") < 0)).select("key")
    return uneven.union(short).distinct()


def multi_tolerance_violations(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float,
    mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact keys whose rows cannot be paired with every number within the tolerance (`pairing.unpaired_keys`)."""
    mapping = mapping or {}

    def side(df: DataFrame, number: int, rename) -> DataFrame:
        key = F.to_json(F.array(*_keys(df, [rename(k) for k in keys], 2))) if keys else F.lit("")
        numbers = [numeric_value(F.col(f"`{rename(v)}`"), df.schema[rename(v)].dataType).alias(f"v{i}") for i, v in enumerate(values)]
        return df.select(key.alias("key"), F.lit(number).alias("side"), *numbers)

    rows = side(expected, 0, lambda c: c).union(side(actual, 1, lambda c: mapping.get(c, c)))
    return unpaired_keys(rows, [f"v{i}" for i in range(len(values))], tolerance + 1e-9)


def compare_results(expected: DataFrame, actual: DataFrame, spec: Comparison, rank: str | None = None) -> bool:
    """Do two results agree by value? Column names, row order and extra columns do not matter.

    Only one row of facts a side and verdicts reach the driver. Without a tolerance a few rounds of refinement align the columns
    and one exact check of the rows follows. Under a tolerance it is one pass over column pairs and a check for each assignment
    that it leaves, which is one unless columns hold the same values.
    """
    columns = list(spec.compare_columns or [c for c in expected.columns if c != rank])
    shown = actual.drop(rank) if rank else actual
    if len(shown.columns) < len(columns):
        return False
    (rows, left), (others, right) = column_facts(expected.select(*[f"`{c}`" for c in columns]), shown, decimals=spec.decimals)
    if rows != others:
        return False
    if rows == 0:
        return True
    numbers = [c for c in columns if _is_number(left[c])]
    primary = (spec.value_columns or tuple(numbers) or (None,))[0]
    ranked = spec.mode == "ranked" and primary is not None
    for mapping in column_assignments(expected, shown, columns, spec, (left, right), primary if ranked else None):
        if spec.tolerance > 0 and numbers:
            exact = [c for c in columns if c not in numbers]
            check = tolerance_violations if len(numbers) == 1 else multi_tolerance_violations
            target = numbers[0] if len(numbers) == 1 else numbers
            same = check(expected, actual, exact, target, spec.tolerance, mapping).isEmpty()
        else:
            same = difference_rows(expected, actual, columns, mapping, spec.decimals).isEmpty()
        if not same:
            continue
        if not ranked:
            return True
        if rank is None:
            raise ValueError("a ranked comparison needs the name of the rank column")
        broken = ranking_violations(actual, rank, mapping[primary], spec.order, spec.tolerance).first()["violations"]
        if broken == 0:
            return True
    return False
