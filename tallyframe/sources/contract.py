"""Column contracts, orphan audits and content signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.retail_schema import Reference, primary_key


def contract_violations(
    df: DataFrame, not_null: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None,
    lengths: Mapping[str, int] | None = None,
) -> DataFrame:
    """Broken column rules with the number of rows that break them: one pass, no shuffle of rows."""
    rules = [("not_null", c, F.col(c).isNull()) for c in not_null]
    rules += [("domain", c, F.col(c).isNotNull() & ~F.col(c).isin(*values)) for c, values in (domains or {}).items()]
    rules += [("length", c, F.length(c) > n) for c, n in (lengths or {}).items()]
    if not rules:
        return df.sparkSession.createDataFrame([], "rule string, column string, rows bigint")
    one = df.agg(*[F.count_if(broken).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), F.col(f"r{i}").alias("rows"))
                     for i, (rule, c, _) in enumerate(rules)])
    return one.select(F.inline(rows)).filter("rows > 0")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (nulls do not count)."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.filter(present).groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def schema_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Not-null, key and unique rules of a declared schema."""
    broken = contract_violations(df, [f.name for f in schema.fields if not f.nullable])
    parts = [broken]
    keys = [primary_key(schema), *[[f.name] for f in schema.fields if f.metadata.get("unique") and not f.metadata.get("pk")]]
    for key in [k for k in keys if k]:
        found = duplicate_keys(df, key).agg(F.count("*").alias("rows")).filter("rows > 0")
        parts.append(found.select(F.lit("unique").alias("rule"), F.lit(",".join(key)).alias("column"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def orphans(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """Foreign-key values without a parent, counted per reference.

    Each child is folded to its distinct key values first, so a value that a third of the
    rows share takes part in the join once.
    """
    parts = []
    for r in references:
        values = tables[r.table].filter(F.col(r.column).isNotNull()).groupBy(F.col(r.column).alias("__v")).agg(F.count("*").alias("n"))
        parents = tables[r.to_table].select(F.col(r.to_column).alias("__v"))
        lost = values.join(parents, "__v", "left_anti").agg(
            F.count("*").alias("orphan_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
        parts.append(lost.select(F.lit(f"{r.table}.{r.column}").alias("reference"), "orphan_values", "orphan_rows"))
    return reduce(DataFrame.unionByName, parts)


def split_references(edges: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References whose target is in the registry, and those whose target is missing."""
    known = tables.select(F.col("table").alias("to_table"))
    return edges.join(known, "to_table", "left_semi"), edges.join(known, "to_table", "left_anti")


def files_signature(files: DataFrame) -> DataFrame:
    """One hash over (path, value) pairs in any order: the sums of the parts of one hash per file, folded map-side."""
    text = F.concat(F.coalesce("path", F.lit("")), F.lit("\u0000"), F.coalesce("value", F.lit("\u0001")), F.lit("\u0000"))
    each = files.select(F.sha2(text, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return each.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("signature"))


def table_signature(df: DataFrame) -> DataFrame:
    """Order-free signature of a table: rows, sum and xor of row hashes, folded map-side.

    The hash skips nulls, so each column is preceded by a flag that says whether it is one.
    """
    h = F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    return df.select(h.alias("h")).agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


def is_stale(known: str | None, current: str | None) -> bool:
    """A stored signature is stale when it differs; without a current one it is trusted."""
    return current is not None and known != current
