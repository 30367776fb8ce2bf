"""Parametric metrics over a star schema.

A model is a set of named DataFrames plus plain declarations: which fact a metric
sums, how a fact reaches its header, and which chain of foreign keys leads to a
dimension. ``metric`` turns these into one DataFrame. The fact is summed by its own
foreign key *before* any dimension is attached, so a dimension join never sees more
than one row per key, and a hot key is already folded map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import rounded


@dataclass(frozen=True)
class Hop:
    """One foreign key: column on the near side, table, key on the far side."""

    column: str
    table: str
    key: str


@dataclass(frozen=True)
class Dimension:
    key: str
    display: tuple[str, ...]
    # fact table -> hops from that fact to the table that holds key and display
    routes: Mapping[str, tuple[Hop, ...]]
    search: tuple[str, ...] = ()
    how: str = "inner"


@dataclass(frozen=True)
class Measure:
    alias: str
    column: str | None = None  # None counts rows
    decimals: int = 2


@dataclass(frozen=True)
class Metric:
    fact: str
    measures: tuple[Measure, ...]
    dated_by: str = "DocumentDate"


@dataclass(frozen=True)
class StarModel:
    tables: Mapping[str, DataFrame]
    metrics: Mapping[str, Metric]
    dimensions: Mapping[str, Dimension]
    header: str = "SalesDocument"
    header_key: str = "SalesDocumentId"
    cancelled: str | None = "IsCanceled"
    grains: Mapping[str, str] = field(default_factory=dict)  # header metric -> line metric
    line_dimensions: frozenset[str] = frozenset()


Period = tuple[str, str]


def month(text: str) -> Period:
    """('1997-03') -> half-open month range."""
    year, number = (int(p) for p in text.split("-"))
    after = (year + number // 12, number % 12 + 1)
    return f"{year:04d}-{number:02d}-01", f"{after[0]:04d}-{after[1]:02d}-01"


def in_period(column: str | Column, period: Period) -> Column:
    """Half-open range on the bare column, so that it reaches the scan."""
    column = F.col(column) if isinstance(column, str) else column
    return (column >= F.lit(period[0]).cast("timestamp_ntz")) & (column < F.lit(period[1]).cast("timestamp_ntz"))


def contains_any(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Case-insensitive contains over every column and term, joined by OR."""
    literal = [t.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") for t in terms]
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{t}%") for c in columns for t in literal])


def live_headers(model: StarModel, period: Period | None = None, dated_by: str = "DocumentDate") -> DataFrame:
    header = model.tables[model.header]
    if model.cancelled:
        header = header.filter(F.coalesce(F.col(model.cancelled), F.lit(0)) == 0)
    if period:
        header = header.filter(in_period(dated_by, period))
    return header


def fact_rows(model: StarModel, fact: str, period: Period | None = None, dated_by: str = "DocumentDate") -> DataFrame:
    """Rows of a fact that belong to live documents (of the period)."""
    if fact == model.header:
        return live_headers(model, period, dated_by)
    keep = [model.header_key] + ([dated_by] if dated_by not in model.tables[fact].columns else [])
    headers = live_headers(model, period, dated_by).select(*keep)
    return model.tables[fact].join(headers, model.header_key)


def metric_for(model: StarModel, name: str, dimension: str | None) -> str:
    """The line-level metric replaces the header one when a product dimension is in play."""
    return model.grains.get(name, name) if dimension in model.line_dimensions else name


def metric(
    model: StarModel,
    name: str,
    by: str | None = None,
    period: Period | None = None,
    periods_as_columns: Mapping[str, Period] | None = None,
    where: Mapping[str, Sequence[str]] | None = None,
    row_filter: Column | str | None = None,
    top: int | None = None,
    live_only: bool = True,
    dated_by: str | None = None,
    order_by_name: bool = False,
) -> DataFrame:
    """A metric, optionally by a dimension, in a period, for named entities, cut to a top list.

    ``where`` maps a dimension to search terms. ``periods_as_columns`` maps an output
    column to a period and yields one column per period (0 where there is nothing).
    """
    where = dict(where or {})
    name = metric_for(model, name, by)
    for dimension in where:
        name = metric_for(model, name, dimension)
    spec = model.metrics[name]
    dated_by = dated_by or spec.dated_by
    if periods_as_columns:
        period = (min(p[0] for p in periods_as_columns.values()), max(p[1] for p in periods_as_columns.values()))

    rows = fact_rows(model, spec.fact, period, dated_by) if live_only else model.tables[spec.fact]
    if row_filter is not None:
        rows = rows.filter(row_filter)

    sums: list[tuple[str, Column, int]] = []
    for m in spec.measures:
        value = F.coalesce(F.col(m.column), F.lit(0)) if m.column else F.lit(1)
        if periods_as_columns:
            for alias, span in periods_as_columns.items():
                sums.append((alias, F.sum(F.when(in_period(dated_by, span), value).otherwise(0)), m.decimals))
        else:
            sums.append((m.alias, F.sum(value), m.decimals))
    if periods_as_columns and len(periods_as_columns) > 1:
        rows = rows.filter(reduce(lambda a, b: a | b, [in_period(dated_by, p) for p in periods_as_columns.values()]))

    wanted = ([by] if by else []) + [d for d in where if d != by]
    first_keys = list(dict.fromkeys(c for d in wanted for c in _fact_columns(model.dimensions[d], spec.fact)))
    summed = rows.groupBy(*first_keys).agg(*[s.alias(alias) for alias, s, _ in sums])
    for d in wanted:
        summed = _attach(model, summed, d, spec.fact, where.get(d))

    if by:
        dim = model.dimensions[by]
        keys = list(dict.fromkeys([f"{by}__key", *dim.display]))
        # one row per key already, when the fact refers to the dimension's own primary key
        if not (len(wanted) == 1 and _is_own_key(dim, spec.fact)):
            summed = summed.groupBy(*keys).agg(*[F.sum(a).alias(a) for a, _, _ in sums])
    elif wanted:
        summed = summed.agg(*[F.sum(a).alias(a) for a, _, _ in sums])
    display = list(model.dimensions[by].display) if by else []
    if by:
        names = [F.col(c).asc_nulls_first() for c in display]
        order = names if order_by_name else [F.col(sums[0][0]).desc_nulls_last(), *names]
        summed = summed.orderBy(*order)
        if top:
            summed = summed.limit(top)
    counts = {m.alias for m in spec.measures if m.column is None}
    return summed.select(
        *display,
        *[
            (F.col(a).cast("bigint") if a in counts else rounded(F.col(a), d)).alias(a)
            for a, _, d in sums
        ],
    )


def _is_own_key(dim: Dimension, fact: str) -> bool:
    """Does one foreign key of the fact name exactly one member of the dimension?"""
    hops = dim.routes[fact]
    return dim.how == "inner" and len(hops) == 1 and hops[0].key == dim.key


def _fact_columns(dim: Dimension, fact: str) -> tuple[str, ...]:
    """Columns of the fact that stand for the dimension before it is attached."""
    hops = dim.routes[fact]
    return (hops[0].column,) if hops else tuple(dict.fromkeys((dim.key, *dim.display, *dim.search)))


def _attach(model: StarModel, summed: DataFrame, name: str, fact: str, terms: Sequence[str] | None) -> DataFrame:
    dim = model.dimensions[name]
    hops = dim.routes[fact]
    if not hops:  # the dimension is a column of the fact itself
        kept = summed.filter(contains_any(dim.search or dim.display, terms)) if terms else summed
        return kept.withColumn(f"{name}__key", F.col(dim.key))
    for i, hop in enumerate(hops):
        far = model.tables[hop.table]
        last = i == len(hops) - 1
        needed = [hop.key] + ([dim.key, *dim.display, *dim.search] if last else [hops[i + 1].column])
        far = far.select(*dict.fromkeys(needed))
        if last and terms:
            far = far.filter(contains_any(dim.search or dim.display, terms))
        near_name, far_name = hop.column, f"{name}__{i}"
        far = far.select(
            F.col(hop.key).alias(far_name),
            *([F.col(dim.key).alias(f"{name}__key")] if last else []),
            *[F.col(c) for c in dict.fromkeys(needed[1:]) if not last or (c in dim.display)],
        )
        summed = summed.join(far, F.col(near_name) == F.col(far_name), dim.how).drop(far_name)
    return summed


def sold_in(model: StarModel, period: Period, fact: str = "SalesDocumentLine", key: str = "ProductId") -> DataFrame:
    return fact_rows(model, fact, period).filter(F.col(key).isNotNull()).select(key).distinct()


def sold_not_in(model: StarModel, period: Period, other: Period) -> DataFrame:
    """Number of products sold in one period and not in another."""
    gone = sold_in(model, period).join(sold_in(model, other), "ProductId", "left_anti")
    return gone.agg(F.count("*").alias("product_count"))


def without_related(model: StarModel, related: DataFrame, key: str | None = None) -> DataFrame:
    """Number of live documents that no row of ``related`` refers to."""
    key = key or model.header_key
    return (
        live_headers(model).select(key).join(related.select(key), key, "left_anti").agg(F.count("*").alias("document_count"))
    )


def products_sold_matching(model: StarModel, period: Period, columns_terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct names of sold products whose name or tags contain one of the terms."""
    matches = reduce(lambda a, b: a | b, [contains_any([c], t) for c, t in columns_terms.items()])
    products = model.tables["Product"].filter(matches).select("ProductId", "ProductName")
    return (
        sold_in(model, period).join(products, "ProductId").select("ProductName").distinct().orderBy("ProductName")
    )


def monthly_trend(
    model: StarModel, name: str, terms: Sequence[str] | None = None, dimension: str = "product"
) -> DataFrame:
    """A metric per calendar month, optionally for named products only."""
    name = metric_for(model, name, dimension if terms else None)
    spec = model.metrics[name]
    rows = fact_rows(model, spec.fact, None, spec.dated_by)
    dim = model.dimensions[dimension]
    month_start = F.trunc(F.col(spec.dated_by).cast("date"), "month").alias("month_start")
    m = spec.measures[0]
    value = F.sum(F.coalesce(F.col(m.column), F.lit(0))) if m.column else F.count("*")
    keys = list(_fact_columns(dim, spec.fact)) if terms else []
    summed = rows.groupBy(*keys, month_start).agg(value.alias(m.alias))
    if terms:
        summed = _attach(model, summed, dimension, spec.fact, terms)
        summed = summed.groupBy("month_start").agg(F.sum(m.alias).alias(m.alias))
    return summed.orderBy("month_start").select("month_start", rounded(F.col(m.alias), m.decimals).alias(m.alias))
