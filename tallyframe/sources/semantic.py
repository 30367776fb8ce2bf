"""Semantic layer: entities, metrics, filter hints, aliases, join paths, rules.

The layer is configuration, read on the driver. Its synonyms become a table that texts are joined with, so their number
has no limit there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

@dataclass(frozen=True)
class Entry:
    """An entity or a metric."""

    name: str
    synonyms: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    display: tuple[str, ...] = ()
    default_filters: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    counts: bool = False


@dataclass(frozen=True)
class FilterHint:
    name: str
    synonyms: tuple[str, ...]
    target_table: str
    target_columns: tuple[str, ...] = ()
    operator: str = "OR_LIKE"


@dataclass(frozen=True)
class Alias:
    entity: str
    canonical: str
    aliases: tuple[str, ...]
    target_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinPath:
    name: str
    tables: tuple[str, ...]
    join_sql: str = ""


@dataclass(frozen=True)
class CatalogueTable:
    name: str
    aliases: tuple[str, ...] = ()
    description: str = ""
    columns: tuple[str, ...] = ()
    comments: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalogue:
    tables: tuple[CatalogueTable, ...]
    edges: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SemanticLayer:
    entities: tuple[Entry, ...] = ()
    metrics: tuple[Entry, ...] = ()
    filters: tuple[FilterHint, ...] = ()
    aliases: tuple[Alias, ...] = ()
    paths: tuple[JoinPath, ...] = ()
    rules: tuple[tuple[str, tuple[str, ...]], ...] = ()
    product_entities: tuple[str, ...] = field(default=())
    product_tables: tuple[str, ...] = field(default=())
    general_metric: str | None = None
    line_metric: str | None = None

    @property
    def entities_frame_rows(self) -> list[tuple]:
        return [(e.name, list(e.synonyms), list(e.tables), list(e.display), list(e.default_filters)) for e in self.entities]


def unique(values: Iterable | None) -> tuple[str, ...]:
    """Trimmed, non-empty, distinct strings in order."""
    return tuple(dict.fromkeys(t for t in (str(v).strip() for v in values or ()) if t))


def read_layer(path: str, **roles) -> SemanticLayer:
    """Read a semantic-layer JSON file; unnamed items are dropped."""
    with open(path, encoding="utf-8") as handle:
        return layer_from(json.load(handle), **roles)


def read_layer_at(spark: SparkSession, path: str, **roles) -> SemanticLayer:
    """Read a semantic-layer JSON file, of a size that one row holds, from any store that Spark reads."""
    return layer_from(json.loads(spark.read.text(path, wholetext=True).first()[0]), **roles)


def layer_from(raw: dict, **roles) -> SemanticLayer:
    def named(key: str) -> list[dict]:
        items = raw.get(key)
        return [i for i in items if isinstance(i, dict) and str(i.get("name") or "").strip()] if isinstance(items, list) else []

    def entry(i: dict) -> Entry:
        return Entry(
            str(i["name"]).strip(), unique(i.get("synonyms")), unique(i.get("preferred_tables")),
            unique(i.get("display_columns")), unique(i.get("default_filters")), unique(i.get("preferred_columns")),
            str(i.get("preferred_expression") or "").strip().upper().startswith("COUNT"),
        )

    return SemanticLayer(
        entities=tuple(entry(i) for i in named("entities")),
        metrics=tuple(entry(i) for i in named("metrics")),
        filters=tuple(
            FilterHint(str(i["name"]).strip(), unique(i.get("synonyms")), str(i.get("target_table") or ""),
                       unique(i.get("target_columns")), str(i.get("operator") or "OR_LIKE"))
            for i in named("filter_hints")
        ),
        aliases=tuple(
            Alias(str(a.get("entity") or ""), str(a["canonical_value"]).strip(), unique(a.get("aliases")),
                  unique(a.get("target_columns")))
            for a in raw.get("value_aliases") or []
            if isinstance(a, dict) and str(a.get("canonical_value") or "").strip()
        ),
        paths=tuple(JoinPath(str(i["name"]).strip(), unique(i.get("tables")), str(i.get("join_sql") or "")) for i in named("join_paths")),
        rules=tuple(
            (str(r.get("trigger") or "").strip(), unique(r.get("questions")))
            for r in raw.get("clarification_rules") or []
            if isinstance(r, dict) and str(r.get("trigger") or "").strip() and unique(r.get("questions"))
        ),
        **roles,
    )


def layer_frames(spark: SparkSession, layer: SemanticLayer) -> dict[str, DataFrame]:
    """The six relations of the layer as DataFrames."""
    strings = "array<string>"
    return {
        "entities": spark.createDataFrame(
            layer.entities_frame_rows,
            f"name string, synonyms {strings}, tables {strings}, display_columns {strings}, default_filters {strings}",
        ),
        "metrics": spark.createDataFrame(
            [(m.name, list(m.synonyms), list(m.tables), list(m.columns), m.counts) for m in layer.metrics],
            f"name string, synonyms {strings}, tables {strings}, columns {strings}, counts boolean",
        ),
        "filter_hints": spark.createDataFrame(
            [(f.name, list(f.synonyms), f.target_table, list(f.target_columns), f.operator) for f in layer.filters],
            f"name string, synonyms {strings}, target_table string, target_columns {strings}, operator string",
        ),
        "value_aliases": spark.createDataFrame(
            [(a.entity, a.canonical, list(a.aliases)) for a in layer.aliases],
            f"entity string, canonical_value string, aliases {strings}",
        ),
        "join_paths": spark.createDataFrame(
            [(p.name, list(p.tables), p.join_sql) for p in layer.paths], f"name string, tables {strings}, join_sql string"
        ),
        "clarification_rules": spark.createDataFrame(
            [(t, list(q)) for t, q in layer.rules], f"trigger string, questions {strings}"
        ),
    }
