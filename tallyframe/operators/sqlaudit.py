"""Audit of a log of SQL texts, statement by statement or once for each template. No parser."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import sqltext as S
from tallyframe.functions.literals import constant, let
from tallyframe.shared import written

_NONE = "cast(array() as array<string>)"
ID_LABEL = "not in the resolved master-data candidates: "


@dataclass(frozen=True)
class Registry:
    """Known tables with their columns, and the column pairs that may be joined. Configuration-sized."""

    columns: Mapping[str, Sequence[str]]
    joins: Sequence[tuple[str, str, str, str]] = ()
    metrics: Mapping[str, Sequence[str]] | None = None  # metric -> preferred columns; counting metrics are left out
    general_metric: str = "net_sales"
    line_metric: str = "line_net_sales"
    id_columns: Sequence[str] = ("ProductId",)

    @property
    def tables(self) -> list[str]:
        return list(self.columns)


def statements(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Add cleaned text, tables used and the read-only verdict (null when fine)."""
    out = log.withColumn("cleaned", S.clean_output(F.col(sql)))
    return out.select(
        "*", S.referenced_tables(F.col("cleaned")).alias("tables_used"), S.read_only_issue(F.col("cleaned")).alias("read_only_issue")
    )


def outside_tables(allowed: Column, used: Column, exempt: Column | None = None) -> Column:
    """Used tables that are not allowed. CTE names count as tables unless they are exempt."""
    extra = F.array_except(used, allowed)
    return extra if exempt is None else F.array_except(extra, exempt)


def sql_facts(log: DataFrame, registry: Registry, cleaned: str = "cleaned") -> DataFrame:
    """Add what several checks need, each computed once: stripped text, aliases, CTE and derived names."""
    staged = log.withColumn("stripped", S.strip_literals(F.col(cleaned)))
    text = F.col("stripped")
    staged = staged.select(
        "*", S.table_aliases(text).alias("named_tables"), S.cte_names(text).alias("ctes"), S.derived_aliases(text).alias("derived"))
    return staged.select("*", _resolver(F.col("named_tables"), registry).alias("aliases"), _cte_given().alias("cte_aliases"))


FACTS = ("stripped", "named_tables", "ctes", "derived", "aliases", "cte_aliases")


def _resolver(named: Column, registry: Registry) -> Column:
    """Array of (alias, table) for every known table and every alias given to one."""
    own = [{"alias": t, "table": t} for t in registry.tables]
    known = constant(registry.tables)
    given = F.filter(
        named,
        lambda p: (p["alias"] != "") & F.array_contains(known, p["table"]) & ~F.upper(p["alias"]).isin(*S.NOT_AN_ALIAS)
        & ~F.array_contains(known, p["alias"]),
    )
    return F.concat(F.transform(F.reverse(given), lambda p: F.struct(p["alias"].alias("alias"), p["table"].alias("table"))), constant(own))


def _cte_given() -> Column:
    """Aliases given to CTEs after FROM or JOIN."""
    both = F.struct(F.col("named_tables").alias("named"), F.col("ctes").alias("ctes"))
    return let(both, lambda ctx: F.transform(
        F.filter(ctx["named"], lambda p: (p["alias"] != "") & F.array_contains(ctx["ctes"], p["table"])), lambda p: p["alias"]))


def _table_of(aliases: Column, name: Column) -> Column:
    return F.get(F.filter(aliases, lambda a: a["alias"] == name), F.lit(0))["table"]


def column_issues(registry: Registry) -> Column:
    """Qualified columns whose qualifier or column is unknown (derived tables are left alone).

    Aliases count only where they follow FROM or JOIN, so one given after a comma is unknown.
    """
    catalogue = constant([{"table": t, "columns": list(c)} for t, c in registry.columns.items()])
    context = F.struct(
        F.col("aliases"), F.concat("derived", "ctes", "cte_aliases").alias("derived"),
        F.array_distinct(S.qualified_columns(F.col("stripped"))).alias("pairs"))

    def check(ctx: Column) -> Column:
        def issue(q: Column) -> Column:
            def of_table(table: Column) -> Column:
                has = F.exists(catalogue, lambda t: (t["table"] == table) & F.array_contains(t["columns"], q["column"]))
                return (
                    F.when(F.array_contains(ctx["derived"], q["qualifier"]), None)
                    .when(table.isNull(), F.concat(F.lit("unknown qualifier "), q["qualifier"], F.lit("."), q["column"]))
                    .when(~has, F.concat(F.lit("unknown column "), q["column"], F.lit(" on "), table))
                )

            return let(_table_of(ctx["aliases"], q["qualifier"]), of_table)

        return F.filter(F.transform(ctx["pairs"], issue), lambda x: x.isNotNull())

    return let(context, check)


def identifier_issues(registry: Registry) -> Column:
    """Unqualified mixed-case names that are no keyword, table, column, alias or CTE."""
    known = constant(sorted({*registry.tables, *(c for cs in registry.columns.values() for c in cs)}))
    mixed = F.filter(
        F.array_distinct(S.free_identifiers(F.col("stripped"))),
        lambda n: n.rlike("[A-Z]") & ~n.rlike("^[A-Z_]+$") & ~F.upper(n).isin(*S.KEYWORDS))
    local = F.concat(
        S.output_aliases(F.col("stripped")), F.col("ctes"), F.col("derived"), F.col("cte_aliases"), F.transform("aliases", lambda a: a["alias"]))
    return F.array_except(F.array_except(mixed, known), local)


def join_issues(registry: Registry) -> Column:
    """Joined column pairs of two known tables that no relationship covers, in either direction."""
    allowed = constant(sorted({f"{a}.{x}->{b}.{y}" for l in registry.joins for a, x, b, y in (l, (l[2], l[3], l[0], l[1]))}))

    def check(ctx: Column) -> Column:
        def key(p: Column) -> Column:
            left, right = _table_of(ctx["aliases"], p["lq"]), _table_of(ctx["aliases"], p["rq"])
            text = F.concat(left, F.lit("."), p["lc"], F.lit("->"), right, F.lit("."), p["rc"])
            return F.when(left != right, text)

        return F.array_except(F.array_distinct(F.filter(F.transform(ctx["pairs"], key), lambda k: k.isNotNull())), allowed)

    return let(F.struct(F.col("aliases"), S.join_equalities(F.col("stripped")).alias("pairs")), check)


def metric_issues(stripped: Column, metrics: Column, registry: Registry) -> Column:
    """Matched metrics of which no preferred column is mentioned."""
    rows = constant([
        {"name": n, "columns": [c.split(".")[-1].lower() for c in cols]} for n, cols in (registry.metrics or {}).items()
    ])
    text = F.lower(F.replace(stripped, F.lit("`"), F.lit("")))
    context = F.struct(F.split(text, "[^a-z0-9_]+").alias("words"), metrics.alias("metrics"))

    def check(ctx: Column) -> Column:
        def bad(m: Column) -> Column:
            covered = (m["name"] == registry.general_metric) & F.array_contains(ctx["metrics"], registry.line_metric)
            return F.array_contains(ctx["metrics"], m["name"]) & ~covered & ~F.arrays_overlap(m["columns"], ctx["words"])

        return F.transform(F.filter(rows, bad), lambda m: m["name"])

    return let(context, check)


def candidate_id_issues(stripped: Column, candidates: Column, registry: Registry) -> Column:
    """Product ids that were not among the resolved candidates; without candidates nothing is checked."""
    ids = S.ids_compared(stripped, sorted(registry.id_columns, key=lambda c: (-len(c), c)))
    return F.when(F.size(candidates) > 0, F.array_except(ids, candidates)).otherwise(F.expr("cast(array() as array<bigint>)"))


def contract_issue(declared: Column, allowed: Column, used: Column) -> Column:
    """Declared tables must be allowed and must cover the used ones; null when they do or none are declared."""
    outside, omitted = F.array_except(declared, allowed), F.array_except(used, declared)
    return F.when(declared.isNull(), None).when(
        F.size(outside) > 0, F.concat(F.lit("declared outside allowed: "), F.array_join(F.array_sort(outside), ", "))
    ).when(F.size(omitted) > 0, F.concat(F.lit("omitted: "), F.array_join(F.array_sort(omitted), ", ")))


def disallowed_columns_used(sql: Column, disallowed: Column) -> Column:
    return let(F.struct(F.coalesce(sql, F.lit("")).alias("s"), disallowed.alias("d")), lambda ctx: F.filter(
        F.array_distinct(ctx["d"]), lambda c: S.mentions_word(ctx["s"], c)))


def audit(log: DataFrame, registry: Registry, sql: str = "sql", allowed: str = "allowed_tables",
          metrics: str | None = None, candidates: str | None = None, declared: str | None = None,
          exempt_ctes: bool = False, first_only: bool = False) -> DataFrame:
    """Add every check, and the first issue in checking order (null when the query is fine).

    With ``first_only``, a check is not made where an earlier one has found something; its column is null there.
    """
    none = F.expr(_NONE)
    out = sql_facts(statements(log, sql), registry)
    text = F.col("stripped")
    checks = (
        ("outside_tables", "outside the allowed table set: ", outside_tables(F.col(allowed), F.col("tables_used"), F.col("ctes") if exempt_ctes else None)),
        ("column_issues", "", column_issues(registry)),
        ("identifier_issues", "unknown identifier ", identifier_issues(registry)),
        ("join_issues", "not an in-scope relationship: ", join_issues(registry)),
        ("metric_issues", "preferred column for semantic metric missing: ", metric_issues(text, F.col(metrics), registry) if metrics else none),
        ("id_issues", ID_LABEL,
         candidate_id_issues(text, F.col(candidates), registry) if candidates else F.expr("cast(array() as array<bigint>)")),
    )
    contract = contract_issue(F.col(declared), F.col(allowed), F.col("tables_used")) if declared else F.lit(None).cast("string")
    out = out.withColumn("first_issue", F.col("read_only_issue"))
    for column, label, found in checks:
        out = out.withColumn(column, F.when(F.col("first_issue").isNull(), found) if first_only else found)
        said = F.when(F.size(column) > 0, F.concat(F.lit(label), F.get(column, F.lit(0)).cast("string")))
        out = out.withColumn("first_issue", F.coalesce("first_issue", said))
    out = out.withColumn("contract_issue", contract)
    return out.withColumn("first_issue", F.coalesce("first_issue", "contract_issue")).drop(*FACTS)


_NUMBER = r"(?<![A-Za-z0-9_`$.])[0-9]++(?:\.[0-9]++)?+(?![A-Za-z0-9_`$.])"


def template(sql: Column) -> Column:
    """The statement with 0 for each number that stands alone. Names that hold digits stay."""
    return F.regexp_replace(sql, _NUMBER, "0")


def audit_by_template(log: DataFrame, registry: Registry, sql: str = "sql", allowed: str = "allowed_tables", metrics: str | None = None,
                      candidates: str | None = None, declared: str | None = None, exempt_ctes: bool = False) -> DataFrame:
    """What `audit` adds, with each template audited once.

    Numbers are cut out of the statements; only product ids depend on them. Statements with the same template, allowed and
    declared tables and metrics share one audit, which is joined back; product ids are read from each statement whose template
    compares some. A null statement is a template of its own.
    """
    given = [c for c in (allowed, metrics, declared) if c]
    marked = log.withColumn("template", template(F.col(sql)))
    marked = marked.withColumn("template_key", F.sha2(F.to_json(F.struct("template", *given), {"ignoreNullFields": "false"}), 256))
    known = marked.groupBy("template_key").agg(F.any_value("template").alias("template"), *[F.any_value(c).alias(c) for c in given])
    found = audit(known, registry, "template", allowed, metrics, None, None, exempt_ctes)
    contract = contract_issue(F.col(declared), F.col(allowed), F.col("tables_used")) if declared else F.lit(None).cast("string")
    names = sorted(registry.id_columns, key=lambda c: (-len(c), c))
    found = found.withColumn("contract_issue", contract).withColumn("compares_ids", F.size(S.ids_compared(S.strip_literals(F.col("cleaned")), names)) > 0)
    added = ("tables_used", "read_only_issue", "outside_tables", "column_issues", "identifier_issues", "join_issues", "metric_issues", "contract_issue", "first_issue", "compares_ids")
    # written, so that Spark knows how few templates there are and the statements stay where they are
    out = marked.drop("template").join(written(found.select("template_key", *added)), "template_key").drop("template_key")
    own = S.clean_output(F.col(sql))
    none = F.expr("cast(array() as array<bigint>)")
    ids = F.when(F.col("compares_ids"), candidate_id_issues(S.strip_literals(own), F.col(candidates), registry)).otherwise(none) if candidates else none
    out = out.withColumn("cleaned", own).withColumn("id_issues", ids).drop("compares_ids")
    said = F.when(F.size("id_issues") > 0, F.concat(F.lit(ID_LABEL), F.get("id_issues", F.lit(0)).cast("string")))
    return out.withColumn("first_issue", F.coalesce("first_issue", said, "contract_issue"))


# Phrases in an error text and the class of headline they get, first match first.
HEADLINES = (
    (r"missing expected (?:demo|demo_retail|retail)? tables|databaseschemaerror", "database_not_ready"),
    (r"failed to fetch|networkerror|econnrefused|fetch failed|load failed|network request failed", "service_unreachable"),
    (r"characters or fewer|question is required", "question_invalid"),
    (r"too many requests|rate limit", "rate_limited"),
    (r"unauthorized|forbidden|invalid token|missing token", "unauthorized"),
    (r"only read-only|only select or with|single sql statement|restricted sql functions|are not allowed|executable sql comments",
     "unsafe_query"),
    (r"outside the allowed table set|unknown column|unknown table|unknown identifier|not an in-scope relationship|"
     r"preferred column for semantic metric|resolved master-data|tables_used", "invalid_query"),
)


def headline_class(message: Column) -> Column:
    """Class of an error message; empty messages and unknown texts have their own classes."""
    lower = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    kind = F.when(lower == "", "no_message")  # null counts as empty
    for pattern, name in HEADLINES:
        kind = kind.when(lower.rlike(pattern), name)
    return kind.otherwise("unanswered")
