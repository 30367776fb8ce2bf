"""Pieces of DuckDB SQL used by the oracle statements."""

from __future__ import annotations

from tallyframe.functions.dates import MONTHS
from tallyframe.functions.words import STOP_WORDS

MARK = "CHR(57344)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(x: str) -> str:
    x = f"REPLACE(COALESCE({x}, ''), {MARK}, ' ')"
    x = f"REGEXP_REPLACE({x}, '\\b([A-Z]{{2,}})s\\b', '\\1' || {MARK} || 's', 'g')"
    x = f"REGEXP_REPLACE({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    x = f"REGEXP_REPLACE({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(REPLACE(LOWER({x}), {MARK}, ''), '[^a-z0-9]+'), LAMBDA w: w <> '')"


def singular(t: str) -> str:
    return f"""CASE WHEN LENGTH({t}) <= 3 THEN {t}
        WHEN {t} LIKE '%ies' AND LENGTH({t}) > 4 THEN LEFT({t}, LENGTH({t}) - 3) || 'y'
        WHEN REGEXP_MATCHES({t}, '(ches|shes|sses|xes|zes)$') THEN LEFT({t}, LENGTH({t}) - 2)
        WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN LEFT({t}, LENGTH({t}) - 1) ELSE {t} END"""


def kept(t: str) -> str:
    return f"(LENGTH({t}) > 1 AND {t} NOT IN ({', '.join(text(s) for s in STOP_WORDS)}))"


def tokens_of(source: str, key: str, column: str) -> str:
    """Distinct (key, token) rows of a relation of texts."""
    return f"""SELECT DISTINCT {key}, token FROM (
        SELECT {key}, w AS token FROM (SELECT {key}, UNNEST({words(column)}) AS w FROM {source}) WHERE {kept('w')}
        UNION ALL SELECT {key}, {singular('w')} FROM (SELECT {key}, UNNEST({words(column)}) AS w FROM {source}) WHERE {kept('w')}
        ) WHERE {kept('token')}"""


def variants_of(source: str) -> str:
    """(token, variant) rows for a relation of distinct tokens."""
    cut = lambda n: f"LEFT(b, LENGTH(b) - {n})"
    return f"""SELECT DISTINCT token, v AS variant FROM (
        WITH bases AS (SELECT DISTINCT token, b FROM (
            SELECT token, token AS b FROM {source} UNION ALL SELECT token, {singular('token')} FROM {source}) WHERE LENGTH(b) >= 3),
        stems AS (
            SELECT token, UNNEST(CASE
                WHEN b LIKE '%ing' THEN [{cut(3)}, {cut(3)} || 'e']
                WHEN b LIKE '%ed' THEN [{cut(2)}, {cut(1)}]
                WHEN b LIKE '%ers' THEN [{cut(3)}, {cut(2)}]
                WHEN b LIKE '%er' THEN [{cut(2)}, {cut(1)}] ELSE [] END) AS v
            FROM bases WHERE LENGTH(b) > 4)
        SELECT token, b AS v FROM bases UNION ALL SELECT token, v FROM stems WHERE LENGTH(v) >= 4)"""


_NAMES = "|".join(sorted(MONTHS, key=lambda n: (-len(n), n)))
MONTH_PATTERN = f"(?i)\\b({_NAMES})\\.?(\\s*,\\s*|\\s+)([0-9]{{2,4}})\\b"
_NUMBERS = "CASE LOWER(g1) " + " ".join(f"WHEN '{n}' THEN {m}" for n, m in MONTHS.items()) + " END"


def month_rows(source: str, key: str, column: str) -> str:
    """(key, position, original, normalized, start_date, end_exclusive) for month phrases."""
    group = lambda i: f"REGEXP_EXTRACT_ALL({column}, '{MONTH_PATTERN}', {i})"
    return f"""SELECT {key}, position, g0 AS original, STRFTIME(start_date, '%B %Y') AS normalized, start_date,
            CAST(start_date + TO_MONTHS(1) AS DATE) AS end_exclusive FROM (
        SELECT *, MAKE_DATE(CAST(y AS BIGINT), CAST({_NUMBERS} AS BIGINT), 1) AS start_date FROM (
            SELECT *, CASE WHEN LENGTH(g3) = 4 AND CAST(g3 AS INT) > 0 THEN CAST(g3 AS INT)
                WHEN LENGTH(g3) = 2 AND CONTAINS(g2, ',') THEN CASE WHEN CAST(g3 AS INT) <= 69
                    THEN 2000 + CAST(g3 AS INT) ELSE 1900 + CAST(g3 AS INT) END END AS y
            FROM (SELECT {key}, UNNEST({group(0)}) AS g0, UNNEST({group(1)}) AS g1, UNNEST({group(2)}) AS g2,
                    UNNEST({group(3)}) AS g3, UNNEST(RANGE(1, LENGTH({group(0)}) + 1)) AS position FROM {source}))
        WHERE y IS NOT NULL)"""
