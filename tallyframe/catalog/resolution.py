"""Entity resolution of mentions derived from the tables against the part master."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import sqltools as S
from tallyframe.catalog.questions import questions
from tallyframe.catalog.text import _PLAN, _matcher
from tallyframe.functions.words import search_text
from tallyframe.operators import resolve
from tallyframe.operators.matching import question_context
from tallyframe.sources.semantic import Alias

ALIASES = (
    Alias("product", "ring", ("small loop", "Red-Bolt")),
    Alias("product", "large rod", ("anvil", "economy")),
)
COLUMNS = ("p_name", "p_brand", "p_type")


def _parts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *COLUMNS)


def _mentions(spark, d):
    """Mentions: every word of a part name, every name reversed, and every brand with its sign removed."""
    p = spark.read.parquet(f"{d}/part.parquet")
    words = p.select(F.explode(F.split("p_name", " ")).alias("mention"))
    turned = p.select(F.concat_ws(" ", F.reverse(F.split("p_name", " "))).alias("mention"))
    brands = p.select(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("brand ")).alias("mention"))
    return words.union(turned).union(brands).distinct()


def normalized_search_texts(spark, d):
    docs = spark.read.parquet(f"{d}/conversations.parquet")
    return docs.select("conv_id", "turn", F.md5(search_text(F.col("text"))).alias("search_md5"))


def question_mentions(spark, d):
    planned = _matcher().plan(question_context(questions(spark, d)))
    return resolve.mentions_from_filters(planned, "Product", "question_id")


def expanded_mentions(spark, d):
    return resolve.expand_mentions(_mentions(spark, d), ALIASES).select(
        "mention", F.array_join("terms", "|").alias("terms"))


def _pairs(spark, d):
    expanded = resolve.expand_mentions(_mentions(spark, d), ALIASES)
    return resolve.find_candidates(expanded, _parts(spark, d), "p_partkey", COLUMNS)


def entity_candidates(spark, d):
    return _pairs(spark, d).select("mention", F.col("__key").alias("p_partkey"))


def entity_scores(spark, d):
    return resolve.score_candidates(_pairs(spark, d), COLUMNS).filter("score > 0").select(
        "mention", F.col("__key").alias("p_partkey"), F.col("score").cast("bigint").alias("score"), "match_type", "matched_value")


def entity_ranking(spark, d):
    ranked = resolve.rank_candidates(resolve.score_candidates(_pairs(spark, d), COLUMNS), "p_name")
    return ranked.select("mention", F.col("position").cast("bigint").alias("position"),
                         F.col("__key").alias("p_partkey"), F.col("score").cast("bigint").alias("score"))


def entity_resolution(spark, d):
    resolved = resolve.resolve_entities(_mentions(spark, d), _parts(spark, d), "p_partkey", COLUMNS, ALIASES)
    return resolved.select(
        "mention", F.col("candidate_count").cast("bigint").alias("candidate_count"),
        F.coalesce(F.get("candidates", F.lit(0))["name"], F.lit("")).alias("best_name"))


QUERIES = {
    f.__name__: f
    for f in (normalized_search_texts, question_mentions, expanded_mentions, entity_candidates, entity_scores,
              entity_ranking, entity_resolution)
}


def _normal(x: str) -> str:
    return f"TRIM(REGEXP_REPLACE(LOWER(COALESCE({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


_RINGS = ", ".join(
    f"({i}, {j}, {S.text(m)})" for i, a in enumerate(ALIASES) for j, m in enumerate((a.canonical, *a.aliases))
)
_TERMS = f"""mentions AS (
        SELECT UNNEST(STRING_SPLIT(p_name, ' ')) AS mention FROM part
        UNION SELECT ARRAY_TO_STRING(LIST_REVERSE(STRING_SPLIT(p_name, ' ')), ' ') FROM part
        UNION SELECT REPLACE(p_brand, 'Brand#', 'brand ') FROM part),
    rings(ring, pos, member) AS (VALUES {_RINGS}),
    raw AS (
        SELECT mention, 0 AS pos, mention AS term FROM mentions
        UNION ALL SELECT mention, 1 + 100 * a.ring + b.pos, b.member FROM mentions
            JOIN rings a ON {_normal('a.member')} = {_normal('mention')} JOIN rings b ON a.ring = b.ring),
    terms AS (SELECT mention, MIN(pos) AS pos, term FROM raw GROUP BY mention, term)"""
_PAIRS = f"""{_TERMS},
    norm AS (SELECT mention, pos, term, {_normal('term')} AS t FROM terms),
    pairs AS (SELECT DISTINCT mention, p_partkey, p_name, p_brand, p_type FROM norm JOIN part
        ON t <> '' AND (CONTAINS(LOWER(p_name), t) OR CONTAINS(LOWER(p_brand), t) OR CONTAINS(LOWER(p_type), t)))"""
_SCORES = f"""{_PAIRS},
    wide AS (SELECT p.*, n.pos, n.term, n.t, [{_normal('p_name')}, {_normal('p_brand')}, {_normal('p_type')}] AS f,
            {_normal("p_name || ' ' || p_brand || ' ' || p_type")} AS c
        FROM pairs p JOIN norm n USING (mention) WHERE n.t <> ''),
    tiers AS (SELECT *, CASE WHEN LIST_CONTAINS(f, t) THEN 100
        WHEN LEN(LIST_FILTER(f, LAMBDA v: STARTS_WITH(v, t || ' '))) > 0 THEN 85
        WHEN LEN(LIST_FILTER(f, LAMBDA v: CONTAINS(v, ' ' || t || ' ') OR ENDS_WITH(v, ' ' || t))) > 0 THEN 75
        WHEN CONTAINS(c, t) THEN 60
        WHEN LEN(LIST_FILTER(STRING_SPLIT(t, ' '), LAMBDA w: NOT CONTAINS(c, w))) = 0 THEN 45 ELSE 0 END AS score FROM wide),
    best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY mention, p_partkey ORDER BY score DESC, pos) AS k FROM tiers)
        WHERE k = 1 AND score > 0),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY mention ORDER BY score DESC, p_name, p_partkey) AS position FROM best)"""

ORACLES = {
    "normalized_search_texts": f"SELECT conv_id, turn, MD5({_normal('text')}) AS search_md5 FROM conversations",
    "question_mentions": f"""WITH {_PLAN} SELECT DISTINCT question_id, synonym AS mention
        FROM questions JOIN q USING (text) JOIN hits USING (tid)
        WHERE kind = 'filters' AND name = 'demo_product_terms'""",
    "expanded_mentions": f"WITH {_TERMS} SELECT mention, STRING_AGG(term, '|' ORDER BY pos) AS terms FROM terms GROUP BY mention",
    "entity_candidates": f"WITH {_PAIRS} SELECT mention, p_partkey FROM pairs",
    "entity_scores": f"""WITH {_SCORES} SELECT mention, p_partkey, CAST(score AS BIGINT) AS score,
        CASE score WHEN 100 THEN 'exact_field' WHEN 85 THEN 'field_prefix' WHEN 75 THEN 'word_phrase'
        WHEN 60 THEN 'substring' ELSE 'token_overlap' END AS match_type, term AS matched_value FROM best""",
    "entity_ranking": f"""WITH {_SCORES} SELECT mention, position, p_partkey, CAST(score AS BIGINT) AS score
        FROM ranked WHERE position <= 20""",
    "entity_resolution": f"""WITH {_SCORES} SELECT m.mention, COUNT(r.position) AS candidate_count,
        COALESCE(MAX(CASE WHEN position = 1 THEN p_name END), '') AS best_name
        FROM mentions m LEFT JOIN ranked r ON r.mention = m.mention AND position <= 20 GROUP BY m.mention""",
}
