"""Text rules on documents, and dictionary matching on questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.catalog import sqltools as S
from tallyframe.catalog.questions import QUESTIONS_SQL, questions
from tallyframe.functions.words import normalize_tokens, singular, split_words, token_variants
from tallyframe.operators.matching import Matcher, nearest_examples, once_per_text, question_context
from tallyframe.operators.paths import shortest_paths
from tallyframe.operators.prefixes import estimate_tokens, prefix_groups
from tallyframe.plans.retail_layer import COLUMN_COMMENTS, DESCRIPTIONS, EXAMPLES, RETAIL_CATALOGUE, RETAIL_LAYER
from tallyframe.sources.semantic import unique


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _matcher():
    return Matcher(RETAIL_LAYER, RETAIL_CATALOGUE, EXAMPLES)


def document_words(spark, d):
    words = split_words(F.col("text"))
    return (
        _documents(spark, d).select("doc_id", words.alias("w"))
        .select("doc_id", F.size("w").cast("bigint").alias("word_count"), F.md5(F.array_join("w", " ")).alias("words_md5"))
    )


def document_tokens(spark, d):
    return (
        _documents(spark, d).select("doc_id", normalize_tokens(F.col("text")).alias("t"))
        .select("doc_id", F.size("t").cast("bigint").alias("token_count"),
                F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens_md5"))
    )


def _distinct_words(spark, d):
    return _documents(spark, d).select(F.explode_outer(F.array_distinct(split_words(F.col("text")))).alias("token")).filter("token IS NOT NULL").distinct()


def singular_forms(spark, d):
    return _distinct_words(spark, d).select("token", singular(F.col("token")).alias("singular"))


def inflection_variants(spark, d):
    return _distinct_words(spark, d).select(
        "token", F.array_join(F.array_sort(token_variants(F.col("token"))), "|").alias("variants")
    )


def month_phrases(spark, d):
    return (
        question_context(questions(spark, d))
        .select("question_id", F.posexplode_outer("month_refs").alias("p", "r"))
        .filter("p IS NOT NULL")
        .select("question_id", "r.original", "r.normalized",
                F.date_format("r.start_date", "yyyy-MM-dd").alias("start_date"),
                F.date_format("r.end_exclusive", "yyyy-MM-dd").alias("end_exclusive"))
    )


def normalized_questions(spark, d):
    return question_context(questions(spark, d)).select("question_id", "normalized_text")


def _planned(spark, d):
    return once_per_text(questions(spark, d), "text", lambda texts: _matcher().plan(question_context(texts)))


def _scored(spark, d):
    m = _matcher()
    return once_per_text(questions(spark, d), "text", lambda texts: m.score_tables(m.plan(question_context(texts))))


def _retrieved(spark, d):
    return once_per_text(questions(spark, d), "text", _matcher().retrieve)


def semantic_matches(spark, d):
    """One row per question and matched entity, metric or filter."""

    def rows(kind):
        return F.transform(kind, lambda e: F.struct(
            F.lit(kind).alias("kind"), e["name"].alias("name"), F.array_join(e["matched"], "|").alias("matched"),
            e["score"].cast("bigint").alias("score")))

    kinds = [rows(c) for c in ("entities", "metrics", "filters")]
    return _planned(spark, d).select("question_id", F.inline_outer(F.concat(*kinds))).filter("name IS NOT NULL")


def clarification_matches(spark, d):
    return _planned(spark, d).select("question_id", F.explode_outer("rules").alias("r")).filter("r IS NOT NULL").select(
        "question_id", F.col("r.name").alias("trigger"))


def lexical_table_scores(spark, d):
    return _scored(spark, d).select("question_id", F.inline_outer("table_scores")).filter(F.col("lexical") > 0).select(
        "question_id", F.col("name").alias("table_name"), F.col("lexical").cast("bigint").alias("lexical"))


def semantic_table_boosts(spark, d):
    return _scored(spark, d).select("question_id", F.inline_outer("table_scores")).filter(F.col("semantic") > 0).select(
        "question_id", F.col("name").alias("table_name"), F.col("semantic").cast("bigint").alias("semantic"))


def retrieved_tables(spark, d):
    """Top four tables, then the required ones, per question."""
    return _retrieved(spark, d).select("question_id", F.array_join("selected", "|").alias("selected"))


def connector_tables(spark, d):
    """Tables that lie on the shortest foreign-key path between two selected tables."""
    return _retrieved(spark, d).select(
        "question_id", F.explode_outer("connectors").alias("connector")).filter("connector IS NOT NULL")


def _examples(found):
    return found.select("question_id", F.posexplode_outer("examples").alias("p", "e")).filter("p IS NOT NULL").select(
        "question_id", (F.col("p") + 1).cast("bigint").alias("position"), F.col("e.question").alias("example"))


def similar_examples(spark, d):
    return _examples(once_per_text(questions(spark, d), "text", lambda texts: _matcher().examples_for(question_context(texts))))


def stored_examples(spark, d):
    """A question for each order's customer and month, with the tables that answer it."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    asked = F.concat(F.lit("Backlog of customer "), F.col("o_custkey").cast("string"), F.lit(" from "), F.date_format("o_orderdate", "MMMM yyyy"))
    return o.select(asked.alias("question"), F.array(F.lit("SalesDocument"), F.lit("Customer")).alias("tables"))


def similar_stored_examples(spark, d):
    """The nearest two of as many stored questions as there are orders."""
    store = stored_examples(spark, d)
    return _examples(once_per_text(questions(spark, d), "text", lambda texts: nearest_examples(question_context(texts), store)))


def region_paths(spark, d):
    """Shortest paths of at most three hops from every region over the location graph."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    node = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), 12, "0"))
    edges = (
        read("customer").select(node("C", "c_custkey").alias("a"), node("N", "c_nationkey").alias("b"))
        .union(read("supplier").select(node("S", "s_suppkey"), node("N", "s_nationkey")))
        .union(read("nation").select(node("N", "n_nationkey"), node("R", "n_regionkey")))
    )
    starts = read("region").select(node("R", "r_regionkey").alias("a"))
    return shortest_paths(edges, starts, 3).select(
        "src", "dst", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"))


def document_token_estimates(spark, d):
    return _documents(spark, d).select("doc_id", estimate_tokens(F.col("text")).alias("estimated_tokens"))


def prompt_prefix_groups(spark, d):
    """Documents that share their first line, as reusable prefixes."""
    first_line = F.regexp_extract("text", r"^[^\n]*", 0)
    return prefix_groups(_documents(spark, d), first_line)


QUERIES = {
    f.__name__: f
    for f in (
        document_words, document_tokens, singular_forms, inflection_variants, month_phrases, normalized_questions,
        semantic_matches, clarification_matches, lexical_table_scores, semantic_table_boosts, retrieved_tables,
        connector_tables, similar_examples, similar_stored_examples, region_paths, document_token_estimates, prompt_prefix_groups,
    )
}


def _dictionary_rows() -> list[tuple]:
    layer, rows = RETAIL_LAYER, []
    for kind, entries in (("entities", layer.entities), ("metrics", layer.metrics)):
        for e in entries:
            rows += [(kind, e.name, i, s, 0) for i, s in enumerate(unique((e.name, *e.synonyms)))]
    for f in layer.filters:
        values = [v for a in layer.aliases if f.target_table == "Product" for v in (a.canonical, *a.aliases)]
        only = set(values) - set(f.synonyms)
        rows += [("filters", f.name, i, s, int(s in only)) for i, s in enumerate(unique((f.name, *f.synonyms, *values)))]
    rows += [("rules", t, 0, t, 0) for t, _ in layer.rules]
    return rows


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(S.text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_ENTRY_TABLES = [
    *[("entities", e.name, t) for e in RETAIL_LAYER.entities for t in e.tables],
    *[("metrics", e.name, t) for e in RETAIL_LAYER.metrics for t in e.tables],
    *[("filters", f.name, f.target_table) for f in RETAIL_LAYER.filters],
]
_FIELDS = [
    row
    for t in RETAIL_CATALOGUE.tables
    for row in (
        (t.name, 30, t.name), (t.name, 28, " ".join(t.aliases)), (t.name, 18, DESCRIPTIONS[t.name]), (t.name, 10, " ".join(t.columns)),
        (t.name, 6, " ".join(COLUMN_COMMENTS.get(t.name, ()))))
]
_ORDERED = [t.name for t in RETAIL_CATALOGUE.tables]
_FK = [(a, b) for a, b in RETAIL_CATALOGUE.edges if a != b]

_CONTEXT = f"""questions AS ({QUESTIONS_SQL}),
    q AS (SELECT text, ROW_NUMBER() OVER (ORDER BY text) AS tid FROM (SELECT DISTINCT text FROM questions)),
    refs AS ({S.month_rows('q', 'tid', 'text')}),
    ref_lists AS (SELECT tid, LIST({{'o': original, 'n': normalized}} ORDER BY position) AS l FROM refs GROUP BY tid),
    folded AS (SELECT q.tid, q.text, CASE WHEN l IS NULL THEN q.text ELSE
        LIST_REDUCE(LIST_PREPEND({{'o': '', 'n': q.text}}, l),
            LAMBDA a, r: {{'o': '', 'n': REPLACE(a.n, r.o, r.n)}}).n END AS normalized_text
        FROM q LEFT JOIN ref_lists USING (tid)),
    qt AS ({S.tokens_of('folded', 'tid', 'normalized_text')})"""

_PLAN = f"""{_CONTEXT},
    qk AS (SELECT DISTINCT token FROM qt),
    qv AS (SELECT DISTINCT tid, variant FROM qt JOIN ({S.variants_of('qk')}) USING (token)),
    dict(kind, name, pos, synonym, alias_only) AS (VALUES {_values(_dictionary_rows())}),
    syn AS (SELECT *, ROW_NUMBER() OVER () AS sid FROM dict),
    st AS ({S.tokens_of('syn', 'sid', 'synonym')}),
    sk AS (SELECT DISTINCT token FROM st),
    sv AS (SELECT DISTINCT sid, token, variant FROM st JOIN ({S.variants_of('sk')}) USING (token)),
    need AS (SELECT sid, COUNT(*) AS n FROM st GROUP BY sid),
    by_token AS (SELECT tid, sid FROM qt JOIN st USING (token) JOIN need USING (sid) GROUP BY tid, sid, n HAVING COUNT(*) = n),
    by_stem AS (SELECT tid, sid FROM (SELECT DISTINCT tid, sid, token FROM qv JOIN sv USING (variant)) JOIN need USING (sid)
        GROUP BY tid, sid, n HAVING COUNT(*) = n),
    raw AS (SELECT tid, syn.*, n FROM (SELECT * FROM by_token UNION SELECT * FROM by_stem) JOIN syn USING (sid) JOIN need USING (sid)),
    sw AS (SELECT sid, {S.words('synonym')} AS w FROM syn),
    hits AS (SELECT r.* FROM raw r WHERE NOT (r.alias_only = 1 AND EXISTS (
        SELECT 1 FROM raw o JOIN sw a ON a.sid = r.sid JOIN sw b ON b.sid = o.sid
        WHERE o.tid = r.tid AND o.kind = r.kind AND o.name = r.name AND LEN(b.w) > LEN(a.w) AND LIST_HAS_ALL(b.w, a.w)))),
    found AS (SELECT tid, kind, name, STRING_AGG(synonym, '|' ORDER BY pos) AS matched, SUM(n) AS score
        FROM hits GROUP BY tid, kind, name),
    entry_tables(kind, name, tab) AS (VALUES {_values(_ENTRY_TABLES)}),
    product_context AS (SELECT DISTINCT tid FROM found LEFT JOIN entry_tables USING (kind, name)
        WHERE (kind = 'entities' AND name IN ({', '.join(map(S.text, RETAIL_LAYER.product_entities))}))
           OR (kind = 'filters' AND tab IN ({', '.join(map(S.text, RETAIL_LAYER.product_tables))}))),
    derived AS (SELECT tid, 'metrics' AS kind, 'line_net_sales' AS name, 'sales with product filter context' AS matched, 5 AS score
        FROM product_context WHERE tid IN (SELECT tid FROM found WHERE kind = 'metrics' AND name = 'net_sales')
        AND tid NOT IN (SELECT tid FROM found WHERE kind = 'metrics' AND name = 'line_net_sales')),
    plan AS (SELECT tid, kind, name, matched, CAST(score AS BIGINT) AS score FROM found UNION ALL SELECT * FROM derived),
    required AS (SELECT DISTINCT tid, tab FROM plan JOIN entry_tables USING (kind, name)),
    paths(path, tab) AS (VALUES {_values([(p.name, t) for p in RETAIL_LAYER.paths for t in p.tables])}),
    hints AS (SELECT tid, path FROM paths JOIN required USING (tab) GROUP BY tid, path HAVING COUNT(*) = 2),
    boost AS (SELECT tid, tab, CAST(SUM(points) AS BIGINT) AS semantic FROM (
        SELECT tid, tab, CASE kind WHEN 'entities' THEN 60 + 4 * score WHEN 'metrics' THEN 80 + 5 * score ELSE 70 + 5 * score END AS points
        FROM plan JOIN entry_tables USING (kind, name)
        UNION ALL SELECT tid, tab, 20 FROM hints JOIN paths USING (path)) GROUP BY tid, tab),
    fields(tab, weight, content) AS (VALUES {_values(_FIELDS)}),
    field AS (SELECT *, ROW_NUMBER() OVER () AS fid FROM fields),
    ft AS ({S.tokens_of('field', 'fid', 'content')}),
    lex AS (SELECT tid, tab, SUM(weight) AS lexical FROM qt JOIN ft USING (token) JOIN field USING (fid) GROUP BY tid, tab)"""

_RETRIEVE = f"""{_PLAN},
    scored AS (SELECT tid, tab, COALESCE(lexical, 0) + COALESCE(semantic, 0) AS total FROM lex FULL JOIN boost USING (tid, tab)),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tid ORDER BY total DESC, tab) AS r FROM scored),
    chosen AS (SELECT tid, tab, r FROM ranked WHERE r <= 4 OR (tid, tab) IN (SELECT (tid, tab) FROM required)),
    all_tabs(tab, r) AS (VALUES {_values([(t, i + 1) for i, t in enumerate(_ORDERED[:4])])}),
    selected AS (SELECT * FROM chosen UNION ALL SELECT tid, all_tabs.tab, all_tabs.r FROM q, all_tabs
        WHERE tid NOT IN (SELECT tid FROM chosen))"""

_PATHS_SQL = f"""edges(a, b) AS (VALUES {_values(_FK)}),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walks AS (SELECT a AS src, b AS dst, 1 AS hops, [a, b] AS path FROM both_ways
        UNION ALL SELECT src, e.b, hops + 1, LIST_APPEND(path, e.b) FROM walks JOIN both_ways e ON e.a = dst
        WHERE hops < 3 AND NOT LIST_CONTAINS(path, e.b)),
    best AS (SELECT src, dst, path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY hops, path) AS k FROM walks) WHERE k = 1)"""

ORACLES = {
    "document_words": f"""SELECT doc_id, LEN(w) AS word_count, MD5(ARRAY_TO_STRING(w, ' ')) AS words_md5
        FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)""",
    "document_tokens": f"""SELECT doc_id, COUNT(token) AS token_count, MD5(COALESCE(STRING_AGG(token, ' ' ORDER BY token), '')) AS tokens_md5
        FROM documents LEFT JOIN ({S.tokens_of('documents', 'doc_id', 'text')}) USING (doc_id) GROUP BY doc_id""",
    "singular_forms": f"""SELECT token, {S.singular('token')} AS singular
        FROM (SELECT DISTINCT UNNEST({S.words('text')}) AS token FROM documents)""",
    "inflection_variants": f"""WITH k AS (SELECT DISTINCT UNNEST({S.words('text')}) AS token FROM documents)
        SELECT token, COALESCE(STRING_AGG(variant, '|' ORDER BY variant), '') AS variants
        FROM k LEFT JOIN ({S.variants_of('k')}) USING (token) GROUP BY token""",
    "month_phrases": f"""WITH questions AS ({QUESTIONS_SQL})
        SELECT question_id, original, normalized, STRFTIME(start_date, '%Y-%m-%d') AS start_date,
        STRFTIME(end_exclusive, '%Y-%m-%d') AS end_exclusive FROM ({S.month_rows('questions', 'question_id', 'text')})""",
    "normalized_questions": f"""WITH {_CONTEXT} SELECT question_id, normalized_text FROM questions JOIN folded USING (text)""",
    "semantic_matches": f"""WITH {_PLAN} SELECT question_id, kind, name, matched, score
        FROM questions JOIN q USING (text) JOIN plan USING (tid) WHERE kind <> 'rules'""",
    "clarification_matches": f"""WITH {_PLAN} SELECT question_id, name AS trigger
        FROM questions JOIN q USING (text) JOIN plan USING (tid) WHERE kind = 'rules'""",
    "lexical_table_scores": f"""WITH {_PLAN} SELECT question_id, tab AS table_name, CAST(lexical AS BIGINT) AS lexical
        FROM questions JOIN q USING (text) JOIN lex USING (tid)""",
    "semantic_table_boosts": f"""WITH {_PLAN} SELECT question_id, tab AS table_name, semantic
        FROM questions JOIN q USING (text) JOIN boost USING (tid)""",
    "retrieved_tables": f"""WITH {_RETRIEVE}, s AS (SELECT tid, STRING_AGG(tab, '|' ORDER BY r) AS selected FROM selected GROUP BY tid)
        SELECT question_id, selected FROM questions JOIN q USING (text) JOIN s USING (tid)""",
    "connector_tables": f"""WITH RECURSIVE {_RETRIEVE}, {_PATHS_SQL},
        c AS (SELECT DISTINCT x.tid, UNNEST(path) AS connector FROM selected x JOIN selected y ON x.tid = y.tid AND x.r < y.r
            JOIN best ON src = x.tab AND dst = y.tab)
        SELECT question_id, connector FROM questions JOIN q USING (text) JOIN c USING (tid)
        WHERE (tid, connector) NOT IN (SELECT (tid, tab) FROM selected)""",
    "similar_examples": f"""WITH {_CONTEXT}, ex(example) AS (VALUES {_values([(x,) for x, _ in EXAMPLES])}),
        e AS (SELECT *, ROW_NUMBER() OVER () AS eid FROM ex), et AS ({S.tokens_of('e', 'eid', 'example')}),
        s AS (SELECT tid, example, COUNT(*) AS shared FROM qt JOIN et USING (token) JOIN e USING (eid) GROUP BY tid, example),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tid ORDER BY shared DESC, example) AS position FROM s)
        SELECT question_id, position, example FROM questions JOIN q USING (text) JOIN r USING (tid) WHERE position <= 2""",
    "similar_stored_examples": f"""WITH {_CONTEXT}, ex AS (SELECT DISTINCT 'Backlog of customer ' || o_custkey || ' from ' || STRFTIME(o_orderdate, '%B %Y') AS example FROM orders),
        e AS (SELECT *, ROW_NUMBER() OVER () AS eid FROM ex), et AS ({S.tokens_of('e', 'eid', 'example')}),
        s AS (SELECT tid, eid, COUNT(*) AS shared FROM qt JOIN et USING (token) GROUP BY tid, eid),
        r AS (SELECT tid, example, ROW_NUMBER() OVER (PARTITION BY tid ORDER BY shared DESC, example) AS position FROM s JOIN e USING (eid))
        SELECT question_id, position, example FROM questions JOIN q USING (text) JOIN r USING (tid) WHERE position <= 2""",
    "region_paths": """WITH RECURSIVE e AS (
            SELECT 'C' || LPAD(CAST(c_custkey AS VARCHAR), 12, '0') AS a, 'N' || LPAD(CAST(c_nationkey AS VARCHAR), 12, '0') AS b FROM customer
            UNION ALL SELECT 'S' || LPAD(CAST(s_suppkey AS VARCHAR), 12, '0'), 'N' || LPAD(CAST(s_nationkey AS VARCHAR), 12, '0') FROM supplier
            UNION ALL SELECT 'N' || LPAD(CAST(n_nationkey AS VARCHAR), 12, '0'), 'R' || LPAD(CAST(n_regionkey AS VARCHAR), 12, '0') FROM nation),
        g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        walks AS (SELECT a AS src, b AS dst, 1 AS hops, [a, b] AS path FROM g WHERE a LIKE 'R%'
            UNION ALL SELECT src, g.b, hops + 1, LIST_APPEND(path, g.b) FROM walks JOIN g ON g.a = dst
            WHERE hops < 3 AND NOT LIST_CONTAINS(path, g.b))
        SELECT src, dst, CAST(hops AS BIGINT) AS hops, ARRAY_TO_STRING(path, '>') AS path FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY hops, path) AS k FROM walks) WHERE k = 1""",
    "document_token_estimates": "SELECT doc_id, CAST(CEIL(LENGTH(text) / 4.0) AS BIGINT) AS estimated_tokens FROM documents",
    "prompt_prefix_groups": """SELECT SUBSTR(SHA256(p), 1, 16) AS prefix_hash, COUNT(*) AS case_count,
        CAST(MAX(CEIL(LENGTH(p) / 4.0)) AS BIGINT) AS estimated_tokens
        FROM (SELECT REGEXP_EXTRACT(text, '^[^\\n]*') AS p FROM documents) GROUP BY 1""",
}
