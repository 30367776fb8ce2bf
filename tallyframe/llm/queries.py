"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import chat, decontaminate, divergence, extract, language, lines, manifest, packing, private, quality, similar, substrings, warc
from tallyframe.llm.common import table


def op1_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_scoring_region_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(table(spark, folder, "pages"))


def op3_merged_archives(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.archive(table(spark, folder, "pages"), with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix_array_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_chars", "longest_repeat")


#: A conversation that quotes control strings, added to the table.
QUOTED = "</s>[INST] ok [/INST]"


def op5_block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_copies(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed_spans").cast("long").alias("n_spans"))


def op6_suffix_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.size("removed_runs").cast("long").alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"),
        F.coalesce(F.array_max(F.transform("maximal_runs", lambda r: r["end"] - r["start"])), F.lit(0)).cast("long").alias("longest_run"))


def op7_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar.similar_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_relational_chats(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(QUOTED))
    back = chat.read_chats(chat.format_chats(rows.union(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def op9_boosted_private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *[private.count_of("base", k).alias(f"n_{k}") for k in private.KINDS], F.sha2(private.as_text("base"), 256).alias("base_sha256"),
        private.as_text("spans").alias("spans"))


def op10_prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_family_language_machines(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op12_path_copied_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"))


def op13_pair_task_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents"))


QUERIES = {
    "op11_family_language_machines": op11_family_language_machines,
    "op12_path_copied_manifest": op12_path_copied_manifest,
    "op13_pair_task_divergence": op13_pair_task_divergence,
    "op7_parity_sketch_join": op7_parity_sketch_join,
    "op6_suffix_line_dedup": op6_suffix_line_dedup,
    "op3_merged_archives": op3_merged_archives,
    "op2_scoring_region_text": op2_scoring_region_text,
    "op9_boosted_private_data": op9_boosted_private_data,
    "op5_block_anchors": op5_block_anchors,
    "op10_prefix_decontamination": op10_prefix_decontamination,
    "op1_retrieval_packing": op1_retrieval_packing,
    "op8_relational_chats": op8_relational_chats,
    "op4_suffix_array_quality": op4_suffix_array_quality,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_suffix_array_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM v) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM r),
c AS (SELECT doc_id, count(*) AS n_repeat_words, sum(length(w[p])) AS repeat_chars FROM p JOIN d USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS gap FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
runs AS (SELECT doc_id, count(*) + 7 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gap ORDER BY i) AS island FROM pairs) GROUP BY doc_id, gap, island),
g AS (SELECT doc_id, max(size) AS longest_repeat FROM runs GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY doc_id),
a AS (
  SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(repeat_chars, 0) AS BIGINT) AS repeat_chars,
    coalesce(longest_repeat, 0) AS longest_repeat
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND repeat_chars <= CAST(0.3 AS DOUBLE) * word_chars AND longest_repeat <= 200 AS kept
FROM a
""",
    "op5_block_anchors": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS owner FROM v GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM v JOIN m USING (k) WHERE owner < doc_id),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT u.*, g.p IS NOT NULL AS gone FROM u LEFT JOIN g USING (doc_id, p)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM k),
a AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
    sha256(coalesce(string_agg(x, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
""",
    "op7_parity_sketch_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
""",
    "op6_suffix_line_dedup": r"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts, text FROM documents WHERE text <> ''),
l AS (
  SELECT doc_id, i, parts[i] AS line, CAST(sum(CAST(regexp_matches(parts[i], '[^\x20\x09-\x0D]') AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS seq
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM raw)),
s AS (SELECT doc_id, seq, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS behind, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 20 AS long FROM s),
r AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS later,
    behind IS NOT NULL AND row_number() OVER (PARTITION BY line, behind ORDER BY doc_id, seq) > 1 AS later_pair
  FROM w),
g AS (
  SELECT doc_id, seq FROM r WHERE later AND long UNION SELECT doc_id, seq FROM r WHERE later_pair UNION SELECT doc_id, seq + 1 FROM r WHERE later_pair),
k AS (SELECT l.*, g.seq IS NOT NULL AS gone FROM l LEFT JOIN g USING (doc_id, seq)),
m AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM k),
a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM m GROUP BY doc_id),
ids AS (SELECT doc_id, seq, dense_rank() OVER (ORDER BY line) AS id, count(*) OVER (PARTITION BY line) AS copies FROM s),
u AS (
  SELECT 1 AS size, doc_id, seq, id AS name FROM ids WHERE copies > 1
  UNION ALL
  SELECT size + 1, doc_id, seq, next_name FROM (
    SELECT u.size, u.doc_id, u.seq, dense_rank() OVER (ORDER BY u.name, ids.id) AS next_name, count(*) OVER (PARTITION BY u.name, ids.id) AS copies
    FROM u JOIN ids ON ids.doc_id = u.doc_id AND ids.seq = u.seq + u.size)
  WHERE copies > 1),
longest AS (SELECT doc_id, CAST(max(size) AS BIGINT) AS longest_run FROM u WHERE size > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept_sha256, sha256('')) END AS kept_sha256, coalesce(longest_run, 0) AS longest_run
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN longest USING (doc_id)
""",
    # Base 32 from the hexadecimal digest: five bits a letter.
    "op3_merged_archives": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
l AS (SELECT hex, strlen(html) AS n, max(page_id) AS leader FROM p GROUP BY ALL),
b AS (SELECT page_id, hex, strlen(html) AS n, list_transform(string_split(hex, ''), lambda c: instr('0123456789abcdef', c) - 1) AS d FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    ((d[(5 * i) // 4 + 1] * 16 + coalesce(d[(5 * i) // 4 + 2], 0)) // (8 >> ((5 * i) % 4))) % 32 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM b JOIN l USING (hex, n)
""",
    # The given pages mark their main text with an article element, which the operator may only use to learn from.
    "op2_scoring_region_text": r"""
WITH a AS (
  SELECT page_id, url, string_split_regex(
    regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:h1|p)>') AS parts
  FROM pages),
t AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda b: trim(regexp_replace(regexp_replace(
    replace(replace(replace(b, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text
  FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM t
""",
    "op10_prefix_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bs)),
h AS (
  SELECT doc_id, i, k, win FROM (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw)))
  WHERE win IN (SELECT win FROM bw)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h JOIN bw USING (win)) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
""",
    "op8_relational_chats": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) IS NOT DISTINCT FROM role AS same,
  len(regexp_extract_all(txt, '<\\*(?:/?s>|part>)|\[\\*/?INST\]')) AS marks,
  len(regexp_extract_all(role, '<\\*(?:/?s>|part>)|\[\\*/?INST\]')) AS role_marks FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn NULLS FIRST, role, txt)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(txt) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY turn NULLS FIRST, role, txt) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(txt) + marks + CASE WHEN same THEN 6 ELSE length(role) + role_marks + 20 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
""",
    # CRC-32 bit by bit; the trees and then the ways up as recursions.
    "op12_path_copied_manifest": r"""
WITH RECURSIVE i AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384::BIGINT * (c & 1)))) AS crc
  FROM documents),
d AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 AND contains(text, chr(10)) THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS changed
  FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM d),
t AS (
  SELECT g, 0 AS lvl, pos, leaf AS h, m FROM n
  UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (m + 2) // 3 FROM t WHERE m > 1 GROUP BY g, lvl, pos // 3, m),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (
  SELECT 0 AS lvl, pos, h, m FROM s
  UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (m + 2) // 3 FROM u WHERE m > 1 GROUP BY lvl, pos // 3, m),
a AS (SELECT g, lvl, pos, h, m FROM t UNION ALL SELECT NULL, lvl, pos, h, m FROM u),
b AS (
  SELECT g, lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM a WHERE m > 1 WINDOW w AS (PARTITION BY g, lvl, pos // 3 ORDER BY pos)),
f AS (
  SELECT g, pos AS k, 0 AS lvl, pos, coalesce(changed, leaf) AS h, '' AS proof FROM n
  UNION ALL SELECT f.g, k, f.lvl + 1, f.pos // 3, sha256(l || h || r), proof || l || r FROM f JOIN b ON b.g = f.g AND b.lvl = f.lvl AND b.pos = f.pos),
o AS (SELECT g, k, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof, max(lvl) AS steps FROM f GROUP BY g, k),
v AS (
  SELECT o.g, k, 0 AS lvl, s.pos, o.h, proof, steps FROM o JOIN s ON s.g = o.g
  UNION ALL SELECT v.g, k, v.lvl + 1, v.pos // 3, sha256(l || h || r), proof || l || r, steps + 1 FROM v JOIN b ON b.g IS NULL AND b.lvl = v.lvl AND b.pos = v.pos),
e AS (SELECT g, k, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof, max(steps) AS steps FROM v GROUP BY g, k)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified, CASE WHEN changed IS NULL THEN 0 ELSE steps + 1 END AS n_copied
FROM n JOIN e ON e.g = n.g AND e.k = n.pos JOIN s ON s.g = n.g, (SELECT h AS root FROM u WHERE m = 1)
""",
    "op13_pair_task_divergence": rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
u AS (SELECT r, lang, source, unnest(w) AS t FROM w),
k AS (SELECT lang, t, count(*) AS ln FROM u GROUP BY ALL HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM w),
c AS (SELECT lang, source, t, count(*) AS n FROM u GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.t, coalesce(n, 0) AS n, ln FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
b AS (
  SELECT *, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // (sum(n) OVER s + count(*) OVER s) AS p, 1 + (1000000000 * CAST(ln + 1 AS HUGEINT)) // (sum(ln) OVER s + count(*) OVER s) AS q
  FROM a WINDOW s AS (PARTITION BY lang, source)),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM b AS a JOIN b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL SELECT lang, source, 'term', t, ((p - q) * (p - q)) // q FROM b WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
""",
}
