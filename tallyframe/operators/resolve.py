"""Entity resolution: mentions in texts against any master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.literals import constant, let
from tallyframe.functions.words import search_text
from tallyframe.shared import written
from tallyframe.sources.semantic import Alias, unique

# Points by how a term matches.
TIERS = {"exact_field": 100, "field_prefix": 85, "word_phrase": 75, "substring": 60, "token_overlap": 45}
GRAM = 3


def mentions_from_filters(planned: DataFrame, table: str, id_column: str) -> DataFrame:
    """Distinct (id, mention) rows from matched filter hints that aim at a table."""
    aimed = F.filter("filters", lambda f: F.array_contains(f["tables"], table))
    values = F.array_distinct(F.flatten(F.transform(aimed, lambda f: F.transform(f["matched"], lambda m: F.trim(m)))))
    return planned.select(id_column, F.explode_outer(values).alias("mention")).filter("mention <> ''")


def expand_mentions(mentions: DataFrame, aliases: Sequence[Alias]) -> DataFrame:
    """Add ``terms``: the mention, then every member of an alias ring it belongs to."""
    rings: dict[str, list[str]] = {}
    for a in aliases:
        members = unique((a.canonical, *a.aliases))
        for m in members:
            key = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in m.lower()).split())
            rings.setdefault(key, []).extend(members)
    own = F.array(F.col("mention"))
    if not rings:
        return mentions.withColumn("terms", own)
    known = F.map_from_entries(constant([{"key": k, "members": list(unique(v))} for k, v in rings.items()]))
    ring = F.coalesce(F.try_element_at(known, search_text(F.col("mention"))), F.expr("cast(array() as array<string>)"))
    return mentions.withColumn("terms", F.array_distinct(F.concat(own, ring)))


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths."""
    def of(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
            F.expr("cast(array() as array<string>)"))

    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def find_candidates(
    expanded: DataFrame, master: DataFrame, key: str, search_columns: Sequence[str]
) -> DataFrame:
    """Every (mention, master row) where a normalised term is a substring of a search column.

    A term can only be a substring where its rarest three-character piece occurs, so terms and the distinct texts of the
    rows meet on that piece alone; what they find is joined back to the rows. Shorter pieces are cut only where a term is shorter.
    Neither side is collected and no pair is cut off. A pair that several terms would find is emitted by the first of them.

    Spark judges a table by the size of its files, which says little about rows that repeat a few texts or are cut into pieces.
    So only pieces are sent to every task, of which normalised terms have at most 37 ** 3 + 37 ** 2 + 37 different ones; the
    joins that carry rows, texts or mentions are merges.
    """
    terms = written(
        expanded.select("mention", "terms")
        .distinct()
        .select("mention", "terms", F.transform("terms", search_text).alias("normal"))
        .select("mention", "terms", "normal", F.posexplode("normal").alias("position", "term"))
        .filter("term <> ''")
    )
    pieces = terms.select("mention", "position", F.explode(F.array_distinct(_pieces(F.col("term")))).alias("gram"))
    sizes = sorted(r[0] for r in pieces.select(F.length("gram")).distinct().collect()) or [GRAM]  # one to three numbers
    fields = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in search_columns]
    rows = master.select(F.col(key).alias("__key"), *search_columns).withColumn("__fields", F.array(*fields))
    texts = written(rows.select("__fields").distinct())
    grams = texts.select("__fields", F.explode(F.array_distinct(F.flatten(F.transform("__fields", lambda f: _grams(f, sizes))))).alias("gram"))
    among = lambda some: grams.join(F.broadcast(some.select("gram").distinct()), "gram", "left_semi")
    frequency = among(pieces).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = written(
        pieces.join(F.broadcast(frequency), "gram", "left")
        .groupBy("mention", "position")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .filter("best.n > 0")
        .select("mention", "position", F.col("best.gram").alias("gram"))
    )
    blocked = terms.hint("merge").join(rarest, ["mention", "position"])
    holds = lambda t: F.exists("__fields", lambda f: F.contains(f, t))
    first = F.get(F.filter(F.col("normal"), lambda t: (t != "") & holds(t)), F.lit(0))
    found = (
        among(rarest).hint("merge").join(blocked, "gram")
        .filter(F.array_position("normal", first) == F.col("position") + 1)
        .select("__fields", "mention", "terms", "normal")
    )
    # every row with the text, whether its key is null or repeated
    return rows.hint("merge").join(found, "__fields").drop("__fields")


def _pieces(term: Column) -> Column:
    """The three-character pieces of a term, or the whole term when it is shorter."""
    last = F.length(term) - GRAM + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(term, i, F.lit(GRAM)))).otherwise(
        F.array(term))


def score_candidates(pairs: DataFrame, search_columns: Sequence[str]) -> DataFrame:
    """Add score, match_type and matched_value: the best tier of any term, the first term on ties."""
    fields = F.filter(F.array(*[search_text(F.col(c).cast("string")) for c in search_columns]), lambda f: f != "")
    combined = search_text(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in search_columns]))
    space = F.lit(" ")

    def tier(t: Column, ctx: Column) -> Column:
        values, text = ctx["fields"], ctx["combined"]
        return (
            F.when(t == "", F.lit(None))
            .when(F.array_contains(values, t), "exact_field")
            .when(F.exists(values, lambda v: F.startswith(v, F.concat(t, space))), "field_prefix")
            .when(F.exists(values, lambda v: F.contains(v, F.concat(space, t, space)) | F.endswith(v, F.concat(space, t))), "word_phrase")
            .when(F.contains(text, t), "substring")
            .when(F.forall(F.split(t, " "), lambda w: F.contains(text, w)), "token_overlap")
        )

    points = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    every = let(
        F.struct(fields.alias("fields"), combined.alias("combined"), F.col("normal"), F.col("terms")),
        lambda ctx: F.transform(ctx["normal"], lambda t, i: let(tier(t, ctx), lambda kind: F.struct(
            F.coalesce(F.try_element_at(points, kind), F.lit(0)).alias("score"), (-i).alias("order"),
            kind.alias("match_type"), F.get(ctx["terms"], i).alias("matched_value")))),
    )
    return pairs.withColumn("__best", F.array_max(every)).select(
        "*", "__best.score", "__best.match_type", "__best.matched_value"
    ).drop("__best", "normal")


def rank_candidates(scored: DataFrame, name: str, limit_per_term: int = 20) -> DataFrame:
    """Best candidates per mention: score, then name, then key. The limit is applied before the shuffle too."""
    order = W.partitionBy("mention").orderBy(
        F.desc("score"), F.coalesce(F.col(name), F.lit("")).asc(), F.col("__key").asc()
    )
    return (
        scored.filter("score > 0").withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit_per_term)
    )


def resolve_entities(
    mentions: DataFrame,
    master: DataFrame,
    key: str,
    search_columns: Sequence[str],
    aliases: Sequence[Alias] = (),
    limit_per_term: int = 20,
) -> DataFrame:
    """One row per mention with its ranked candidates; mentions without any keep an empty list.

    All candidates are scored, whatever their number; only the ranked list is limited.
    """
    expanded = expand_mentions(mentions.select("mention").distinct(), aliases)
    pairs = find_candidates(expanded, master, key, search_columns)
    ranked = rank_candidates(score_candidates(pairs, search_columns), search_columns[0], limit_per_term)
    found = ranked.groupBy("mention").agg(
        F.array_sort(F.collect_list(F.struct(
            "position", F.col("__key").alias("key"), F.col(search_columns[0]).alias("name"), "score", "match_type", "matched_value",
        ))).alias("candidates")
    )
    return expanded.join(found, "mention", "left").select(
        "mention", "terms", "candidates", F.coalesce(F.size("candidates"), F.lit(0)).alias("candidate_count")
    )
