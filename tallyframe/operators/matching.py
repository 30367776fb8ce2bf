"""Dictionary matching and table retrieval over a table of texts.

The dictionary, the catalogue of tables and the stored examples are tables that the tokens of the texts are joined with; they have
no size limit. Rows that have the same tokens are matched once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions.dates import month_references, normalize_months
from tallyframe.functions.literals import constant, let
from tallyframe.functions.words import normalize_tokens, split_words, token_variants, variant_set
from tallyframe.operators.paths import shortest_paths
from tallyframe.shared import written
from tallyframe.sources.semantic import Catalogue, SemanticLayer, unique

# Weights of a token by where it occurs, and boosts by what was recognised.
FIELD_WEIGHTS = {"name": 30, "aliases": 28, "description": 18, "columns": 10, "comments": 6}
BOOSTS = {"entity": (60, 4), "metric": (80, 5), "filter": (70, 5), "join": 20}
_DERIVED_PHRASE = "sales with product filter context"


def question_context(df: DataFrame, text: str = "text") -> DataFrame:
    """Add month references, the text with canonical months, and its tokens."""
    return (
        df.withColumn("month_refs", month_references(F.col(text)))
        .withColumn("normalized_text", normalize_months(F.col(text), F.col("month_refs")))
        .withColumn("tokens", normalize_tokens(F.col("normalized_text")))
    )


@functools.cache
def _tokenised(texts: tuple[str, ...]) -> dict[str, tuple[list[str], list[str], list[list[str]]]]:
    """Words, tokens and token variants of dictionary texts, by the same expressions as the rows."""
    spark = SparkSession.getActiveSession()
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select("t", split_words(F.col("t")).alias("w"), normalize_tokens(F.col("t")).alias("k"))
        .select("t", "w", "k", F.transform("k", token_variants).alias("v"))
        .collect()
    )
    return {r.t: (r.w, r.k, [list(v) for v in r.v]) for r in rows}


class Dictionary:
    """Synonyms of named entries as two tables: what each token and inflection may mean, and the synonyms themselves."""

    _MEANS = ("key", "synonym", "need")
    _SYNONYM = ("synonym", "needs", "entry", "kind", "name", "tables", "text", "phrase", "weight", "alias_only", "longer")

    def __init__(self) -> None:
        self.synonyms: list[tuple] = []
        self.means: list[tuple] = []
        self.entries = 0

    def add(self, kind: str, name: str, synonyms: Sequence[str], tables: Sequence[str], alias_only: Sequence[str], lexicon: dict) -> None:
        only = {" ".join(lexicon[a][0]) for a in alias_only}
        words = {" ".join(lexicon[s][0]): lexicon[s][0] for s in synonyms}
        self.entries += 1
        for s in synonyms:
            w, tokens, variants = lexicon[s]
            if not tokens:
                continue
            phrase, number = " ".join(w), len(self.synonyms)
            longer = [p for p, other in words.items() if p != phrase and len(other) > len(w) and set(w) <= set(other)]
            self.synonyms.append((number, len(tokens), self.entries, kind, name, list(tables), s, phrase, max(1, len(tokens)), phrase in only, longer))
            for need, (token, inflections) in enumerate(zip(tokens, variants)):
                self.means += [(key, number, need) for key in dict.fromkeys((f"t {token}", *(f"v {v}" for v in inflections)))]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Both tables, of a size that Spark knows: it joins them as their size allows."""
        means = pd.DataFrame(self.means, columns=list(self._MEANS))
        synonyms = pd.DataFrame(self.synonyms, columns=list(self._SYNONYM))
        return (
            spark.createDataFrame(means, "key string, synonym int, need int"),
            spark.createDataFrame(synonyms, "synonym int, needs int, entry int, kind string, name string, tables array<string>, text string, phrase string, weight int, "
                                            "alias_only boolean, longer array<string>"))

    def matched(self, df: DataFrame, tokens: str = "tokens") -> DataFrame:
        """Add ``matches``: matched entries of a row with kind, name, tables, matched synonyms, score.

        A synonym matches when each of its tokens occurs or shares an inflection with some token. (A phrase that occurs word
        for word always satisfies this.) An alias-only hit is dropped when a longer hit of the same entry contains its words.

        Rows with the same tokens are matched once. Their tokens and inflections meet the dictionary in an equality join, so the
        cost of a row doesn't grow with the dictionary, and neither has a limit.
        """
        means, synonyms = self.frames(df.sparkSession)
        keyed = df.withColumn("__set", F.sha2(F.to_json(tokens), 256))
        sets = keyed.select("__set", tokens).dropDuplicates(["__set"])
        keys = F.array_distinct(F.concat(F.transform(tokens, lambda t: F.concat(F.lit("t "), t)), F.transform(variant_set(F.col(tokens)), lambda v: F.concat(F.lit("v "), v))))
        met = sets.select("__set", F.explode(keys).alias("key")).join(means, "key").groupBy("__set", "synonym").agg(F.count_distinct("need").alias("met"))
        whole = met.join(synonyms, "synonym").filter("met = needs")
        row = F.struct(*[c for c in self._SYNONYM if c != "needs"])
        found = whole.groupBy("__set").agg(F.array_sort(F.collect_list(row)).alias("__found"))

        def of_entry(every: Column, e: Column) -> Column:
            own = F.filter(every, lambda s: s["entry"] == e)
            kept = let(own, lambda o: F.filter(o, lambda s: ~(s["alias_only"] & F.arrays_overlap(s["longer"], F.transform(o, lambda x: x["phrase"])))))
            return let(F.struct(own[0].alias("first"), kept.alias("kept")), lambda k: F.struct(
                k["first"]["kind"].alias("kind"), k["first"]["name"].alias("name"), k["first"]["tables"].alias("tables"),
                F.transform(k["kept"], lambda s: s["text"]).alias("matched"), F.aggregate(k["kept"], F.lit(0), lambda total, s: total + s["weight"]).alias("score")))

        matches = let(F.col("__found"), lambda f: F.transform(F.array_distinct(F.transform(f, lambda s: s["entry"])), lambda e: of_entry(f, e)))
        by_set = found.select("__set", matches.alias("matches"))
        none = F.expr("cast(array() as array<struct<kind:string,name:string,tables:array<string>,matched:array<string>,score:int>>)")
        return keyed.join(by_set, "__set", "left").withColumn("matches", F.coalesce("matches", none)).drop("__set")


class Matcher:
    """A semantic layer and a catalogue, made ready for matching."""

    def __init__(self, layer: SemanticLayer, catalogue: Catalogue | None = None, examples: Sequence[tuple[str, Sequence[str]]] = ()):
        self.layer, self.catalogue, self.examples = layer, catalogue, tuple(examples)
        named = [(e.name, unique((e.name, *e.synonyms)), e.tables, ()) for e in (*layer.entities, *layer.metrics)]
        filters = []
        for f in layer.filters:
            values = [
                v for a in layer.aliases
                if (f.target_table == "Product" and a.entity == "product") or set(a.target_columns) & set(f.target_columns)
                for v in (a.canonical, *a.aliases)
            ]
            filters.append((f.name, unique(f.synonyms), unique(values), f.target_table))
        rules = [(t, (t,), (), ()) for t, _ in layer.rules]
        texts = {s for e in (*named, *rules) for s in e[1]}
        texts |= {s for f in filters for s in (f[0], *f[1], *f[2])} | {_DERIVED_PHRASE} | {q for q, _ in self.examples}
        if catalogue:
            for t in catalogue.tables:
                texts |= {part for part in self._fields(t).values()}
        lex = _tokenised(tuple(sorted(texts)))
        self._lex = lex
        self.dictionary = Dictionary()
        count = len(layer.entities)
        for i, (name, synonyms, tables, _) in enumerate(named):
            self.dictionary.add("entities" if i < count else "metrics", name, synonyms, tables, (), lex)
        for name, base, values, table in filters:
            base_phrases = {" ".join(lex[b][0]) for b in base}
            only = [v for v in values if " ".join(lex[v][0]) not in base_phrases]
            every = unique((name, *base, *values))
            self.dictionary.add("filters", name, every, (table,) if table else (), only, lex)
        for trigger, synonyms, tables, _ in rules:
            self.dictionary.add("rules", trigger, synonyms, tables, (), lex)

    @staticmethod
    def _fields(t) -> dict[str, str]:
        return {
            "name": t.name, "aliases": " ".join(t.aliases), "description": t.description,
            "columns": " ".join(t.columns), "comments": " ".join(t.comments),
        }

    def plan(self, df: DataFrame) -> DataFrame:
        """Add matched entities, metrics, filters and rules, required tables and join hints."""
        layer = self.layer
        df = self.dictionary.matched(df)
        of = lambda kind: F.filter("matches", lambda m: m["kind"] == kind).alias(kind)
        df = df.select("*", *[of(kind) for kind in ("entities", "metrics", "filters", "rules")]).drop("matches")
        if layer.line_metric and layer.general_metric:
            in_play = F.exists("entities", lambda e: e["name"].isin(*layer.product_entities)) | F.exists(
                "filters", lambda f: F.exists(f["tables"], lambda t: t.isin(*layer.product_tables))
            )
            has = lambda n: F.exists("metrics", lambda m: m["name"] == n)
            line = next(m for m in layer.metrics if m.name == layer.line_metric)
            derived = constant([{
                "kind": "metrics", "name": line.name, "tables": list(line.tables), "matched": [_DERIVED_PHRASE],
                "score": len(self._lex[_DERIVED_PHRASE][1]),
            }])
            extra = in_play & has(layer.general_metric) & ~has(layer.line_metric)
            df = df.withColumn("metrics", F.when(extra, F.concat("metrics", derived)).otherwise(F.col("metrics")))
        tables = [F.flatten(F.transform(c, lambda e: e["tables"])) for c in ("entities", "metrics", "filters")]
        df = df.withColumn("required_tables", F.array_distinct(F.concat(*tables)))
        paths = [{"name": p.name, "tables": list(p.tables)} for p in layer.paths]
        hints = (
            let(F.col("required_tables"), lambda r: F.filter(
                constant(paths), lambda p: F.forall(p["tables"], lambda t: F.array_contains(r, t))))
            if paths
            else F.expr("cast(array() as array<struct<name:string,tables:array<string>>>)")
        )
        return df.withColumn("join_hints", hints)

    def postings(self, spark: SparkSession) -> DataFrame:
        """token, table, weight: what each token of a table's fields adds to its score."""
        fields = [(t.name, FIELD_WEIGHTS[field], text) for t in self.catalogue.tables for field, text in self._fields(t).items()]
        rows = spark.createDataFrame(fields, "table string, weight int, text string")
        return rows.select("table", "weight", F.explode(normalize_tokens(F.col("text"))).alias("token")).groupBy("token", "table").agg(F.sum("weight").cast("int").alias("weight"))

    def score_tables(self, df: DataFrame, postings: DataFrame | None = None) -> DataFrame:
        """Add ``table_scores``: lexical + semantic score of each catalogue table that has any, best first.

        ``postings`` (token, table, weight) may be any table; by default it is made from the catalogue. Tokens and boosts are joined
        with it once for each distinct set of them.
        """
        def boost(column: str, kind: str) -> Column:
            base, step = BOOSTS[kind]
            return F.flatten(F.transform(column, lambda e: F.transform(e["tables"], lambda t: F.struct(
                t.alias("table"), (F.lit(base) + e["score"] * step).alias("points")))))

        joins = F.flatten(F.transform("join_hints", lambda h: F.transform(h["tables"], lambda t: F.struct(
            t.alias("table"), F.lit(BOOSTS["join"]).alias("points")))))
        df = df.withColumn(
            "boosts", F.concat(boost("entities", "entity"), boost("metrics", "metric"), boost("filters", "filter"), joins)
        ).withColumn("context", F.sha2(F.to_json(F.struct(F.array_sort("tokens").alias("t"), F.array_sort("boosts").alias("b"))), 256))
        contexts = df.groupBy("context").agg(F.any_value("tokens").alias("tokens"), F.any_value("boosts").alias("boosts"))
        postings = self.postings(df.sparkSession) if postings is None else postings
        lexical = contexts.select("context", F.explode(F.array_distinct("tokens")).alias("token")).join(postings, "token").select(
            "context", "table", F.col("weight").alias("lexical"), F.lit(0).alias("semantic"))
        semantic = contexts.select("context", F.inline("boosts")).select("context", "table", F.lit(0).alias("lexical"), F.col("points").alias("semantic"))
        sums = lexical.union(semantic).groupBy("context", "table").agg(F.sum("lexical").cast("int").alias("lexical"), F.sum("semantic").cast("int").alias("semantic"))
        entry = F.struct((-(F.col("lexical") + F.col("semantic"))).alias("negated"), F.col("table").alias("name"), "lexical", "semantic")
        scores = sums.groupBy("context").agg(F.array_sort(F.collect_list(entry)).alias("table_scores"))
        none = F.expr("cast(array() as array<struct<negated:int,name:string,lexical:int,semantic:int>>)")
        return df.join(scores, "context", "left").withColumn("table_scores", F.coalesce("table_scores", none)).drop("context")

    def retrieve(self, df: DataFrame, max_tables: int = 4, max_hops: int = 3) -> DataFrame:
        """Add ``selected`` (top tables, then required ones) and ``connectors`` between them."""
        df = self.score_tables(self.plan(question_context(df)))
        default = [t.name for t in self.catalogue.tables[:max_tables]]

        def chosen(ctx: Column) -> Column:
            ranked = F.transform(ctx["scores"], lambda s: s["name"])
            top = F.transform(F.slice(F.filter(ctx["scores"], lambda s: s["negated"] < 0), 1, max_tables), lambda s: s["name"])
            required = F.filter(ranked, lambda n: F.array_contains(ctx["required"], n))
            both = F.array_distinct(F.concat(top, required))
            return let(both, lambda b: F.when(F.size(b) > 0, b).otherwise(constant(default)))

        context = F.struct(F.col("table_scores").alias("scores"), F.col("required_tables").alias("required"))
        df = df.withColumn("selected", let(context, chosen))
        return df.withColumn("connectors", let(F.col("selected"), lambda s: self._connectors(s, max_hops)))

    def _connectors(self, selected: Column, max_hops: int) -> Column:
        """Tables on the shortest paths between selected tables that are not selected themselves."""
        between = _catalogue_paths(self.catalogue, max_hops)
        if not between:
            return F.expr("cast(array() as array<string>)")
        known = F.map_from_entries(constant([{"pair": k, "inner": v} for k, v in between.items()]))
        none = F.expr("cast(array() as array<string>)")
        pairs = F.flatten(F.transform(selected, lambda a, i: F.transform(
            F.slice(selected, i + 2, F.size(selected)), lambda b: F.concat_ws(">", a, b))))
        inner = F.flatten(F.transform(pairs, lambda p: F.coalesce(F.try_element_at(known, p), none)))
        return F.array_except(F.array_distinct(inner), selected)

    def examples_for(self, df: DataFrame, limit: int = 2, min_score: int = 1) -> DataFrame:
        """Add ``examples``: the configured questions that share most tokens."""
        stored = df.sparkSession.createDataFrame([(q, list(t)) for q, t in self.examples], "question string, tables array<string>")
        return nearest_examples(df, stored, limit, min_score)


@functools.cache
def _catalogue_paths(catalogue: Catalogue, max_hops: int) -> dict[str, list[str]]:
    """Inner nodes of the shortest path for each pair of catalogue tables (at most tables squared)."""
    spark = SparkSession.getActiveSession()
    if not catalogue.edges:
        return {}
    edges = spark.createDataFrame(list(catalogue.edges), "a string, b string")
    tables = spark.createDataFrame([(n,) for n in sorted({n for e in catalogue.edges for n in e})], "table string")
    rows = shortest_paths(edges, tables, max_hops).filter(F.size("path") > 2).collect()
    return {f"{r.src}>{r.dst}": r.path[1:-1] for r in rows}


def nearest_examples(df: DataFrame, stored: DataFrame, limit: int = 2, min_score: int = 1) -> DataFrame:
    """Add ``examples``: of the stored questions (question, tables) the ``limit`` that share most tokens with each row's ``tokens``,
    ties by question.

    Only tokens that some row has can be shared. Stored questions with the same such tokens share one score, so of each set of them only
    the first ``limit`` are kept, before anything is joined: what remains grows with the sets of asked tokens, not with the store. Distinct token
    sets of the rows look up sets by their rarest stored token first, then by twice as many tokens a round: a set that holds none
    of the tokens looked up shares at most those left over, so a row is done once its ``limit`` best share more than that. Rows with
    none left are done with all of them. The best of each are kept before they are shuffled.
    """
    named = lambda tokens: F.sha2(F.array_join(F.array_sort(tokens), " "), 256)
    first = lambda keys, *order: W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("context", named("tokens"))
    contexts = written(rows.groupBy("context").agg(F.any_value("tokens").alias("tokens")).select("context", F.explode(F.array_distinct("tokens")).alias("token")))
    vocabulary = written(contexts.select("token").distinct())
    asked = lambda questions: questions.select("question", F.explode(F.array_distinct(normalize_tokens(F.col("question")))).alias("token")).join(vocabulary, "token")
    # a set by two hashes of 64 bits and its size; a question's tokens are where its copies were folded, so one shuffle does for both
    marks = [F.bit_xor(F.xxhash64("token")).alias("one"), F.bit_xor(F.xxhash64(F.lit(7), "token")).alias("other"), F.count("*").alias("size")]
    sets = asked(stored.select("question").distinct()).groupBy("question").agg(*marks)
    leading = written(sets.withColumn("n", F.row_number().over(first(["one", "other", "size"], "question"))).where(F.col("n") <= limit).select("question", "n"))
    own = asked(leading).groupBy("question").agg(F.array_sort(F.collect_list("token")).alias("own"))
    tables = stored.join(leading, "question", "left_semi").groupBy("question").agg(F.any_value("tables").alias("tables"))
    kept = written(leading.join(own, "question").join(tables, "question").withColumn("set", named("own")))
    # a set counts by its first question, so sets beyond the limit can't be among the best
    postings = written(kept.where("n = 1").select(F.explode("own").alias("token"), "set", "own", F.col("question").alias("lead")))
    counts = postings.groupBy("token").agg(F.count("*").alias("stored"))
    by_rarity = F.array_sort(F.collect_list(F.struct("stored", "token")))
    live = written(contexts.join(counts, "token").groupBy("context").agg(by_rarity.alias("cells")).select("context", F.col("cells.token").alias("tokens")))
    looked_up, done = 1, []
    while not live.isEmpty():
        probes = live.select("context", "tokens", F.explode(F.slice("tokens", 1, looked_up)).alias("token")).join(postings, "token")
        scored = probes.select("context", "set", "lead", F.size(F.array_intersect("tokens", "own")).alias("shared"), (F.size("tokens") - looked_up).alias("left_over"))
        if looked_up > 1:
            scored = scored.dropDuplicates(["context", "set"])
        best = written(scored.withColumn("n", F.row_number().over(first(["context"], F.desc("shared"), "lead"))).where(F.col("n") <= limit))
        settled = written(best.groupBy("context").agg(F.when(F.count("*") == limit, F.min("shared")).otherwise(0).alias("least"), F.any_value("left_over").alias("left_over")).where(
            "left_over <= 0 OR least > left_over").select("context"))
        done.append(best.join(settled, "context", "left_semi").select("context", "set", "shared"))
        live = written(live.join(settled, "context", "left_anti"))
        looked_up *= 2
    if not done:
        return rows.drop("context").withColumn("examples", F.expr("cast(array() as array<struct<negated:int,question:string,tables:array<string>>>)"))
    found = functools.reduce(DataFrame.union, done).where(F.col("shared") >= min_score).join(kept.drop("n", "own"), "set")
    ranked = found.withColumn("n", F.row_number().over(first(["context"], F.desc("shared"), "question"))).where(F.col("n") <= limit)
    entry = F.struct((-F.col("shared")).alias("negated"), "question", "tables")
    listed = ranked.groupBy("context").agg(F.array_sort(F.collect_list(entry)).alias("examples"))
    none = F.expr("cast(array() as array<struct<negated:int,question:string,tables:array<string>>>)")
    return rows.join(listed, "context", "left").withColumn("examples", F.coalesce("examples", none)).drop("context")


def once_per_text(df: DataFrame, text: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` applied to the distinct texts, and its columns joined back to every row that has the text; a null text keeps its row."""
    known = work(df.select(text).where(F.col(text).isNotNull()).distinct())
    return df.join(known, text, "left")
