"""Personal data: pattern spans that always count, and candidates that boosted trees accept. DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.common import row_key, written

KINDS = ("email", "ip", "card", "phone")

# Written so that a match starts where a run of its characters starts and never goes back inside it: linear on any text.
# \G lets an address begin right behind another one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes that people write besides: spelt-out addresses, the long form of newer IPs, other separators, national numbers.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}"
             r"|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,4})",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([./_\x{00A0}\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+",
    "phone": r"(?<![0-9A-Za-z.+-])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_NEAR = 24
#: Words that stand near each kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|kontakt|correo|courriel)\b", "ip": r"(?i)\b(ip|host|server|address|addr|adresse)\b",
    "card": r"(?i)\b(card|visa|credit|amex|mastercard|karte|carte|tarjeta)\b", "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|telefon|teléfono|téléphone)\b",
}


def _gate(kind: str, more: bool, text: Column) -> Column:
    """Cheap test that lets a text without the kind's signs skip its pattern."""
    if kind == "email":
        return (text.contains("@") | text.contains("[at]") | text.contains("(at)") | text.contains("{at}") | text.contains(" dot ")) if more else text.contains("@")
    if kind == "ip" and more:
        return text.contains(":")
    return text.contains("+") if kind == "phone" and not more else text.rlike("[0-9]")


def matches(docs: DataFrame) -> DataFrame:
    """Every match of every pattern: keys, kind, more (not a base pattern), i, hit, gap (characters since the match before), before, after."""
    patterns = [(kind, more, (MORE if more else BASE)[kind]) for more in (False, True) for kind in KINDS]
    text = F.col("text")
    hits = docs.select("key_a", "key_b", "text", *[
        F.when(_gate(kind, more, text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"hit{n}") for n, (kind, more, p) in enumerate(patterns)])
    some = hits.where(F.greatest(*[F.coalesce(F.size(f"hit{n}"), F.lit(0)) for n in range(len(patterns))]) > 0)
    gaps = some.select("*", *[F.when(F.size(f"hit{n}") > 0, F.split(text, p, -1)).alias(f"gap{n}") for n, (_, _, p) in enumerate(patterns)])

    def found(n: int, kind: str, more: bool) -> Column:
        def one(hit: Column, i: Column) -> Column:
            before, after = F.get(F.col(f"gap{n}"), i), F.get(F.col(f"gap{n}"), i + 1)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), F.lit(more).alias("more"), i.alias("i"), hit.alias("hit"), F.char_length(before).alias("gap"),
                F.right(before, F.lit(_NEAR)).alias("before"), F.left(after, F.lit(_NEAR)).alias("after"))
        return F.coalesce(F.transform(f"hit{n}", one), F.array().cast("array<struct<kind:int,more:boolean,i:int,hit:string,gap:int,before:string,after:string>>"))

    rows = gaps.select("key_a", "key_b", F.explode(F.concat(*[found(n, kind, more) for n, (kind, more, _) in enumerate(patterns)])).alias("m"))
    return rows.select("key_a", "key_b", "m.*")


def _part_fits(part: Column) -> Column:
    short = F.ltrim(part, F.lit("0"))
    return F.when(F.char_length(short) > 3, False).when(short == "", True).otherwise(short.cast("int") <= 255)


def judged(found: DataFrame) -> DataFrame:
    """The matches with start, end (code points) and whether they hold by the rule of their kind."""
    order = W.partitionBy("key_a", "key_b", "kind", "more").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.char_length("hit")
    placed = found.dropDuplicates(["key_a", "key_b", "kind", "more", "i"]).withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.char_length(digits)
    holds = (
        F.when(F.col("kind") == KINDS.index("email"), True)
        .when(F.col("kind") == KINDS.index("ip"), F.forall(F.split("hit", r"\."), _part_fits))
        .when(F.col("kind") == KINDS.index("card"), n.between(12, 19) & F.call_function("luhn_check", digits))
        .otherwise(n.between(9, 15)))
    return placed.withColumn("holds", F.when(F.col("more"), F.lit(None).cast("boolean")).otherwise(holds))


FEATURES = (
    [f"is_{k}" for k in KINDS] + ["digits", "length", "groups", "longest_group", "signs", "luhn", "small_parts", "letter_before", "letter_after", "digit_near"]
    + [f"near_{k}" for k in KINDS])


def features(spans: DataFrame) -> DataFrame:
    """Format and context of each match as numbers."""
    hit, near = F.col("hit"), F.concat_ws(" ", "before", "after")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    groups = F.filter(F.split(hit, "[^0-9]+", -1), lambda g: g != "")
    values = {f"is_{k}": F.col("kind") == i for i, k in enumerate(KINDS)} | {
        "digits": F.char_length(digits), "length": F.char_length(hit), "groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)), "signs": F.char_length(F.regexp_replace(hit, "[A-Za-z0-9]", "")),
        "luhn": F.when(digits != "", F.call_function("luhn_check", digits)).otherwise(False), "small_parts": F.forall(groups, _part_fits),
        "letter_before": F.col("before").rlike(r"[A-Za-z]$"), "letter_after": F.col("after").rlike(r"^[A-Za-z]"),
        "digit_near": F.col("before").rlike(r"[0-9][.,:/ ]?$") | F.col("after").rlike(r"^[.,:/ ]?[0-9]"),
    } | {f"near_{k}": near.rlike(p) for k, p in CONTEXT.items()}
    values |= {n: F.least(values[n], F.lit(_MOST)) for n in ("digits", "length", "groups", "longest_group", "signs")}
    return spans.withColumns({name: values[name].cast("double") for name in FEATURES})


#: Digits, lengths and groups beyond this say no more, so a feature has few values and the trees try a split between any two.
_MOST = 64
#: Probabilities are compared in steps of this part.
_GRID = 10_000


def folded(spans: DataFrame, *labels: str) -> DataFrame:
    """Equal rows of features and labels as one row with their number as its weight."""
    return features(spans).groupBy(*labels, *FEATURES).agg(F.count("*").cast("double").alias("weight"))


def accepted(spans: DataFrame, precision: float, floor: float) -> DataFrame | None:
    """The matches of the wider patterns that the trees accept, with their probability; None where there is nothing to learn or judge.

    Labels: what the base patterns matched, true where the rule of the kind holds. Half of all such rows, by their hashes, fit the
    trees; the other half gives the threshold, the least probability (in steps of 1 / _GRID) from which on `precision` of them hold, never
    under `floor`. Equal rows are folded into one with a weight, so the fit grows with the different rows of features, and
    the threshold comes from one count for each step.
    """
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    more = spans.where("more")
    if more.isEmpty():
        return None
    half = F.pmod(F.xxhash64("key_a", "key_b", "kind", "start"), F.lit(2)).alias("half")
    labelled = written(folded(spans.where(~F.col("more")).select("*", F.col("holds").cast("double").alias("label"), half), "label", "half").orderBy("half", "label", *FEATURES))
    if labelled.where("half = 0").select("label").distinct().count() < 2:
        return None
    # the candidates for splits come from at least max(10,000, maxBins ** 2) rows, which no folded table of these features reaches in practice
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=11, maxBins=512, weightCol="weight").fit(assembler.transform(labelled.where("half = 0")))
    chance = vector_to_array("probability")[1].alias("chance")
    step = F.floor(F.col("chance") * _GRID)
    held = model.transform(assembler.transform(labelled.where("half = 1"))).select("weight", "label", chance)
    counts = held.groupBy(step.alias("step")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("right")).collect()  # at most _GRID rows
    threshold, n, right = _GRID, 0.0, 0.0
    for row in sorted(counts, reverse=True):
        n, right = n + row.n, right + row.right
        if right >= precision * n:
            threshold = row.step
    kept = model.transform(assembler.transform(features(more))).select("*", chance)
    return kept.where((step >= threshold) & (F.col("chance") >= floor)).select("key_a", "key_b", "kind", "start", "end", "chance")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", precision: float = 0.99, floor: float = 0.9) -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, kind, end) in order; positions are code points, kind numbers KINDS.

    base: matches of the base patterns whose rule holds. spans: those, and matches of wider patterns that overlap none of them and
    that boosted trees accept by format and context (see `accepted`); of overlapping accepted ones the most probable stays.

    Scale: a text is scanned once where it stands; only matches are shuffled, by document. A running sum over a document's
    matches gives their places. The trees are fitted on half of all base matches, equal ones folded.

    A null or empty text has no spans. Equal rows get equal spans, each its own row; a null doc_id stays null. Other columns are not read.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    found = written(judged(written(matches(keyed))))
    base = found.where("holds").select("key_a", "key_b", "kind", "start", "end", F.lit(None).cast("double").alias("chance"))
    extra = accepted(found, precision, floor)
    both = base if extra is None else base.union(extra)
    cell = F.struct("start", "kind", "end", "chance")
    by_doc = both.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_set(cell)).alias("all"))
    sure = F.filter("all", lambda s: s["chance"].isNull())

    def clear(s: Column) -> Column:
        stronger = lambda o: o["chance"].isNull() | (o["chance"] > s["chance"]) | ((o["chance"] == s["chance"]) & ((o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["kind"] < s["kind"]))))
        return s["chance"].isNull() | ~F.exists("all", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & stronger(o))

    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        keyed.select("doc_id", "key_a", "key_b").join(by_doc, ["key_a", "key_b"], "left")
        .select("doc_id", F.coalesce(plain(sure), none).alias("base"), F.coalesce(plain(F.filter("all", clear)), none).alias("spans")))


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
