"""Benchmark decontamination: a prefix-filtered join on rare shingles, verified on item-sized windows. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import row_key, written

#: Distinct shingles of all items up to which they are sent to every task (16 bytes each); beyond that the join shuffles.
BROADCAST_SHINGLES = 1_000_000


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the document itself among its shingles.
_SELF = -1


def _split(lower: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return _split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _loose(text: Column) -> Column:
    """Every letter in lower case, which takes a fraction of the time: texts that agree by `words` agree here too, at the same words."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _shingle(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(w, i + k) for k in range(size)])


def _shingles(w: Column, n: Column, size: int) -> Column:
    """The hash of each run of `size` words, by place."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: _shingle(w, i, size))).otherwise(F.array().cast("array<long>"))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, win, size: windows of `window` words, or all words of an item that has fewer."""
    w = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(window))
    return w.select("item", k.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("win")).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, shingle: int = 3,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, hit_spans, items, contaminated, key_a, key_b.

    A document word is hit if it lies in an occurrence of an item window. Windows and documents meet on shingles of `shingle`
    words (of the whole window where it is shorter). Shingles are ordered by how often they occur in all documents; as every
    shingle of a window must occur for the window to occur, its rarest one is the prefix that has to be joined, and a window one
    of whose shingles never occurs is out. Bounds: the window, laid out from the shingle's place, begins and ends inside the
    document. What is left is compared word by word.

    Scale: each document is split into words once, and once more if it has candidates; texts are shuffled once at most, spread by
    a hash of the row. Occurrences of shingles are summed before they are shuffled. Shingles of the items go to every task only
    up to BROADCAST_SHINGLES of them. Shingles ignore the case of all letters, the comparison only that of A-Z.

    A null or empty text has no words. Items without words match nothing, a null item_id counts as an empty one, items that
    repeat an id are one item. Equal rows get equal results, each its own row; rows that share only doc_id are told apart.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    items = written(item_windows(benchmark, item_id, item_text, window))
    wins = items.select("win", "size").distinct().select("win", "size", F.split(_loose(F.col("win")), " ").alias("w"))
    sizes = sorted({min(r.size, shingle) for r in wins.select("size").distinct().collect()})  # one to three numbers

    def of_size(q: int) -> DataFrame:
        mine = wins.where(F.least(F.col("size"), F.lit(shingle)) == q)
        return mine.select("win", "size", F.posexplode(_shingles(F.col("w"), F.col("size"), q)).alias("at", "hash"))

    if not sizes:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return keyed.select(
            "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("hit_spans"),
            F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"), "key_a", "key_b")
    in_windows = of_size(sizes[0])
    for q in sizes[1:]:
        in_windows = in_windows.union(of_size(q))
    in_windows = written(in_windows)
    wanted = in_windows.select("hash").union(docs.sparkSession.range(1).select(F.lit(_SELF).cast("long"))).distinct()
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)

    split = keyed.select("doc_id", "key_a", "key_b", _split(_loose(F.col("text"))).alias("w")).select("*", F.size("w").alias("n"))
    if len(sizes) == 1:
        own = F.array(F.lit(_SELF).cast("long"))
        exploded = split.select("doc_id", "key_a", "key_b", "n", F.posexplode(F.concat(own, _shingles(F.col("w"), F.col("n"), sizes[0]))).alias("place", "hash"))
    else:
        placed = [F.transform(_shingles(F.col("w"), F.col("n"), q), lambda h, i: F.struct((i + 1).alias("place"), h.alias("hash"))) for q in sizes]
        each = F.concat(F.array(F.struct(F.lit(0).alias("place"), F.lit(_SELF).cast("long").alias("hash"))), *placed)
        exploded = split.select("doc_id", "key_a", "key_b", "n", F.explode(each).alias("p")).select("doc_id", "key_a", "key_b", "n", "p.place", "p.hash")
    met = written(exploded.join(wanted, "hash"))
    itself = met.where(F.col("place") == 0)
    found = met.where(F.col("place") > 0).withColumn("place", F.col("place") - 1)

    frequency = found.groupBy("hash").agg(F.count("*").alias("seen"))
    rarest = (
        in_windows.join(frequency, "hash").groupBy("win", "size")
        .agg(F.min(F.struct("seen", "hash", "at")).alias("rare"), F.count("*").alias("shingles"))
        .where(F.col("shingles") == F.col("size") - F.least(F.col("size"), F.lit(shingle)) + 1)
        .select("size", "rare.hash", "rare.at").distinct())
    start = F.col("place") - F.col("at")
    candidates = (
        found.join(rarest, "hash").select("key_a", "key_b", start.alias("start"), "size", "n")
        .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
        .groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "size")).alias("tried")))
    tried = written(
        keyed.join(candidates, ["key_a", "key_b"]).select("key_a", "key_b", "tried", words(F.col("text")).alias("w"))
        .select("key_a", "key_b", F.size("w").alias("n"), F.transform(  # w is used twice, so it isn't moved into the function and split again for each place
            "tried", lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size"), F.array_join(F.slice("w", t["start"] + 1, t["size"]), " ").alias("win"))).alias("tried")))

    laid = tried.dropDuplicates(["key_a", "key_b"]).select("key_a", "key_b", F.explode("tried").alias("t")).select("key_a", "key_b", "t.*")
    hits = laid.join(wins.select("win"), "win", "left_semi")
    spans = hits.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("hit_spans"))
    names = hits.select("key_a", "key_b", "win").distinct().join(items.select("win", "item"), "win").groupBy("key_a", "key_b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    return (
        itself.select("doc_id", "key_a", "key_b", F.col("n").cast("long").alias("n_words")).join(spans.join(names, ["key_a", "key_b"]), ["key_a", "key_b"], "left")
        .select(
            "doc_id", "n_words", F.when(F.col("hit_spans").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"),
            F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("hit_spans").isNotNull().alias("contaminated"), "key_a", "key_b"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item window touches, with the columns they came with."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    bad = contamination(plain, benchmark, doc_id, text, **options).where("contaminated").select("key_a", "key_b").distinct()
    keyed = plain.select("*", *row_key(doc_id, text))
    return keyed.join(bad, ["key_a", "key_b"], "left_anti").select(*plain.columns).toDF(*docs.columns)
