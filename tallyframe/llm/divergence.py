"""Divergence between the sources of each language: pair tasks merge sorted (term id, count) arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.common import column, slices, written

SCALE = 1_000_000_000
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms stay, A-Z as a-z; all other ASCII parts terms. Bytes above 0x7F belong to letters outside ASCII.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS or b > 0x7F else 0x20 for b in range(256))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of all texts: the text each is in, its number in the last result, and the distinct terms."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    plain = bytes(data[int(at[0]):int(at[-1])]).translate(_TERM_BYTES) if data else b""
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(plain)))
    found = words.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    codes, distinct = found.indices.to_numpy(), found.dictionary
    full = codes != distinct.index("").as_py()
    return of[full], codes[full].astype(np.int64), distinct


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: sums over a slice of texts."""
    for batch in batches:
        for piece in slices([batch], "text", 16 << 20):
            names = pa.StructArray.from_arrays([column(piece, "lang"), column(piece, "source")], ["lang", "source"])
            groups = sorted(set(pairs := [(r["lang"], r["source"]) for r in names.to_pylist()]))
            number = {g: i for i, g in enumerate(groups)}
            group = np.array([number[p] for p in pairs], np.int64)
            of, codes, distinct = _terms(column(piece, "text"))
            size = max(len(distinct), 1)
            cells, counts = np.unique(of * size + codes, return_counts=True)  # a document's terms
            keys, inverse = np.unique(group[cells // size] * size + cells % size, return_inverse=True)
            of_group = keys // size
            yield pa.RecordBatch.from_arrays([
                pa.array([g[0] for g in groups], pa.string()).take(pa.array(of_group)), pa.array([g[1] for g in groups], pa.string()).take(pa.array(of_group)),
                distinct.take(pa.array(keys % size)).cast(pa.string()), pa.array(np.bincount(inverse, counts, len(keys)).astype(np.int64)),
                pa.array(np.bincount(inverse, minlength=len(keys)).astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def vocabulary(docs: DataFrame, min_docs: int = 3, slice_rows: int = 1 << 15) -> DataFrame:
    """lang, source, term, n, lang_n, id, first, slice: the counts of each language's kept terms, written.

    Ids ascend with the terms of a language; `first` is true on one row of a term. A slice, a range of ids, has `slice_rows` rows of
    all sources at most, so an array of a source in it is bounded whatever the vocabulary.
    """
    counts = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    ranged = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source").withColumn("row", F.monotonically_increasing_id())
    whole = ranged.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("in_docs"), F.min("row").over(term).alias("id"), "row")
    bits = slice_rows.bit_length() - 1
    return written(whole.where(F.col("in_docs") >= min_docs).select(
        "lang", "source", "term", "n", "lang_n", "id", (F.col("row") == F.col("id")).alias("first"), F.shiftright("id", bits).alias("slice")))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) in 64 bits, by long division three digits at a time; count + 1 <= total < 9.2e15."""
    rest, out = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(needles: np.ndarray, hay: np.ndarray, step: int = 64) -> np.ndarray:
    """The place in `hay` where each needle stands or would stand; both ascend.

    Needles are taken `step` at a time; from the place reached so far the reach doubles until it passes the last of them, and a
    binary search within it ends the search. Stretches of the longer array without a needle are skipped.
    """
    out, low = np.empty(len(needles), np.int64), 0
    for start in range(0, len(needles), step):
        some = needles[start:start + step]
        reach = step
        while low + reach < len(hay) and hay[low + reach] < some[-1]:
            reach *= 2
        out[start:start + step] = low + np.searchsorted(hay[low:low + reach + 1], some)
        low = int(out[min(start + step, len(needles)) - 1])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of common ids in both arrays."""
    if len(a) > len(b):
        there, here = overlap(b, a)
        return here, there
    at = gallop(a, b)
    held = at < len(b)
    held[held] = b[at[held]] == a[held]
    return np.flatnonzero(held), at[held]


def _priced_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair and slice: what terms of either cost seen from the first and from the second, and how many there are."""
    none = np.empty(0, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            piece = batch.slice(i, 1)
            value = {n: column(piece, n)[0] for n in ("low_ids", "low_ns", "high_ids", "high_ns")}
            ids_a, ns_a, ids_b, ns_b = (v.values.to_numpy(zero_copy_only=False) if v.is_valid else none for v in value.values())
            total_a, total_b = column(piece, "low_total")[0].as_py(), column(piece, "high_total")[0].as_py()
            at_a, at_b = overlap(ids_a, ids_b)
            p, q = shares(ns_a, total_a), shares(ns_b, total_b)
            p0, q0 = shares(np.zeros(1), total_a), shares(np.zeros(1), total_b)
            only_a, only_b = np.delete(p, at_a), np.delete(q, at_b)
            forth = priced(p[at_a], q[at_b]).sum() + priced(only_a, q0).sum() + priced(p0, only_b).sum()
            back = priced(q[at_b], p[at_a]).sum() + priced(q0, only_a).sum() + priced(only_b, p0).sum()
            yield pa.RecordBatch.from_arrays(
                [column(piece, c) for c in ("lang", "low", "high")]
                + [pa.array([int(x)], pa.int64()) for x in (forth, back, len(p) + len(only_b))], names=["lang", "low", "high", "forth", "back", "seen"])


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exactly."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).alias("wide")
    return F.call_function("div", wide, total.cast("decimal(19,0)")) + 1


def _price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _by_salt(groups: DataFrame, salts: int) -> DataFrame:
    """Each group once for each salt, so that no language is one key of a join."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def divergences(docs: DataFrame, min_docs: int = 3, ranks: int = 200, salts: int = 32, slice_rows: int = 1 << 15) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language stands from each other one, and by which terms.

    Terms are runs of ASCII letters (A-Z as a-z) and of any characters outside ASCII. A language keeps the terms that at least
    `min_docs` of its documents have. A group's share of a term is p = 1 + floor(10^9 (count + 1) / (all counts + kept terms)).
    Part `pair` sums floor((p - q)^2 / q) over all kept terms, q being the other source's share; part `term` has it for the terms
    of the group with p > q, q being the language's share, up to `ranks`. Ranks go by value, then by item. All sums are integers.

    Pairs: each group's counts lie in arrays sorted by term id, one a slice of ids. Both arrays of an unordered pair meet in a
    full join, which is the co-group, and a galloping intersection prices the terms of both, of one, and both ways; terms that
    neither has cost the same each, so they are counted only.

    Scale: counts are summed in the tasks that read the texts, then by term. An array has `slice_rows` entries at most, a pair's
    slices are priced apart, and `salts` spread a language. The result itself has a row for each ordered pair of sources.

    Null text, lang and source count as ''. Groups without terms, and languages without kept terms, have their pairs, of value 0
    where nothing is kept. Equal rows are documents of their own. An empty table has no rows. Other columns are not read.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = vocabulary(plain, min_docs, slice_rows)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"))
    known = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n", "firsts"])
    langs = known.groupBy("lang").agg(F.sum("firsts").alias("size"), F.sum("n").alias("lang_n"))
    groups = written(known.join(langs, "lang").select(
        "lang", "source", "size", (F.col("n") + F.col("size")).alias("total"), (F.col("lang_n") + F.col("size")).alias("lang_total")))

    arrays = written(kept.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells")).select(
        "lang", "source", "slice", F.col("cells.id").alias("ids"), F.col("cells.n").alias("ns")))
    own = arrays.withColumn("salt", F.pmod(F.xxhash64("source", "slice"), F.lit(salts))).join(groups.select("lang", "source", "total"), ["lang", "source"])
    others = _by_salt(groups.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total")), salts)
    met = own.join(others, ["lang", "salt"])
    key = ["lang", "low", "high", "slice", "low_total", "high_total"]
    low = met.where("source < other").select(
        "lang", F.col("source").alias("low"), F.col("other").alias("high"), "slice", F.col("total").alias("low_total"), F.col("other_total").alias("high_total"),
        F.col("ids").alias("low_ids"), F.col("ns").alias("low_ns"))
    high = met.where("source > other").select(
        "lang", F.col("other").alias("low"), F.col("source").alias("high"), "slice", F.col("other_total").alias("low_total"), F.col("total").alias("high_total"),
        F.col("ids").alias("high_ids"), F.col("ns").alias("high_ns"))
    sliced = low.join(high, key, "full").mapInArrow(_priced_pairs, "lang string, low string, high string, forth long, back long, seen long")
    pairs = written(sliced.groupBy("lang", "low", "high").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"), F.sum("seen").alias("seen")))
    both = pairs.select("lang", "seen", F.explode(F.array(
        F.struct(F.col("low").alias("source"), F.col("high").alias("other"), F.col("forth").alias("spent")),
        F.struct(F.col("high").alias("source"), F.col("low").alias("other"), F.col("back").alias("spent")))).alias("e")).select("lang", "seen", "e.*")
    ordered = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts))).join(others, ["lang", "salt"]).where("source <> other")
    absent = _price(_share(F.lit(0), F.col("total")), _share(F.lit(0), F.col("other_total"))) * (F.col("size") - F.coalesce("seen", F.lit(0)))
    pair_part = ordered.join(both, ["lang", "source", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.when(F.col("size") == 0, 0).otherwise(F.coalesce("spent", F.lit(0)) + absent).cast("long").alias("value"))

    shared = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total")).alias("p"), _share(F.col("lang_n"), F.col("lang_total")).alias("q")).where("p > q")
    term_part = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _price(F.col("p"), F.col("q")).cast("long").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pair_part).union(ranked(term_part).where(F.col("rank") <= ranks))
