"""Line deduplication: a suffix array over the line names of all documents, its common-prefix intervals, and the runs that repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, covered, row_key, slices, written

_SPACES = " \t\n\r\x0b\x0c"
_KEYS = ["key_a", "key_b"]
_NAMES = "doc_id long, key_a long, key_b long, name_a array<long>, name_b array<long>, long array<boolean>"
_STATE = "doc_id long, key_a long, key_b long, rank array<long>, tied array<boolean>, later array<boolean>"
_SUFFIX = "doc_id long, key_a long, key_b long, seq int, rank long, behind array<long>"
_PARTS = ("rank", "behind")
#: Doublings of the depth in one round; each level is read at most 2^_DOUBLINGS - 1 times for a common prefix.
_DOUBLINGS = 3
_RUN = "array<struct<start:int,end:int,copy_doc:bigint,copy_start:int>>"


class Level(NamedTuple):
    """Suffixes ranked by their first `depth` lines: a row for each document with the ranks of all its lines, -1 for a line that does
    not repeat; whether others share the rank; whether an earlier one does, told up to the least depth of a run only. Deeper levels
    hold the documents that had a tied suffix before."""
    depth: int
    ranks: DataFrame


def _name_arrays(long_words: int):
    """A row for each document: the 128-bit names of its lines with words, and which are long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            names, longs, ends = [], [], [0]
            for text in column(piece, "text").to_pylist():
                lines = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
                names += [xxhash.xxh3_128_digest(x.encode()) for x in lines]
                longs += [len(x.encode().split()) >= long_words for x in lines]
                ends.append(len(names))
            name, ends = np.frombuffer(b"".join(names), ">i8").reshape(-1, 2).astype(np.int64), pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column(piece, c) for c in ("doc_id", *_KEYS)]
                + [pa.ListArray.from_arrays(ends, v) for v in (pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(longs, pa.bool_()))],
                names=["doc_id", *_KEYS, "name_a", "name_b", "long"])
    return run


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin; a null list is empty."""
    lists = column(batch, name)
    values = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _tied_suffixes(step: int, reads: int):
    """A row for each suffix that shares its rank, with the ranks of the suffixes `step`, 2 `step`, ... lines behind, `reads` of them.
    The first that no other shares ends the list, as it decides. Where nothing that repeats is left, -1 and the suffix's own place end it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _flat(batch, "rank")
            rank, tied = values.to_numpy(zero_copy_only=False), _flat(batch, "tied")[0].to_numpy(zero_copy_only=False).astype(bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.flatnonzero(tied)
            row, seq = row[at], at - ends[row[at]]
            keys = [column(batch, c).take(pa.array(row)) for c in ("doc_id", *_KEYS)]
            cells, used = np.empty((len(at), reads + 3), np.int64), np.zeros((len(at), reads + 3), bool)
            open_, ended = np.ones(len(at), bool), np.zeros(len(at), bool)
            for k in range(reads):
                far = at + (k + 1) * step
                inside = far < ends[row + 1]
                far = np.where(inside, far, at)
                cells[:, k], used[:, k] = np.where(inside, rank[far], -1), open_
                ended |= open_ & (cells[:, k] < 0)
                open_ &= inside & tied[far]
            cells[:, reads:] = np.stack([*[k.to_numpy(zero_copy_only=False) for k in keys[1:]], seq], 1)
            used[:, reads:] = ended[:, None]
            sizes = np.concatenate([[0], np.cumsum(used.sum(1))])
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(seq, pa.int32()), pa.array(rank[at], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(cells[used]))],
                names=[f.split()[0] for f in _SUFFIX.split(", ")])
    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `before`: how many suffixes stand before a name in its task."""
    total = 0
    for batch in batches:
        n = column(batch, "n").to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total + np.cumsum(n) - n, pa.int64())], names=[*batch.schema.names, "before"])
        total += int(n.sum())


def _place() -> Column:
    """Order of all lines: by document id (null last), then by row and line."""
    return F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "key_a", "key_b", "seq")


def _ranked(suffixes: DataFrame, least: int, marks: bool) -> DataFrame:
    """Suffixes with their new rank: how many stand before their name in the order of `_PARTS`. Names of fewer than `least` suffixes are left out.
    With `marks` also whether an equal one stands earlier.

    Names are summed, sorted over the cluster and counted up in each task; the tasks' totals, one number a task, give the rest. Every
    bucket of suffixes that shared a rank is here as a whole, so new ranks stay between those of its neighbours.
    """
    spark = suffixes.sparkSession
    first = [F.min(_place()).alias("first")] if marks else []
    names = suffixes.groupBy(*_PARTS).agg(F.count("*").alias("n"), *first).where(F.col("n") >= least)
    order = names.repartitionByRange(*_PARTS).sortWithinPartitions(*_PARTS).withColumn("task", F.spark_partition_id())
    order = written(order.mapInArrow(_running, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in order.schema] + ["before long"])))
    totals = sorted(order.groupBy("task").agg(F.sum("n").alias("n")).collect())  # one row a task
    shifts = spark.createDataFrame([(t.task, sum(x.n for x in totals[:i])) for i, t in enumerate(totals)], "task int, shift long")
    order = order.join(F.broadcast(shifts), "task").withColumn("before", F.col("before") + F.col("shift")).drop("task", "shift")
    starts = order.groupBy("rank").agg(F.min("before").alias("start"))
    fresh = order.join(starts, "rank").withColumn("fresh", F.col("rank") + F.col("before") - F.col("start")).drop("before", "start")
    later = _place() != F.col("first") if marks else F.lit(False)
    cell = F.struct("seq", F.col("fresh").alias("rank"), (F.col("n") > 1).alias("tied"), later.alias("later"))
    return suffixes.join(fresh, list(_PARTS)).groupBy(*_KEYS).agg(F.collect_list(cell).alias("fresh"))


def _renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank arrays with the new ranks put in."""
    for batch in batches:
        values, ends = _flat(batch, "rank")
        cells, cell_ends = _flat(batch, "fresh")
        rank, tied, later = values.to_numpy(zero_copy_only=False).copy(), np.zeros(len(values), bool), np.zeros(len(values), bool)
        at = np.repeat(ends[:-1], np.diff(cell_ends)) + cells.field("seq").to_numpy(zero_copy_only=False)
        rank[at] = cells.field("rank").to_numpy(zero_copy_only=False)
        tied[at] = cells.field("tied").to_numpy(zero_copy_only=False)
        later[at] = cells.field("later").to_numpy(zero_copy_only=False)
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(rank, pa.int64()), pa.array(tied), pa.array(later))]
        yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("doc_id", *_KEYS)], *lists], names=[f.split()[0] for f in _STATE.split(", ")])


def suffix_array(names: DataFrame, min_lines: int) -> list[Level]:
    """Prefix doubling until no two suffixes share a rank. The levels are the depths up to `min_lines`, and then every depth that is
    2^_DOUBLINGS times the one before: a round reads the ranks of that many stretches at once. The last level's ranks are places in the
    suffix array of the lines that repeat; any other line ends what suffixes can have in common. Rounds beyond `min_lines` carry only
    documents with suffixes that are still tied, as a suffix is told apart by ranks of its own document."""
    cells = F.transform("name_a", lambda a, i: F.struct(i.alias("seq"), F.array(a, F.get("name_b", i)).alias("behind")))
    single = names.select("doc_id", *_KEYS, F.explode(cells).alias("c")).select("doc_id", *_KEYS, "c.seq", F.lit(0).cast("long").alias("rank"), "c.behind")
    state, how = names.select("doc_id", *_KEYS, F.transform("name_a", lambda a: F.lit(-1).cast("long")).alias("rank")), "left"
    levels, depth, fresh = [], 1, _ranked(single, 2, marks=True)
    open_ = F.exists("tied", lambda t: t)
    while True:
        levels.append(Level(depth, written(state.join(fresh.hint("merge"), _KEYS, how).mapInArrow(_renewed, _STATE))))
        state = levels[-1].ranks
        if depth < min_lines:
            step, reads = min(depth, min_lines - depth), 1
        elif state.where(open_).isEmpty():
            settled = [v.ranks.where(~open_) for v in levels if v.depth >= min_lines]
            return [*levels[:-1], Level(depth, reduce(DataFrame.union, settled))]
        else:
            state, how = state.where(open_), "inner"
            step, reads = depth, 2 ** _DOUBLINGS - 1
        depth += step * reads
        fresh = _ranked(state.mapInArrow(_tied_suffixes(step, reads), _SUFFIX), 1, marks=depth <= min_lines)


def _looked_up(pairs: DataFrame, side: str, level: Level, reads: int) -> DataFrame:
    """Pairs with the ranks, at this level, of the suffixes `lines`, `lines` + depth, ... lines behind one side's, `reads` of them; all
    pairs of a document are looked up in its array. A document that the level lacks has no tied suffix there."""
    keys = [f"{side}_{k}" for k in _KEYS]
    rest = [c for c in pairs.columns if c not in keys]
    ranks = level.ranks.select(*[F.col(k).alias(f"{side}_{k}") for k in _KEYS], F.col("rank").alias("ranks"))
    by_doc = pairs.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("all"))
    places = F.array(*[F.lit(i * level.depth) for i in range(reads)])
    found = F.transform("all", lambda p: F.struct(
        *[p[c].alias(c) for c in rest], F.transform(places, lambda x: F.get("ranks", p[f"{side}_seq"] + p["lines"] + x)).alias(f"{side}_rank")))
    return by_doc.join(ranks.hint("merge"), keys, "left").select(*keys, F.inline(found))


def maximal_runs(levels: list[Level], min_lines: int) -> DataFrame:
    """Neighbours in the suffix array that share `min_lines` lines or more and have no equal line before them: a_ and b_ doc_id, key_a,
    key_b, seq, and `lines`, the length of their common prefix. Neither end of such a run can be moved outwards.

    The array is cut where fewer than `min_lines` lines are common. Neighbours with equal lines before them lie inside a longer run.
    A common prefix is measured from the deepest level down: equal ranks at a depth mean so many equal lines.
    """
    of = {v.depth: v.ranks for v in levels}
    arrays = (
        levels[-1].ranks.select("doc_id", *_KEYS, "rank")
        .join(of[min_lines].select(*_KEYS, F.col("rank").alias("cut")).hint("merge"), _KEYS)
        .join(of[1].select(*_KEYS, F.col("rank").alias("base")).hint("merge"), _KEYS))
    cells = F.transform("rank", lambda r, i: F.struct(
        i.alias("seq"), r.alias("rank"), F.get("cut", i).alias("cut"), F.when(i > 0, F.get("base", i - 1)).otherwise(-1).alias("before")))
    suffixes = written(arrays.select("doc_id", *_KEYS, F.inline(F.filter(cells, lambda c: c["rank"] >= 0))))
    side = lambda s, shift: suffixes.select(*[F.col(c).alias(f"{s}_{c}") for c in ("doc_id", *_KEYS, "seq", "before")], F.col("rank") + shift, "cut").toDF(
        *[f"{s}_{c}" for c in ("doc_id", *_KEYS, "seq", "before")], "rank", "cut")
    pairs = side("a", 1).join(side("b", 0), ["rank", "cut"]).where("a_before <> b_before OR a_before < 0").drop("rank", "cut", "a_before", "b_before")
    pairs = written(pairs.withColumn("lines", F.lit(0)))
    same = F.zip_with("a_rank", "b_rank", lambda a, b: F.coalesce((a >= 0) & (a == b), F.lit(False)))
    for level, deeper in reversed(list(zip(levels, levels[1:]))):
        reads = -(-deeper.depth // level.depth) - 1  # a longer common prefix shows at the deeper level
        pairs = _looked_up(_looked_up(pairs, "a", level, reads), "b", level, reads)
        first_other = F.array_position(F.concat(same, F.array(F.lit(False))), False)
        pairs = written(pairs.withColumn("lines", (F.col("lines") + (first_other - 1) * level.depth).cast("int")).drop("a_rank", "b_rank"))
    return pairs


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 2, long_words: int = 20) -> DataFrame:
    """The documents with their later copies of repeated lines deleted: the columns of the input (text replaced by what is kept) and
    n_lines, n_removed, removed_runs (lines, end exclusive), maximal_runs.

    A run goes if it has `min_lines` lines or more and also stands earlier, in a document with a smaller id or further up; so does a
    single line of `long_words` words or more. Runs are judged on the input. Lines are compared exactly. A line without words
    belongs to the line before it and goes with it; a run is not interrupted by it.

    All suffixes in one interval of the suffix array with `min_lines` common lines, but the first of them in the corpus, begin a later
    copy; the lines of these copies together are the later runs of any length. maximal_runs (see `maximal_runs`) says from where to where,
    counted in lines with words, a document has a run that cannot be made longer, and the place of the neighbour it shares it with,
    whichever of the two stays.

    Scale: ranks are made of summed names, never of a group's rows; a line that a third of all documents have is one name, joined
    back in a join that Spark can split. A document's ranks are one row, smaller than its text. Rounds grow with the logarithm of the longest repeated run,
    and carry only documents that still have tied suffixes.

    A null text stays null and an empty one empty. A null doc_id comes after all others. Equal rows are one document, in as many
    rows. Input columns that have a result column's name are replaced by it.
    """
    made = ("n_lines", "n_removed", "removed_runs", "maximal_runs")
    rest = docs.select(*[c for c in docs.columns if c not in made])
    plain = rest.toDF(*[f"c{i}" for i in range(len(rest.columns))])
    at = {c: f"c{i}" for i, c in enumerate(rest.columns)}
    keyed = plain.select("*", *row_key(at[doc_id], at[text]))
    read = keyed.select(F.col(at[doc_id]).cast("long").alias("doc_id"), *_KEYS, F.col(at[text]).alias("text"))
    names = written(read.mapInArrow(_name_arrays(long_words), _NAMES).dropDuplicates(_KEYS))
    levels = suffix_array(names.select("doc_id", *_KEYS, "name_a", "name_b"), min_lines)
    pairs = maximal_runs(levels, min_lines)
    ends = [pairs.select(*[F.col(f"{x}_{k}").alias(k) for k in _KEYS], F.struct(
        F.col(f"{x}_seq").alias("start"), (F.col(f"{x}_seq") + F.col("lines")).alias("end"), F.col(f"{y}_doc_id").alias("copy_doc"), F.col(f"{y}_seq").alias("copy_start")).alias("run"))
        for x, y in ("ab", "ba")]
    runs = ends[0].union(ends[1]).groupBy(*_KEYS).agg(F.sort_array(F.collect_set("run")).alias("maximal_runs"))
    of = {v.depth: v.ranks.select(*_KEYS, "later") for v in levels}
    # always by a shuffle of both sides: the marks grow with the texts, and small corpora then behave like large ones
    marks = written(
        names.select(*_KEYS, "long").join(of[min_lines].withColumnRenamed("later", "later_run").hint("merge"), _KEYS)
        .join(of[1].withColumnRenamed("later", "later_line").hint("merge"), _KEYS).join(runs.hint("merge"), _KEYS, "left")
        .select(*_KEYS, "later_run", F.zip_with("later_line", "long", lambda a, b: a & b).alias("later_line"), "maximal_runs"))
    columns = plain.columns
    marked = keyed.join(marks.hint("merge"), _KEYS).select(*columns, "later_run", "later_line", F.coalesce("maximal_runs", F.array().cast(_RUN)).alias("maximal_runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, at[text]):
            texts, sizes, removed, spans = [], [], [], []
            later_run, ends = _flat(piece, "later_run")
            later_run, later_line = (v.to_numpy(zero_copy_only=False).astype(bool) for v in (later_run, _flat(piece, "later_line")[0]))
            for i, t in enumerate(column(piece, at[text]).to_pylist()):
                lines = t.split("\n") if t else []
                owner = np.cumsum([bool(x.strip(_SPACES)) for x in lines], dtype=np.int64) - 1
                here = slice(ends[i], ends[i + 1])
                out = covered(ends[i + 1] - ends[i], np.flatnonzero(later_run[here]), min_lines) | later_line[here]
                drop = [o >= 0 and bool(out[o]) for o in owner]
                edge = np.flatnonzero(np.diff(np.array(drop, np.int8), prepend=0, append=0))
                texts.append("\n".join(x for x, d in zip(lines, drop) if not d) if t is not None else None)
                sizes.append(len(lines))
                removed.append(sum(drop))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            made_columns = {at[text]: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(
                [made_columns.get(c, column(piece, c)) for c in columns]
                + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), column(piece, "maximal_runs")],
                names=[*columns, *made])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema] + [f"n_lines long, n_removed long, removed_runs array<struct<start:int,end:int>>, maximal_runs {_RUN}"])
    return marked.mapInArrow(cut, schema).toDF(*rest.columns, *made)
