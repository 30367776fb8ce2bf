"""Can the rows of two tables be paired so that every number agrees within a bound? Flows over a table of candidate pairs."""

from __future__ import annotations

import functools
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.shared import written

#: Numbers whose grid cells are keys of the candidate join; further ones only filter it.
GRID = 2
_NO_CELL = -(2**62)


def _near(a: Column, b: Column, bound: float) -> Column:
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(F.abs(a - b) <= bound, F.lit(False)) | (a.isNull() & b.isNull())


def candidate_pairs(nodes: DataFrame, values: Sequence[str], bound: float) -> DataFrame:
    """key, l, r, l_units, r_units: rows of both sides within the bound in every number, from the same or a neighbouring grid cell."""
    grid = values[:GRID]
    cell = lambda v: F.coalesce(F.floor(F.col(v) / bound).cast("long"), F.lit(_NO_CELL))
    left = nodes.where("side = 0").select("key", F.col("id").alias("l"), F.col("units").alias("l_units"), *[F.col(v).alias(f"l_{v}") for v in values], *[cell(v).alias(f"g{i}") for i, v in enumerate(grid)])
    right = nodes.where("side = 1").select("key", F.col("id").alias("r"), F.col("units").alias("r_units"), *[F.col(v).alias(f"r_{v}") for v in values])
    for i, v in enumerate(grid):
        c = F.coalesce(F.floor(F.col(f"r_{v}") / bound).cast("long"), F.lit(_NO_CELL))
        right = right.withColumn(f"g{i}", F.explode(F.when(c == _NO_CELL, F.array(c)).otherwise(F.array(c - 1, c, c + 1))))
    near = functools.reduce(Column.__and__, [_near(F.col(f"l_{v}"), F.col(f"r_{v}"), bound) for v in values])
    return left.join(right, ["key", *[f"g{i}" for i in range(len(grid))]]).where(near).select("key", "l", "r", "l_units", "r_units")


def blocks(pairs: DataFrame) -> DataFrame:
    """node, block: the smallest node that can be reached over the pairs (l, r). Each round takes the least label of the neighbours
    and then the label's label, over all blocks at once."""
    links = written(pairs.select(F.col("l").alias("node"), F.col("r").alias("other")).union(pairs.select("r", "l")))
    labels = written(links.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("block")))
    while True:
        least = links.join(labels.select(F.col("node").alias("other"), "block"), "other").groupBy("node").agg(F.min("block").alias("found"))
        lower = labels.join(least, "node").select("node", "block", F.least("block", "found").alias("next"))
        jumps = labels.select(F.col("node").alias("next"), F.col("block").alias("jump"))
        moved = written(lower.join(jumps, "next").select("node", F.least("next", "jump").alias("new"), "block"))
        labels = moved.select("node", F.col("new").alias("block"))
        if moved.where("new < block").isEmpty():
            return labels


def _saturated(edges: pd.DataFrame) -> bool:
    """Do all units of the left rows of a block find room? Greedy, then shortest augmenting paths."""
    near, back = defaultdict(list), defaultdict(dict)
    units, room = dict(zip(edges["l"], edges["l_units"])), dict(zip(edges["r"], edges["r_units"]))
    if sum(units.values()) != sum(room.values()):
        return False
    for a, b in zip(edges["l"], edges["r"]):
        near[a].append(b)
    for a in sorted(near, key=lambda x: len(near[x])):
        for b in near[a]:
            if (n := min(units[a], room[b])) > 0:
                units[a], room[b], back[b][a] = units[a] - n, room[b] - n, n
    for start in near:
        while units[start] > 0:
            parent, queue, end = {}, deque([start]), None
            while queue and end is None:
                a = queue.popleft()
                for b in near[a]:
                    if ("r", b) in parent:
                        continue
                    parent["r", b] = a
                    if room[b] > 0:
                        end = b
                        break
                    for c, n in back[b].items():
                        if n > 0 and ("l", c) not in parent and c != start:
                            parent["l", c] = b
                            queue.append(c)
            if end is None:
                return False
            way, b = [], end
            while True:
                a = parent["r", b]
                way.append((a, b))
                if a == start:
                    break
                b = parent["l", a]
            n = min([units[start], room[end], *[back[parent["l", a]][a] for a, _ in way if a != start]])
            for a, b in way:
                back[b][a] = back[b].get(a, 0) + n
                if a != start:
                    back[parent["l", a]][a] -= n
            units[start], room[end] = units[start] - n, room[end] - n
    return True


def _unpaired_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of the blocks, sorted by key and number, that cannot be paired; a block may come in several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for name, rows in batch.groupby(["key", "block"], sort=False):
            if held and (held[0]["key"].iloc[0], held[0]["block"].iloc[0]) != name:
                whole, held = pd.concat(held), []
                if not _saturated(whole):
                    yield whole[["key"]].head(1)
            held.append(rows)
    if held and not _saturated(whole := pd.concat(held)):
        yield whole[["key"]].head(1)


class _Flow:
    """Units sent along pairs of very large blocks, and augmenting rounds over all of their keys at once."""

    def __init__(self, pairs: DataFrame):
        self.pairs = written(pairs.select("key", "l", "r"))
        self.left = written(pairs.select("key", "l", F.col("l_units").alias("units")).distinct())
        self.right = written(pairs.select("key", "r", F.col("r_units").alias("units")).distinct())
        self.sent = self.pairs.select("l", "r", F.lit(0).cast("long").alias("n")).limit(0)

    def _free(self, side: str) -> DataFrame:
        """key, node, free: rows of a side with units that nothing is sent for."""
        nodes = self.left if side == "l" else self.right
        used = self.sent.groupBy(side).agg(F.sum("n").alias("used"))
        return nodes.join(used, side, "left").select("key", side, (F.col("units") - F.coalesce("used", F.lit(0))).alias("free")).where("free > 0")

    def _add(self, more: DataFrame) -> None:
        self.sent = written(self.sent.union(more.select("l", "r", "n")).groupBy("l", "r").agg(F.sum("n").alias("n")).where("n > 0"))

    def greedy(self, rounds: int) -> None:
        """Every left row with free units asks one right row with room, another each round, which takes the first that asks."""
        for k in range(rounds):
            asked = self.pairs.join(self._free("l").drop("key"), "l").join(self._free("r").select("r", F.col("free").alias("room")), "r")
            order = F.xxhash64("l", "r", F.lit(k))
            one = asked.groupBy("l").agg(F.min(F.struct(order, "r", "free", "room")).alias("m")).select("l", "m.r", "m.free", "m.room")
            taken = one.groupBy("r").agg(F.min(F.struct(F.xxhash64("l", F.lit(k)), "l", F.least("free", "room").alias("n"))).alias("m"))
            self._add(taken.select("m.l", "r", "m.n"))

    def augmented(self) -> DataFrame | None:
        """One round: a forest grows breadth first from all left rows with free units; each tree that meets room sends units along
        one way. Keys none of whose trees meets any, which can't be paired; None where all units are sent."""
        free = written(self._free("l"))
        if free.isEmpty():
            return None
        room = written(self._free("r").select("r", F.col("free").alias("room")))
        layers: list[DataFrame] = []
        seen_r = self.pairs.select("r").limit(0)
        seen_l = free.select("l")
        frontier = free.select("key", "l", F.col("l").alias("root"), F.col("free").alias("width"))
        met: DataFrame | None = None
        while True:
            reach = self.pairs.drop("key").join(frontier, "l").join(seen_r, "r", "left_anti").groupBy("r").agg(F.min(F.struct("l", "root", "width", "key")).alias("p"))
            layer = written(reach.select("r", "p.*").join(room, "r", "left"))
            layers.append(layer)
            found = layer.where("room IS NOT NULL")
            met = found if met is None else met.union(found)
            seen_r = seen_r.union(layer.select("r"))
            open_keys = frontier.select("key").distinct().join(met.select("key").distinct(), "key", "left_anti")
            back = self.sent.join(layer.join(open_keys, "key", "left_semi").select("r", "root", "width", "key"), "r").join(seen_l, "l", "left_anti")
            frontier = written(back.groupBy("l").agg(F.min(F.struct("r", "root", F.least("width", "n").alias("width"), "key")).alias("p")).select("l", "p.*"))
            if frontier.isEmpty():
                break
            seen_l = seen_l.union(frontier.select("l"))
            layers.append(frontier)
            frontier = frontier.drop("r")
        ends = written(met.groupBy("root").agg(F.min(F.struct("r", F.least("width", "room").alias("n"))).alias("e")).select("root", "e.*"))
        stuck = written(free.select("key").distinct().join(met.select("key").distinct(), "key", "left_anti"))
        # back along the parents, layer by layer; trees share no row, so ways never meet
        way, more = None, []
        for layer in reversed(layers):
            if "room" in layer.columns:
                here = ends.join(layer.select("r", "l"), "r")
                here = here if way is None else here.union(way.join(layer.select("r", "l"), "r").select("r", "root", "n", "l"))
                here = written(here)
                more.append(here.select("l", "r", "n"))
                way = here.select("l", "root", "n")
            else:
                step = written(way.join(layer.select("l", "r"), "l"))
                more.append(step.select("l", "r", (-F.col("n")).alias("n")))
                way = step.select("r", "root", "n")
        self._add(functools.reduce(DataFrame.union, more))
        return stuck

    def drop(self, keys: DataFrame) -> None:
        gone = written(self.pairs.join(keys, "key", "left_semi").select("l").distinct())
        self.sent = written(self.sent.join(gone, "l", "left_anti"))
        self.pairs, self.left, self.right = (written(t.join(keys, "key", "left_anti")) for t in (self.pairs, self.left, self.right))


def unpaired_keys(rows: DataFrame, values: Sequence[str], bound: float, block_pairs: int = 100_000) -> DataFrame:
    """The keys whose rows of both sides cannot all be paired within the bound; rows: key, side (0 or 1), values.

    Equal rows are one row with so many units. Rows of both sides that may be paired are a table, joined on grid cells. A key of up
    to `block_pairs` pairs is decided by itself, many keys a task. A larger key is cut into blocks that no pairing crosses, the
    connected components of its pairs, and blocks of up to so many pairs are decided the same way. Larger blocks are decided over
    the cluster: augmenting rounds send units along ways found breadth first, for all keys at once, until every unit is sent or a
    key's ways meet no room. Work grows with the pairs that are near each other in the data.

    A null number is paired with a null. No rows give no keys.
    """
    folded = rows.groupBy("key", "side", *values).agg(F.count("*").alias("units"))
    nodes = written(folded.withColumn("id", F.monotonically_increasing_id()))
    pairs = written(candidate_pairs(nodes, values, bound))
    sign = F.when(F.col("side") == 0, F.col("units")).otherwise(-F.col("units"))
    ends = pairs.select(F.col("l").alias("id")).union(pairs.select("r")).distinct().withColumn("met", F.lit(True))
    keys = written(nodes.join(ends, "id", "left").groupBy("key").agg(F.sum(sign).alias("surplus"), F.count_if(F.col("met").isNull()).alias("alone")).join(
        pairs.groupBy("key").agg(F.count("*").alias("pairs")), "key", "left"))
    bad = keys.where("surplus <> 0 OR alone > 0").select("key")
    live = keys.where("surplus = 0 AND alone = 0")
    shape = ["key", "block", "l", "r", "l_units", "r_units"]
    parts = pairs.join(live.where(F.col("pairs") <= block_pairs).select("key"), "key", "left_semi").withColumn("block", F.lit(0).cast("long")).select(*shape)
    wide = live.where(F.col("pairs") > block_pairs).select("key")
    large = None
    if not wide.isEmpty():
        named = pairs.join(wide, "key", "left_semi")
        named = named.join(blocks(named).withColumnRenamed("node", "l"), "l")
        sized = written(named.join(named.groupBy("block").agg(F.count("*").alias("pairs")), "block"))
        parts = parts.union(sized.where(F.col("pairs") <= block_pairs).select(*shape))
        large = sized.where(F.col("pairs") > block_pairs)
    alone = parts.repartition("key", "block").sortWithinPartitions("key", "block").mapInPandas(_unpaired_blocks, parts.select("key").schema)
    bad = bad.union(alone)
    if large is None or large.isEmpty():
        return bad.distinct()
    flow = _Flow(large)
    flow.greedy(4)
    while (stuck := flow.augmented()) is not None:
        if not stuck.isEmpty():
            bad = bad.union(stuck)
            flow.drop(stuck)
    return bad.distinct()
