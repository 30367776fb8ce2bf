"""Which columns of two tables hold the same cells: partition refinement over column digests."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import cell_key

#: How many colourings one aggregate refines at most; more take turns.
AT_ONCE = 16


@dataclass(frozen=True)
class Colouring:
    """A class for each column of both tables. An expected column can only stand for an actual one of its class."""
    left: tuple[tuple[str, int], ...]
    right: tuple[tuple[str, int], ...]

    @classmethod
    def of(cls, left: Mapping, right: Mapping) -> Colouring:
        """Columns with equal signs share a class."""
        order = {sign: i for i, sign in enumerate(sorted(set(left.values()) | set(right.values()), key=repr))}
        return cls(tuple((c, order[s]) for c, s in left.items()), tuple((c, order[s]) for c, s in right.items()))

    def members(self, side: int, colour: int) -> list[str]:
        return [c for c, k in (self.right if side else self.left) if k == colour]

    @property
    def counts(self) -> tuple[Counter, Counter]:
        return Counter(k for _, k in self.left), Counter(k for _, k in self.right)

    @property
    def possible(self) -> bool:
        """Every class has enough actual columns for its expected ones."""
        left, right = self.counts
        return all(n <= right[k] for k, n in left.items())

    @property
    def full(self) -> list[int]:
        """Classes all of whose actual columns are needed."""
        left, right = self.counts
        return sorted(k for k, n in left.items() if n == right[k])

    @property
    def shape(self) -> tuple:
        return tuple(sorted(Counter(k for _, k in side).values()) for side in (self.left, self.right))

    def apart(self, column: str, other: str) -> Colouring:
        """The two columns in a class of their own: one of them stands for the other."""
        return Colouring.of({c: (k, c == column) for c, k in self.left}, {c: (k, c == other) for c, k in self.right})


def _digests(df: DataFrame, colours: Sequence[Sequence[tuple[str, int]]], full: Sequence[Sequence[int]], decimals: int) -> DataFrame:
    """For each colouring a list of each column's digest: hash sum and hash xor of (fingerprint of the row, cell).

    A row's fingerprint is the hash of its cells by class, those of a class in sorted order, over the classes that `full` names.
    """
    names = [c for c, _ in colours[0]]
    rows = df.select(*[F.xxhash64(cell_key(F.col(f"`{c}`"), df.schema[c].dataType, decimals)).alias(f"h{i}") for i, c in enumerate(names)])

    def fingerprint(colouring: Sequence[tuple[str, int]], classes: Sequence[int]) -> Column:
        cells = [F.array_sort(F.array(*[F.col(f"h{i}") for i, (_, k) in enumerate(colouring) if k == colour])) for colour in classes]
        return F.xxhash64(*cells) if cells else F.lit(0).cast("long")

    marked = rows.select("*", *[fingerprint(c, f).alias(f"f{n}") for n, (c, f) in enumerate(zip(colours, full))])
    mixed = marked.select(*[F.xxhash64(f"f{n}", f"h{i}").alias(f"g{n}_{i}") for n in range(len(colours)) for i in range(len(names))])
    sums = mixed.agg(*[x for g in mixed.columns for x in (F.sum(F.col(g).cast("decimal(20,0)")).alias(f"s{g}"), F.bit_xor(g).alias(f"x{g}"))])
    return sums.select(F.array(*[F.array(*[
        F.concat_ws(":", F.col(f"sg{n}_{i}").cast("string"), F.col(f"xg{n}_{i}").cast("string")) for i in range(len(names))]) for n in range(len(colours))]).alias("digests"))


def _refined(expected: DataFrame, actual: DataFrame, colourings: list[Colouring], decimals: int) -> list[Colouring | None]:
    """Each colouring split until no class splits further; None where a class lacks actual columns.

    A round is one aggregate a side, whatever the number of columns and colourings; one row a side reaches the driver.
    """
    done: list[Colouring | None] = [c if c.possible else None for c in colourings]
    live = [n for n, c in enumerate(done) if c]
    while live:
        for start in range(0, len(live), AT_ONCE):
            some = [done[n] for n in live[start:start + AT_ONCE]]
            full = [c.full for c in some]
            both = _digests(expected, [c.left for c in some], full, decimals).withColumn("side", F.lit(0)).union(
                _digests(actual, [c.right for c in some], full, decimals).withColumn("side", F.lit(1)))
            sides = {r["side"]: r["digests"] for r in both.collect()}
            for i, n in enumerate(live[start:start + AT_ONCE]):
                split = Colouring.of(*[{c: (k, d) for (c, k), d in zip(side, sides[s][i])} for s, side in enumerate((some[i].left, some[i].right))])
                done[n] = split if split.possible else None
                if split.shape == some[i].shape:
                    live[live.index(n)] = -1 - n  # settled
        live = [n for n in live if n >= 0 and done[n]]
    return done


def alignments(expected: DataFrame, actual: DataFrame, start: Colouring, decimals: int = 2, first: str | None = None) -> Iterator[dict[str, str]]:
    """Mappings of expected to actual columns under which both tables have the same rows, by 64-bit hashes.

    `start` has a class for each column, from its cells alone. Classes are refined by the rows: a row's fingerprint over the
    classes known so far goes into the digests of its columns, so that columns with the same cells in another order fall apart
    together with the columns they depend on. Where a class of several columns remains, one of its expected columns is tried
    against each of its actual ones, all in the same aggregates. At most one mapping is given for each column that `first` can
    stand for: which of several equal mappings the other columns take makes no difference to the rows.
    """
    def settle(colouring: Colouring) -> Iterator[dict[str, str]]:
        left, right = colouring.counts
        open_classes = [k for k in left if right[k] > 1]
        if not open_classes:
            yield {c: colouring.members(1, k)[0] for c, k in colouring.left}
            return
        lead = [k for c, k in colouring.left if c == first and k in open_classes]
        chosen = lead[0] if lead else min(open_classes, key=lambda k: (right[k], k))
        column = first if lead else colouring.members(0, chosen)[0]
        others = sorted(colouring.members(1, chosen), key=lambda a: a != column)
        for branch in _refined(expected, actual, [colouring.apart(column, a) for a in others], decimals):
            found = settle(branch) if branch else iter(())
            if lead:
                yield from found  # another column for `first` each
            elif (mapping := next(found, None)) is not None:
                yield mapping
                return

    for settled in _refined(expected, actual, [start], decimals):
        if settled:
            yield from settle(settled)
