"""Merkle manifest of a document table: persistent trees with path-copied versions, in aligned blocks over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, written
from tallyframe.llm.places import placed

RUN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "source string, block long, kind int, place long, members long, digest string, path array<string>, subroot string, root string, doc_id long, changed string"


def _h(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(members: int) -> int:
    """Levels above `members` nodes."""
    levels = 0
    while members > 1:
        members, levels = -(-members // RUN), levels + 1
    return levels


class Tree:
    """An aligned block of a persistent tree. Version 0 is the block as it was made; another version is the few nodes that it
    copied, and shares all others with version 0."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([_h(below[i:i + RUN]) for i in range(0, len(below), RUN)])

    def copied(self, place: int, digest: str) -> list[str]:
        """The nodes of a version in which one leaf is another: the leaf and its ancestors, upwards."""
        path = [digest]
        for level in self.levels[:-1]:
            first = place - place % RUN
            path.append(_h([*level[first:place], path[-1], *level[place + 1:first + RUN]]))
            place //= RUN
        return path

    def siblings(self, place: int) -> list[str]:
        """For each level upwards the place in the run, one digit, and the digests of the run's others."""
        out = []
        for level in self.levels[:-1]:
            first = place - place % RUN
            out.append("".join([str(place - first), *level[first:place], *level[place + 1:first + RUN]]))
            place //= RUN
        return out


def folded(digest: str, path: list[str]) -> str:
    """A node's version carried on through levels above its block, each given by the place in the run and the run's others."""
    for step in path:
        cut = 1 + 64 * int(step[0])
        digest = _h([step[1:cut], digest, step[cut:]])
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other; a block has RUN ** block_levels nodes at most, and one path."""
    rows, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["source"], row["block"]) != key:
                if rows:
                    yield rows
                rows, key = [], (row["source"], row["block"])
            rows.append(row)
    if rows:
        yield rows


def _tree(rows: list[dict], block_levels: int) -> Tree:
    return Tree([r["digest"] for r in rows], min(block_levels, height(rows[0]["members"])))


def _emitted(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


_UP = pa.schema([("source", pa.string()), ("place", pa.int64()), ("members", pa.int64()), ("digest", pa.string())])
_DOWN = pa.schema([("source", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
_LEAF = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()),
    ("verified", pa.bool_()), ("n_copied", pa.int64())])


def _up(block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted((
            {"source": b[0]["source"], "place": b[0]["block"], "members": -(-b[0]["members"] // RUN ** block_levels), "digest": _tree(b, block_levels).levels[-1][0]}
            for b in _blocks(batches)), _UP)
    return run


def _down(block_levels: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for above, *nodes in _blocks(batches):
            tree, first = _tree(nodes, block_levels), nodes[0]["place"]
            for r in nodes:
                yield {
                    "source": r["source"], "place": r["place"], "digest": r["digest"], "path": tree.siblings(r["place"] - first) + above["path"],
                    "subroot": above["subroot"], "root": above["root"]}
    return lambda batches: _emitted(rows(batches), _DOWN)


def _leaves(block_levels: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for above, *nodes in _blocks(batches):
            tree, first = _tree(nodes, block_levels), nodes[0]["place"]
            for r in nodes:
                place = r["place"] - first
                copies = tree.copied(place, r["changed"] or r["digest"])
                root = folded(copies[-1], above["path"])
                yield {
                    "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": above["subroot"], "root": above["root"],
                    "proof_sha256": _h([step[1:] for step in tree.siblings(place) + above["path"]]), "folded_root": root, "verified": root == above["root"],
                    "n_copied": len(copies) + len(above["path"]) if r["changed"] else 0}
    return lambda batches: _emitted(rows(batches), _LEAF)


def _shaped(rows: DataFrame, kind: int, block_levels: int) -> DataFrame:
    """The rows as the tasks over blocks take them: kind 0 is the path above a block, kind 1 a node of it."""
    block = F.col("place") if kind == 0 else F.call_function("div", F.col("place"), F.lit(RUN ** block_levels).cast("long"))
    made = rows.withColumn("kind", F.lit(kind)).withColumn("block", block)
    fields = [f.split() for f in _NODE.split(", ")]
    return made.select(*[(F.col(name) if name in made.columns else F.lit(None)).cast(kind_of).alias(name) for name, kind_of in fields])


def _by_block(block_levels: int, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    rows = _shaped(nodes, 1, block_levels)
    if above is not None:
        rows = rows.union(_shaped(above, 0, block_levels))
    return rows.repartition("source", "block").sortWithinPartitions("source", "block", "kind", "place")


def _schema(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _grown(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """The nodes (source, place, members, digest) and the roots of their blocks, again and again until each source has one node."""
    levels = [nodes]
    most = nodes.agg(F.max("members")).first()[0] or 0
    while most > 1:
        levels.append(written(_by_block(block_levels, levels[-1]).mapInArrow(_up(block_levels), _schema(_UP))))
        most = -(-most // RUN ** block_levels)
    return levels


def _led(levels: list[DataFrame], above: DataFrame, block_levels: int) -> DataFrame:
    """From the path above each source's root down to the path above each node of the first of the levels."""
    for nodes in reversed(levels):
        above = written(_by_block(block_levels, nodes, above).mapInArrow(_down(block_levels), _schema(_DOWN)))
    return above


def _field(name: str, value: Column | None = None) -> Column:
    text = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, block_levels: int = 7) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and n_copied, the nodes that its version copied.

    A leaf is the SHA-256 of the fields doc_id, source, lang, n_chars, text, each with its length. Leaves of a source in order of
    doc_id form a tree with runs of three, and the sources' roots another. A document whose decimal id has an even CRC-32 is
    tampered with: its line ends go. The version of the trees that this makes copies the leaf's ancestors and shares all other
    nodes; within the aligned block of 3^`block_levels` leaves from the block's own tree, above that along the path to the block.

    Scale: texts are hashed where they are read and never shuffled. Places come from a range partitioning (`places.placed`), never
    from a source in one task. A block's task holds 3^`block_levels` digests, by default 2,187; blocks' roots are the nodes of the next level, so a table shrinks
    so many times a round and a source of any size spreads over its blocks. A path is made once a block, not once a document.

    A null doc_id comes first in its source, is not tampered with, and has the field '-'. A null source is a source before all others,
    apart from ''. Equal ids come in the order of their leaves; equal rows are leaves of their own. An empty table has no rows.
    A source with one document has its leaf for a root, and no siblings on that level. Other columns are not read.
    """
    plain = docs.select(*[F.col(f) for f in FIELDS])
    leaf = F.sha2(F.concat(*[_field(f) for f in FIELDS]), 256)
    cut = F.sha2(F.concat(*[_field(f) for f in FIELDS[:-1]], _field("text", F.translate("text", "\n", ""))), 256)
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = written(plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("digest"), F.when(tampered, cut).alias("changed")))
    nodes = placed(leaves, ["source"], ["doc_id", "digest"])
    levels = _grown(nodes, block_levels)
    subroots = written(placed(levels[-1].select("source", "digest"), [], ["source"]))
    upper = _grown(subroots.select(F.lit("").alias("source"), "place", "members", "digest"), block_levels)
    start = upper[-1].select("source", F.lit(0).cast("long").alias("place"), "digest", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    ways = _led(upper[:-1], start, block_levels)
    above = subroots.join(ways.select("place", "path", "root"), "place").select("source", F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root")
    return _by_block(block_levels, nodes, _led(levels[1:-1], above, block_levels)).mapInArrow(_leaves(block_levels), _schema(_LEAF))
