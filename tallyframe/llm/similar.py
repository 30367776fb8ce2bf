"""Groups of documents whose shingle sets are similar: a join of parity sketches by the pigeonhole principle, verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.common import column, hashes, mix, row_key, slices, text_bytes, windows, written
from tallyframe.llm.graph import components

BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 64
#: Common blocks that a similar pair has beyond the one it needs: so many of a set's most frequent blocks need not be joined.
SPARE = 10
#: Rounds in which groups elect a leader anew before what is left is compared in full.
ROUNDS = 2
#: 64-bit words of the parity sketch that bounds the distance of two sets.
WORDS = 16
#: Nodes from which on a component meets others as a whole, not block by block.
LARGE = 64
_ROW = (
    "kind int, bucket int, doc_id long, n long, node long, key_a long, key_b long, nodes binary, counts binary, low binary, shared binary, "
    "keys array<long>, members array<long>")
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_FIELDS = [tuple(f.split()) for f in _ROW.split(", ")]


@lru_cache(maxsize=8)
def bands(percent: int, most: int = 1 << 31) -> np.ndarray:
    """First set size of each band: similar sets lie in the same band or in neighbouring ones."""
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


@lru_cache(maxsize=256)
def scheme(band: int, percent: int, spare: int) -> tuple[int, int]:
    """Blocks of the sketches in which pairs with the larger set in the band meet, and how many of them may be empty.

    Sets of Jaccard similarity p differ in at most (1 - p) / (1 + p) of their summed sizes, d at most in this band. A shingle changes
    one block, so of d + 1 + spare + empty blocks at least 1 + spare are equal and not empty in both, unless both sets leave more
    than `empty` blocks empty. Such sets send their empty blocks as well. Zero blocks: only equal sets are similar here.
    """
    edges = bands(percent)
    largest, smallest = int(edges[band + 1]) - 1, int(edges[max(band - 1, 0)])
    d = (100 - percent) * 2 * largest // (100 + percent)
    if d == 0:
        return 0, 0
    spare, empty = min(spare, smallest // 16), 1
    while empty < 2 * d + 8:
        blocks = d + 1 + spare + empty
        mean = blocks * math.exp(-smallest / blocks)
        if empty >= mean + 3 * math.sqrt(mean):
            break
        empty += 1
    return d + 1 + spare + empty, empty


def spare_steps(percent: int, spare: int) -> list[int]:
    """Set sizes from which on one block more is spare, in the schemes of the set's own band and the next."""
    edges = bands(percent)
    return [int(edges[np.searchsorted(edges, 16 * x) + 1]) for x in range(1, spare + 1)]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles; all words as one where there are fewer."""
    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z only
    return np.unique(windows(hashes(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def sketch_keys(sets: list[np.ndarray], percent: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for each block that a set sends: a block's content is the XOR of the codes of its shingles, so twice is never."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(bands(percent), sizes, side="right") - 1
    everything = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owners, keys = [], []
    for up in (0, 1):
        plans = [scheme(int(b) + up, percent, spare) if n else (0, 0) for b, n in zip(band, sizes)]
        if up:  # no set of the next band can be similar to one that is too small
            floor = bands(percent)[band + 1] * percent
            plans = [p if 100 * n >= f else (0, 0) for p, n, f in zip(plans, sizes, floor)]
        blocks, most_empty = np.array([p[0] for p in plans], np.int64), np.array([p[1] for p in plans], np.int64)
        take = np.repeat(blocks > 0, sizes)
        owner = np.repeat(np.arange(len(sets)), sizes)[take]
        if not len(owner):
            continue
        seed = mix((band[owner] + up + 1).astype(np.uint64))
        placed = mix(everything[take] ^ seed)
        first = np.cumsum(blocks) - blocks
        cell = first[owner] + (placed % blocks[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        full, begin = np.unique(cell[order], return_index=True)
        content = np.bitwise_xor.reduceat(mix(placed + np.uint64(0x51ED270B))[order], begin)
        of = np.searchsorted(first, full, side="right") - 1
        # Sets without blocks share their start with the next one: searchsorted takes the last, which is the one that has blocks.
        filled = np.bincount(of, minlength=len(sets))
        sparse = np.flatnonzero((blocks > 0) & (blocks - filled > most_empty))
        if len(sparse):
            cells = np.concatenate([np.setdiff1d(np.arange(first[i], first[i] + blocks[i]), full[of == i]) for i in sparse])
            full, content = np.concatenate([full, cells]), np.concatenate([content, np.zeros(len(cells), np.uint64)])
            of = np.concatenate([of, np.repeat(sparse, (blocks - filled)[sparse])])
        number = (full - first[of]).astype(np.uint64)
        key = mix(content ^ mix(number + (band[of] + up).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        keys.append((key & ~np.uint64(1)) | ((band[of] + up) & 1).astype(np.uint64))
        owners.append(of)
    return (np.concatenate(owners), np.concatenate(keys)) if owners else (np.empty(0, np.int64), np.empty(0, np.uint64))


def parity(shingles: np.ndarray) -> np.ndarray:
    """A sketch of 64 * WORDS bits in which each shingle flips one: sets differ in no fewer shingles than their sketches in bits."""
    bits = np.bincount((mix(shingles ^ np.uint64(0x7A3D)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in _FIELDS], names=[n for n, _ in _FIELDS])


def _sketches(size: int, percent: int, spare: int, buckets: int):
    """Kind 0: a document and its node, the 64-bit name of its set. Kind 1: the keys of a slice for one bucket, one node for each.
    Kind 2: keys that several nodes of the slice share, with all of them but the one that is sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            sets = [shingle_set(t, size) for t in column(piece, "text").to_pylist()]
            names = np.array([int(mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5)), keepdims=True) + np.uint64(len(s)))[0]) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            none = lambda kind: pa.nulls(piece.num_rows, kind)
            own = {"kind": pa.array(np.zeros(piece.num_rows, np.int32)), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(names, mask=np.array([not len(s) for s in sets], bool))}
            own |= {c: column(piece, c) for c in ("doc_id", "key_a", "key_b")}
            yield pa.RecordBatch.from_arrays([own.get(n, none(_TYPES[k]) if n not in own else None) for n, k in _FIELDS], names=[n for n, _ in _FIELDS])
            _, one = np.unique(names, return_index=True)
            one = [i for i in one if len(sets[i])]
            owner, key = sketch_keys([sets[i] for i in one], percent, spare)
            node = names[one][owner] if len(one) else np.empty(0, np.int64)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            last = np.append(first[1:], True) if len(key) else first
            low = key & np.uint64(0xFFFFFFFF)
            rows = []
            if not first.all():
                rows.append({"kind": 2, "keys": ((bucket[~first] << 32) | low[~first].astype(np.int64)).tolist(), "members": node[~first].tolist()})
            shared = (first & ~last)[first]
            key, node, bucket, low = key[first], node[first], bucket[first], low[first]
            order = np.lexsort((node, bucket))
            for part in np.split(order, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1]):
                if len(part):
                    nodes, counts = np.unique(node[part], return_counts=True)
                    rows.append({
                        "kind": 1, "bucket": int(bucket[part[0]]), "nodes": nodes.tobytes(), "counts": counts.astype(np.uint16).tobytes() if counts.max() < 65536 else counts.astype(np.uint32).tobytes(),
                        "low": low[part].astype(np.uint32).tobytes(), "shared": np.packbits(shared[part]).tobytes()})
            if rows:
                yield _rows(rows)
    return run


def _met(group: pa.Table) -> pa.Table:
    """In one bucket: the keys that more than one node has, or one that the node's slice says is shared, with their nodes."""
    keys, nodes, flags, bucket = [], [], [], 0
    for r in group.to_pylist():
        low, name = np.frombuffer(r["low"], np.uint32), np.frombuffer(r["nodes"], np.int64)
        counts = np.frombuffer(r["counts"], np.uint16 if len(r["counts"]) == 2 * len(name) else np.uint32)
        keys.append(low)
        nodes.append(np.repeat(name, counts))
        flags.append(np.unpackbits(np.frombuffer(r["shared"], np.uint8))[: len(low)].astype(bool))
        bucket = r["bucket"]
    key, node, flag = np.concatenate(keys), np.concatenate(nodes), np.concatenate(flags)
    order = np.lexsort((node, key))
    key, node, flag = key[order], node[order], flag[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    spread = np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start)
    keep = np.repeat(spread | np.logical_or.reduceat(flag, start), np.diff(np.append(start, len(key))))
    return pa.table({"key": pa.array((np.int64(bucket) << 32) | key[keep].astype(np.int64)), "node": pa.array(node[keep])})


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), []
            for x, y in zip(column(batch, "set_a"), column(batch, "set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if len(x) < 64 else int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(pa.array(v, pa.int64()), keep) for v in (a, b)], names=["a", "b"])
    return run


def _bounded(sketches: DataFrame, name: str) -> DataFrame:
    """node, size and sketch under the names of one side of a pair."""
    return sketches.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), *[F.col(f"s{i}").alias(f"s{i}_{name}") for i in range(WORDS)])


def _may_link(percent: int) -> Column:
    """Sizes and sketches of sides a and b allow the similarity."""
    differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(WORDS)), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * differ <= (100 - percent) * both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by their bounds, then on the sets."""
    near = pairs.join(_bounded(sets, "a"), "a").join(_bounded(sets, "b"), "b").where(_may_link(percent)).select("a", "b")
    one, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return written(near.join(other, "b").join(one, "a").select("a", "b", "set_a", "set_b").mapInArrow(_similar(percent), "a long, b long"))


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _frequent_dropped(met: DataFrame, spare_of: Column) -> DataFrame:
    """Each set's keys without its most frequent ones: a similar pair has so many common keys that one of the others is common, too."""
    counted = met.join(met.groupBy("key").agg(F.count("*").alias("seen")).where("seen > 1"), "key")
    order = W.partitionBy("node", "parity").orderBy(F.desc("seen"), "key")
    return counted.withColumn("parity", F.col("key").bitwiseAND(1)).withColumn("nth", F.row_number().over(order)).where(F.col("nth") > spare_of).select("key", "node", "seen")


def _elected(open_keys: DataFrame, order: Column) -> DataFrame:
    """Pairs of a node and the leader that it meets under most keys; a key's leader is the first of its nodes in the order."""
    leaders = open_keys.groupBy("key").agg(F.min(F.struct(order, "node", "component")).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.component").alias("theirs"))
    met = open_keys.join(leaders, "key").where("component <> theirs").groupBy("node", "leader").agg(F.count("*").alias("times"))
    return met.groupBy("node").agg(F.max(F.struct("times", "leader")).alias("best")).select(*_pair("node", "best.leader")).distinct()


def _remaining(open_keys: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a key and no component, and whose sketches allow a link.

    A node meets a large component as a whole, once, whatever the number of their common keys; nodes of small components meet
    key by key. The bounds are part of the join conditions: what comes out are pairs that link or nearly do.
    """
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    sized = written(open_keys.join(sizes, "component", "left").withColumn("members", F.coalesce("members", F.lit(1))).withColumn("large", F.col("members") >= LARGE))
    small = sized.where("NOT large").join(sets.select("node", "n", *[f"s{i}" for i in range(WORDS)]), "node")
    one, other = (small.select("key", F.col("component").alias(f"in_{c}"), F.col("node").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(f"s{i}").alias(f"s{i}_{c}") for i in range(WORDS)]) for c in "ab")
    by_key = one.join(other, "key").where((F.col("in_a") < F.col("in_b")) & _may_link(percent)).select(*_pair("a", "b"))
    whole = sized.where("large").select("key", F.col("component").alias("theirs"), F.col("members").alias("others")).distinct()
    first = (F.col("members") < F.col("others")) | ((F.col("members") == F.col("others")) & (F.col("component") < F.col("theirs")))
    meeting = sized.join(whole, "key").where((F.col("component") != F.col("theirs")) & first).select(F.col("node").alias("a"), "theirs").distinct()
    inside = found.join(sizes.where(F.col("members") >= LARGE).select("component"), "component").select(F.col("node").alias("b"), F.col("component").alias("theirs"))
    by_component = meeting.join(_bounded(sets, "a"), "a").join(inside.join(_bounded(sets, "b"), "b"), "theirs").where(_may_link(percent)).select(*_pair("a", "b"))
    return by_key.union(by_component).distinct()


def linked_nodes(docs: DataFrame, keys: DataFrame, nodes: DataFrame, size: int, percent: int, rounds: int) -> DataFrame:
    """node, component for every node that is linked with another.

    keys: (key, node, seen) of all keys that more than one node has. In a round every key's nodes elect a leader, and each node is
    compared with the leader it meets most often, unless their component is one already. First the node whose keys are the most
    common leads: in a group of near copies that is the one the others were made from, and the group becomes a component by as
    many comparisons as it has members. Then all pairs that still share a key but no component are compared.
    """
    wanted = keys.select("node").distinct().join(nodes, "node")
    shingles = docs.join(wanted.select("node", "key_a", "key_b"), ["key_a", "key_b"]).select("node", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            made = [shingle_set(t, size) for t in column(piece, "text").to_pylist()]
            bits = np.array([parity(s) for s in made], np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(piece, "node"), pa.array(list(map(len, made)), pa.int64()), pa.array([s.tobytes() for s in made], pa.binary()), *[pa.array(bits[:, i]) for i in range(WORDS)]],
                names=["node", "n", "shingles", *[f"s{i}" for i in range(WORDS)]])

    schema = "node long, n long, shingles binary, " + ", ".join(f"s{i} long" for i in range(WORDS))
    sets = written(shingles.mapInArrow(sets_of, schema).dropDuplicates(["node"]))
    common = keys.groupBy("node").agg(F.sum("seen").alias("common"))
    open_keys, edges, found = keys.join(common, "node").withColumn("component", F.col("node")), None, None
    for salt in range(rounds + 1):
        if salt:
            found = written(components(edges))
            placed = open_keys.drop("component").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            open_keys = written(placed.join(mixed, "key"))
            if open_keys.isEmpty():
                return found
        if salt < rounds:
            pairs = _elected(open_keys, F.xxhash64("node", F.lit(salt)) if salt else -F.col("common"))
        else:
            pairs = _remaining(open_keys, found if salt else keys.select("node", F.col("node").alias("component")).limit(0), sets, percent)
        more = _verified(pairs, sets, percent)
        edges = more if edges is None else written(edges.union(more))
    return written(components(edges))


def similar_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, spare: int = SPARE, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, component (a name of the group, null for an empty set), key_a, key_b.

    A document's set is that of its distinct `size`-word shingles (all words as one if there are fewer), A-Z in lower case. Two
    documents link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links reach.

    Sketches: in bands of set sizes, shingles are dealt over blocks and XORed there; blocks of two similar sets differ in no more
    places than the sets do, so enough blocks are equal. Equal blocks are joined, pairs verified on the sets. Nothing is
    approximate: no pair that shares a block stays untested unless links join its ends already.

    Scale: equal sets are one node. Keys travel in binary rows, one a slice of text and bucket; a key that many nodes of a slice
    have is sent once. Groups elect leaders by aggregation. Only the texts of nodes that share a key are read again.

    A null or empty text, or one without words, has an empty set and is its own component. A null doc_id is never the smallest;
    a component of such rows only has a null id. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    buckets = max(LEAST_BUCKETS, text_bytes(keyed) // BUCKET_BYTES)
    made = written(keyed.mapInArrow(_sketches(size, percent, spare, buckets), _ROW))
    members = made.where("kind = 0").select("doc_id", "n", "node", "key_a", "key_b")
    sent = made.where("kind = 1").select("bucket", "nodes", "counts", "low", "shared").groupBy("bucket").applyInArrow(_met, "key long, node long")
    near = made.where("kind = 2").select(F.explode(F.arrays_zip("keys", "members")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.members").alias("node"))
    met = written(sent.union(near).distinct())
    named = members.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("key_a", "key_b")).alias("row"), F.min("n").alias("n"))
    nodes = named.select("node", "row.*", "n")
    spared = sum(((F.col("n") >= n).cast("int") for n in spare_steps(percent, spare)), F.lit(0))
    sized = met.join(nodes.select("node", spared.alias("spared")), "node")
    keys = written(_frequent_dropped(sized.select("key", "node", "spared"), F.col("spared")))
    found = linked_nodes(keyed, keys, nodes, size, percent, rounds)
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.where("node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component", "key_a", "key_b")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each group left, that with the smallest doc_id (null last), with the columns they came with.

    Documents with an empty set are in no group and all stay. Of rows that are equal in id and text one stays.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    groups = similar_groups(plain, at[doc_id], at[text], **options)
    first = groups.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_a", "key_b")).alias("first"))
    alone = groups.where("component IS NULL").select("key_a", "key_b", F.lit(True).alias("alone")).distinct()
    kept = written(first.select("first.key_a", "first.key_b", F.lit(False).alias("alone")).union(alone))
    number = F.row_number().over(W.partitionBy("key_a", "key_b").orderBy("alone"))
    rows = plain.select("*", *row_key(at[doc_id], at[text])).join(kept, ["key_a", "key_b"]).withColumn("number", number).where("alone OR number = 1")
    return rows.select(*plain.columns).toDF(*docs.columns)
