"""Substring deduplication: word passages that an earlier document holds, found by fixed blocks as anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, covered, expanded, hashes, row_key, slices, text_bytes, windows, words_of, written

#: Text in bytes whose windows one bucket of the exchange takes; the number of buckets grows with the corpus.
BUCKET_BYTES = 12 << 20
LEAST_BUCKETS = 64
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_LIVE = "bucket int, doc_id long, live array<int>, ids binary, counts binary, hash binary, place binary, wide int"
_COPIES = "bucket int, key_a long, key_b long, copies array<int>, ids binary, key_as binary, key_bs binary, counts binary, high binary, low binary, place binary"


def _planes(values: np.ndarray) -> bytes:
    """The numbers with their first bytes together, then the second ones, and so on: small numbers compress well this way."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def _lists(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The groups that occur, in order, and the list of values of each; `group` is sorted."""
    names, first = np.unique(group, return_index=True)
    return names, pa.ListArray.from_arrays(pa.array(np.append(first, len(group)), pa.int32()), pa.array(values, pa.int32()))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, where each group of equal keys starts in it, and the group of each place in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _slice_words(piece: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with an id and at least so many words: their rows, word hashes one document after the other, and where each starts and ends."""
    rows, found = [], []
    for i, (doc, text) in enumerate(zip(column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist())):
        words = words_of(text) if doc is not None else []
        if len(words) >= least:
            rows.append(i)
            found.append(hashes(words))
    sizes = np.array([len(x) for x in found], np.int64)
    return np.array(rows, np.int64), np.concatenate(found) if found else np.empty(0, np.uint64), np.cumsum(sizes) - sizes, sizes


def _probe(window: int, block: int, buckets: int):
    """Blocks of each document: those whose fate is known from the slice alone, and one row a bucket with the others.

    A place is live if the block there may be part of a repeat: the block starts a reference block of a smaller document, or is
    a reference block itself and occurs in a larger one. The smallest reference and the largest occurrence of a block stand for
    the slice, so a passage that many documents share sends a few entries a slice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            rows, h, first, sizes = _slice_words(piece, window)
            if not len(rows):
                continue
            ids = column(piece, "doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            at = expanded(first, sizes - block + 1)
            doc = np.repeat(np.arange(len(rows)), sizes - block + 1)
            key, place, name = windows(h, block)[at], at - first[doc], ids[doc]
            order, start, group = _groups(key)
            reference = place % block == 0
            least = np.minimum.reduceat(np.where(reference, name, np.iinfo(np.int64).max)[order], start)
            most = np.maximum.reduceat(name[order], start)
            low, high = np.empty_like(name), np.empty_like(name)
            low[order], high[order] = least[group], most[group]
            hit, told = name > low, reference & (name < high)
            live = hit | told
            if live.any():
                names, lists = _lists(place[live], doc[live])
                none = pa.nulls(len(names), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[names] % buckets, pa.int32()), pa.array(ids[names]), lists, none, none, none, none, pa.nulls(len(names), pa.int32())], names=_names(_LIVE))
            send = np.flatnonzero(~live | (name == high) | (reference & (name == low)))
            bucket = ((key[send] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            send = send[np.argsort(bucket, kind="stable")]
            out = []
            for part in np.split(send, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1]):
                if len(part):
                    docs_in, begin, counts = np.unique(doc[part], return_index=True, return_counts=True)
                    step = np.diff(place[part], prepend=0)
                    step[begin] = place[part][begin]
                    wide = 4 if step.max() > 65535 else 2
                    out.append((
                        int((key[part[0]] >> np.uint64(32)) % np.uint64(buckets)), None, None, _planes(np.diff(ids[docs_in], prepend=0)), _planes(counts.astype(np.uint32)),
                        (key[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), _planes(step.astype(f"<u{wide}")), wide))
            yield _batch(out, _LIVE)
    return run


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [_TYPES[f.split()[1]] for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(schema))


def _decide(block: int):
    """In one bucket: which of the sent places are live, over all slices."""
    def run(group: pa.Table) -> pa.Table:
        local = group.filter(pc.is_valid(group["doc_id"])).select(["doc_id", "live"])
        sent = group.filter(pc.is_null(group["doc_id"])).to_pylist()
        if not sent:
            return local
        key = np.concatenate([np.frombuffer(r["hash"], np.uint32) for r in sent])
        name, place = [], []
        for r in sent:
            counts = _from_planes(r["counts"], "<u4").astype(np.int64)
            step = _from_planes(r["place"], f"<u{r['wide']}").astype(np.int64)
            total = np.cumsum(step)
            before = np.cumsum(counts) - counts
            place.append(total - np.repeat(total[before] - step[before], counts))
            name.append(np.repeat(np.cumsum(_from_planes(r["ids"], "<i8")), counts))
        name, place = np.concatenate(name), np.concatenate(place)
        order, start, member = _groups(key)
        name, place = name[order], place[order]
        reference = place % block == 0
        least = np.minimum.reduceat(np.where(reference, name, np.iinfo(np.int64).max), start)[member]
        most = np.maximum.reduceat(name, start)[member]
        live = (name > least) | (reference & (name < most))
        name, place = name[live], place[live]
        by = np.argsort(name, kind="stable")
        names, lists = _lists(place[by], name[by])
        return pa.concat_tables([local, pa.table({"doc_id": pa.array(names, pa.int64()), "live": lists}).cast(local.schema)])
    return run


def _candidates(window: int, block: int, buckets: int):
    """Windows around live places under a 128-bit hash: those that a smaller document of the slice has, and the rest by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            rows, h, first, sizes = _slice_words(piece, window)
            if not len(rows):
                continue
            live = column(piece, "live").take(pa.array(rows))
            per = np.diff(live.offsets.to_numpy())
            owner = np.repeat(np.arange(len(rows)), per)
            place = live.flatten().to_numpy().astype(np.int64)
            inside = place <= sizes[owner] - block  # another row with this id may be longer
            owner, place = owner[inside], place[inside]
            begin = np.maximum(place - (window - block), 0)
            last = np.minimum(place, sizes[owner] - window)
            spread = covered(len(h), first[owner] + begin, last - begin + 1)
            at = np.flatnonzero(spread)
            doc = np.searchsorted(first, at, side="right") - 1
            high, low = windows(h, window)[at], windows(h, window, _SECOND_BASE)[at]
            take = lambda name: column(piece, name).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            ids, key_a, key_b = take("doc_id"), take("key_a"), take("key_b")
            name = ids[doc]
            order, start, member = _groups(high, low)
            least = np.empty_like(name)
            least[order] = np.minimum.reduceat(name[order], start)[member] if len(order) else least
            copy = name > least
            if copy.any():
                names, lists = _lists((at - first[doc])[copy], doc[copy])
                none = pa.nulls(len(names), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[names] % buckets, pa.int32()), pa.array(key_a[names]), pa.array(key_b[names]), lists, *[none] * 7], names=_names(_COPIES))
            send = np.flatnonzero(~copy)
            bucket = (high[send] % np.uint64(buckets)).astype(np.int64)
            send = send[np.argsort(bucket, kind="stable")]
            out = []
            for part in np.split(send, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1]):
                if len(part):
                    docs_in, counts = np.unique(doc[part], return_counts=True)
                    out.append((
                        int(high[part[0]] % np.uint64(buckets)), None, None, None, _planes(np.diff(ids[docs_in], prepend=0)), key_a[docs_in].tobytes(), key_b[docs_in].tobytes(),
                        _planes(counts.astype(np.uint32)), high[part].tobytes(), low[part].tobytes(), _planes((at - first[doc])[part].astype(np.uint32))))
            yield _batch(out, _COPIES)
    return run


def _verify(group: pa.Table) -> pa.Table:
    """In one bucket: the windows that a smaller document has."""
    local = group.filter(pc.is_valid(group["copies"])).select(["key_a", "key_b", "copies"])
    sent = group.filter(pc.is_null(group["copies"])).to_pylist()
    if not sent:
        return local
    high, low = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in sent]) for k in ("high", "low"))
    place = np.concatenate([_from_planes(r["place"], "<u4") for r in sent])
    key_as, key_bs = (np.concatenate([np.frombuffer(r[k], np.int64) for r in sent]) for k in ("key_as", "key_bs"))
    ids = np.concatenate([np.cumsum(_from_planes(r["ids"], "<i8")) for r in sent])
    doc = np.repeat(np.arange(len(ids)), np.concatenate([_from_planes(r["counts"], "<u4") for r in sent]).astype(np.int64))
    order, start, member = _groups(high, low)
    name = ids[doc][order]
    copy = order[name > np.minimum.reduceat(name, start)[member]]
    by = copy[np.argsort(doc[copy], kind="stable")]
    names, lists = _lists(place[by], doc[by])
    return pa.concat_tables([local, pa.table({"key_a": key_as[names], "key_b": key_bs[names], "copies": lists}).cast(local.schema)])


def _gathered(rows: DataFrame, values: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.flatten(F.collect_list(values)).alias(values))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed_spans (words, end exclusive), kept_text.

    A word goes if it lies in a run of `window` words that also starts in a document with a smaller doc_id. Every document is
    reference and probe: reference blocks are the non-overlapping blocks of (window + 1) / 2 words, so that each window holds
    one whole, and every rolling block of that size probes them by a short hash. Windows around the hits, which cover every
    repeat from one end to the other, are then compared over their full length by a 128-bit hash; runs of windows with a
    smaller owner are the maximal repeats.

    Scale: hashes travel as arrays in binary rows, one a slice of text and bucket, after each slice has settled what it can by
    itself. A bucket takes the windows of BUCKET_BYTES of text. Texts are shuffled twice, by row or id, never by passage.

    A null or empty text has no words. A row with a null doc_id has no place in the order: it keeps its words and makes no
    copies. Rows that share a doc_id are not copies of each other. Other columns are not read.
    """
    block = (window + 1) // 2
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    buckets = max(LEAST_BUCKETS, text_bytes(keyed) // BUCKET_BYTES)
    probes = keyed.select("doc_id", "text").mapInArrow(_probe(window, block, buckets), _LIVE)
    live = written(probes.groupBy("bucket").applyInArrow(_decide(block), "doc_id long, live array<int>"))
    near = keyed.join(_gathered(live, "live", "doc_id"), "doc_id").select("doc_id", "key_a", "key_b", "text", "live")
    tried = near.mapInArrow(_candidates(window, block, buckets), _COPIES)
    copies = written(tried.groupBy("bucket").applyInArrow(_verify, "key_a long, key_b long, copies array<int>"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            out = []
            for t, places in zip(column(piece, "text").to_pylist(), column(piece, "copies")):
                words, spans = words_of(t), []
                n = len(words)
                if places.is_valid:
                    hit = covered(n, np.unique(places.values.to_numpy()), window)
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
                    words = [w for w, gone in zip(words, hit.tolist()) if not gone]
                out.append((n, n - len(words), spans, b" ".join(words).decode()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [column(piece, "doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed_spans", "kept_text"])

    marked = keyed.join(_gathered(copies, "copies", "key_a", "key_b"), ["key_a", "key_b"], "left").select("doc_id", "text", "copies")
    return marked.mapInArrow(keep, "doc_id long, n_words long, n_removed long, removed_spans array<struct<start:int,end:int>>, kept_text string")
