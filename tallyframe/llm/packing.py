"""Retrieval packing: windows filled with a seed document and its nearest unused neighbours by BM25."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, slices, written
from tallyframe.llm.tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_DOCS, _LENGTH = -1, -2


def tokenized(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None, end_id: int) -> DataFrame:
    """doc_id, the ids of the text and end_id as packed integers, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary())
        for piece in slices(batches, "text"):
            ids = [np.array([*encode(t or ""), end_id], encode.dtype) for t in column(piece, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(piece, "doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.itemsize for x in ids], pa.int32())],
                names=["doc_id", "ids", "width"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, width int")


def _ids(piece: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, f"<u{w}") for b, w in zip(column(piece, "ids").to_pylist(), column(piece, "width").to_pylist())]


def document_frequencies(tokens: DataFrame) -> dict[int, int]:
    """How many documents hold each id, over all documents; at -1 their number and at -2 their length. As large as the vocabulary at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {_DOCS: 0, _LENGTH: 0}
        counts = np.zeros(0, np.int64)
        for piece in slices(batches, "ids"):
            own = _ids(piece)
            total[_DOCS] += len(own)
            total[_LENGTH] += sum(map(len, own))
            lengths = [len(x) for x in own]
            key = np.repeat(np.arange(len(own), dtype=np.int64), lengths) << 32 | np.concatenate(own).astype(np.int64)
            seen = np.bincount(np.unique(key) & 0xFFFFFFFF)
            counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
            counts[: len(seen)] += seen
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*total, *at.tolist()], pa.int64()), pa.array([*total.values(), *counts[at].tolist()], pa.int64())], names=["token", "n"])

    return {r.token: r.n for r in tokens.select("ids", "width").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


class Index:
    """BM25 over the documents of one shard: for each id its documents and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, k1: float, b: float):
        lengths = np.array([len(d) for d in docs], np.int64)
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) << 24 | np.repeat(np.arange(len(docs)), lengths), return_counts=True)
        token, doc = key >> 24, key & 0xFFFFFF
        useful = idf[token] > 0
        token, doc, tf = token[useful], doc[useful], tf[useful]
        self.size, self.doc = len(docs), doc
        self.weight = idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean_length))
        self.tokens, self.first = np.unique(token, return_index=True)
        self.last = np.append(self.first[1:], len(token))
        by_doc = np.argsort(doc, kind="stable")
        row = np.searchsorted(self.tokens, token)[by_doc]
        self.rows = np.split(row, np.searchsorted(doc[by_doc], np.arange(1, len(docs))))

    def scores(self, seed: int) -> np.ndarray:
        rows = self.rows[seed]
        lengths = self.last[rows] - self.first[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        return np.bincount(self.doc[at], self.weight[at], self.size)


def filled(docs: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as (document, start, length), full but for the last, which is cut to powers of two.

    A document with a full window or more fills windows alone. What is left of it waits with the others: a seed opens a window, its
    best unused neighbours follow until it is full, and the neighbour that had to be cut is the next seed. Ties go to the earlier one.
    """
    start = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for i in range(len(docs)):
        while left[i] >= window:
            yield [(i, int(start[i]), window)]
            start[i] += window
            left[i] -= window
    seed, first = -1, 0
    while True:
        if seed < 0 or not left[seed]:
            while first < len(docs) and not left[first]:
                first += 1
            if first == len(docs):
                return
            seed = first
        pieces, space = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        if space:
            score = np.where(left > 0, index.scores(seed), -1.0)
            while space:
                best = int(np.argmax(score))
                if score[best] < 0:
                    break
                take = min(space, int(left[best]))
                pieces.append((best, int(start[best]), take))
                start[best] += take
                left[best] -= take
                space -= take
                score[best] = -1.0
                seed = best
        if not space:
            yield pieces
            continue
        total = window - space
        for bit in reversed(range(total.bit_length())):
            part, room = [], (total >> bit & 1) << bit
            while room:
                doc, at, length = pieces[0]
                take = min(room, length)
                part.append((doc, at, take))
                room -= take
                pieces[0] = (doc, at + take, length - take)
                if take == length:
                    pieces.pop(0)
            if part:
                yield part
        return


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 2048, vocabulary: str | None = None, end_id: int = 1,
    shard_docs: int = 1024, shard_bytes: int = 4 << 20, k1: float = 1.2, b: float = 0.75, with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents in sequences of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and the ids, if asked for).

    Tokens are made once and written to the shared folder. Document frequencies count every document; an id that more than half
    of them hold has no weight. A shard is up to `shard_docs` documents, or `shard_bytes` of ids, that follow each other in the
    written table: it has an inverted index of its own, so a task holds one shard at a time and copies or a hot source need no
    special care. Only the rest of a shard ends in sequences shorter than the window; they have the lengths of powers of two.

    A null or empty text is the end id alone. Rows with a null or repeated doc_id are documents of their own and keep their id.
    An empty table gives no rows. Other columns are not read.
    """
    tokens = written(tokenized(docs, doc_id, text, vocabulary, end_id))
    frequency = document_frequencies(tokens)
    n, length = frequency.pop(_DOCS, 0), frequency.pop(_LENGTH, 0)
    idf = np.zeros(max(frequency, default=0) + 1)
    for token, df in frequency.items():
        idf[token] = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
    mean = length / max(n, 1)
    schema = SCHEMA + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for names, ids in _shards(batches, shard_docs, shard_bytes):
            index, rows, made = Index(ids, idf, mean, k1, b), [], []
            for pieces in filled(ids, index, window):
                offset = 0
                for doc, start, size in pieces:
                    own = ids[doc][start : start + size].astype("<u4")
                    rows.append((names[doc], start, size, zlib.crc32(own.tobytes()), len(ids[doc]), sequence, offset))
                    made.append(own)
                    offset += size
                sequence += 1
            arrays = [pa.array(values, pa.int64()) for values in zip(*rows)]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in made], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return tokens.mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch], most_docs: int, most_bytes: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    names: list = []
    ids: list[np.ndarray] = []
    size = 0
    for piece in slices(batches, "ids"):
        for name, own in zip(column(piece, "doc_id").to_pylist(), _ids(piece)):
            if ids and (len(ids) == most_docs or size + own.nbytes > most_bytes):
                yield names, ids
                names, ids, size = [], [], 0
            names.append(name)
            ids.append(own)
            size += own.nbytes
    if ids:
        yield names, ids
