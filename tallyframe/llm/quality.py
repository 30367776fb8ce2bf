"""Quality rules on repetition found with a suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.common import column, covered, hashes, slices, windows, words_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("repeat_chars", pa.int64()), ("longest_repeat", pa.int64()), ("n_repeats", pa.int64()),
    ("repeat_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, longest_repeat long, "
    "n_repeats long, repeat_spans array<struct<start:int,end:int>>, base_failed boolean, kept boolean")


def suffix_array(h: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first `least` words repeat in their document, in suffix order, and each one's common prefix with the one before.

    h: the words of several documents one after the other, doc: the document of each. Suffixes that share fewer words can't
    begin a repeat of that length, so only the others are sorted: first by their `least` words, then by prefix doubling,
    where places still tied are ranked by the rank of what follows. Documents never meet.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h)
    if n < least:
        return none
    key = windows(h, least)
    inside = doc[: len(key)] == doc[least - 1 :]
    key = key ^ (doc[: len(key)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.sort(key[inside])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return none
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    cand = np.flatnonzero(inside & (twice[at] == key))
    # Ranks of these places and of those right behind them, which decide how ties go on.
    need = np.union1d(cand, np.minimum(cand + least, n))
    need = need[(need < n)]
    padded, owner = np.concatenate([h, np.zeros(least, np.uint64)]), np.concatenate([doc, np.full(least, -1, doc.dtype)])
    columns = [np.where(owner[need + k] == doc[need], padded[need + k], np.uint64(0)) for k in range(least)]
    place = {"need": need}

    def look(positions: np.ndarray, owners: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Ranks at the positions; 0 beyond a document's end."""
        i = np.minimum(np.searchsorted(place["need"], positions), len(need) - 1)
        found = (place["need"][i] == positions) & (positions < n)
        found[found] &= doc[positions[found]] == owners[found]
        return np.where(found, rank[i] + 1, 0)

    def ranks(keys: list[np.ndarray]) -> np.ndarray:
        o = np.lexsort(keys[::-1])
        new = np.zeros(len(o), bool)
        for k in keys:
            new[1:] |= k[o][1:] != k[o][:-1]
        out = np.empty(len(o), np.int64)
        out[o] = np.cumsum(new)
        return out

    owners = doc[need]
    levels = [(least, ranks([owners, *columns]))]
    while True:
        size, rank = levels[-1]
        if len(np.unique(rank)) == len(rank):
            break
        nxt = ranks([rank, look(need + size, owners, rank)])
        if nxt.max() == rank.max():
            break
        levels.append((2 * size, nxt))
    mine = np.searchsorted(need, cand)
    o = np.argsort(levels[-1][1][mine], kind="stable")
    sa = cand[o]
    # Common prefixes of neighbours, by the levels from the longest down and the last words one by one.
    a, b = sa[:-1].copy(), sa[1:].copy()
    same = doc[a] == doc[b]
    lcp = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        go = same & (a < n) & (b < n)
        x, y = look(a, doc[sa[:-1]], rank), look(b, doc[sa[1:]], rank)
        hit = go & (x > 0) & (x == y)
        lcp[hit] += size
        a[hit] += size
        b[hit] += size
    for _ in range(least - 1):
        go = same & (a < n) & (b < n)
        i, j = np.minimum(a, n - 1), np.minimum(b, n - 1)
        go &= (doc[i] == doc[sa[:-1]]) & (doc[j] == doc[sa[1:]]) & (h[i] == h[j])
        if not go.any():
            break
        lcp[go] += 1
        a[go] += 1
        b[go] += 1
    return sa, np.concatenate([[0], lcp])


def maximal_repeats(h: np.ndarray, doc: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> dict[int, int]:
    """How many common-prefix intervals of each document can't be widened to the left: its maximal repeated substrings."""
    count: dict[int, int] = {}
    stack: list[list] = []  # depth, the word before, or None once two differ

    def before(p: int) -> int:
        return int(h[p - 1]) if p and doc[p - 1] == doc[p] else -1 - int(p)

    prior = before(sa[0]) if len(sa) else None
    for i in range(1, len(sa) + 1):
        depth = int(lcp[i]) if i < len(sa) else 0
        depth = depth if depth >= least else 0
        left = prior
        while stack and stack[-1][0] > depth:
            _, seen = stack.pop()
            seen = seen if seen == left else None
            if seen is None:
                count[int(doc[sa[i - 1]])] = count.get(int(doc[sa[i - 1]]), 0) + 1
            left = seen
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1] = stack[-1][1] if stack[-1][1] == left else None
            else:
                stack.append([depth, left])
        if i < len(sa):
            prior = before(sa[i])
    return count


def measured(texts: list[str | None], window: int, base_words: int, base_percent: int, max_covered: float, longest: int) -> list[tuple]:
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    h = np.concatenate([hashes(w) for w in split]) if len(split) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(split), dtype=np.int64), sizes)
    sa, lcp = suffix_array(h, doc, window)
    reach = np.maximum(lcp, np.append(lcp[1:], 0)) if len(sa) else lcp
    hit = covered(len(h), sa, reach) if len(sa) else np.zeros(len(h), bool)
    longest_of = np.zeros(len(split), np.int64)
    if len(sa):
        np.maximum.at(longest_of, doc[sa], reach)
    repeats = maximal_repeats(h, doc, sa, lcp, window) if len(sa) else {}
    first = np.cumsum(sizes) - sizes
    out = []
    for i, (text, words) in enumerate(zip(texts, split)):
        n = len(words)
        raw = text.encode() if text else b""
        inner = hit[first[i] : first[i] + n]
        n_repeat = int(inner.sum())
        if n_repeat:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inner.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]
            repeat_chars = sum(len(w.decode()) for s in spans for w in words[s["start"] : s["end"]])
        else:
            spans, repeat_chars = [], 0
        word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES))) if text else 0
        lines = [x for x in raw.split(b"\n") if x.split()]
        failed = n < base_words or 100 * n_repeat > base_percent * n
        kept = not failed and repeat_chars <= max_covered * word_chars and int(longest_of[i]) <= longest
        out.append((
            n, word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, repeat_chars, int(longest_of[i]),
            repeats.get(i, 0), spans, failed, kept))
    return out


def score(docs: DataFrame, text: str = "text", window: int = 8, base_words: int = 20, base_percent: int = 30, max_covered: float = 0.3, longest: int = 200) -> DataFrame:
    """The documents with their repetition measures and a verdict.

    Repeats are substrings of `window` words or more that occur twice in one document, found as common-prefix intervals of its
    suffix array; their spans are united (`repeat_spans`, in words). Base rule: fewer than `base_words` words, or more than
    `base_percent` percent of the words in repeats. A document is kept if it passes the base rule, repeats cover at most the
    share `max_covered` of the characters in words, and no repeat is longer than `longest` words.

    No shuffle: a document is judged alone, in slices of a few MB of text. A null or empty text has no words and fails the
    base rule. Repeated rows get equal measures. Columns of the input that have a measure's name are replaced by it.
    """
    names = [n for n, _ in FIELDS]
    rest = docs.select(*[c for c in docs.columns if c not in names])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text):
            rows = measured(column(piece, text).to_pylist(), window, base_words, base_percent, max_covered, longest)
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)]
            yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, *names])

    return rest.mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    passed = score(plain, f"c{docs.columns.index(text)}", **limits).where("kept")
    return passed.select(*plain.columns).toDF(*docs.columns)
