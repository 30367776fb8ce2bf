import random

import numpy as np

from tallyframe.llm import quality
from tallyframe.llm.common import hashes, words_of
from tests.llm.conftest import in_use


def brute(text, window=8):
    words = (text or "").encode().split()
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i:i + window]), []).append(i)
    hit = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(window)}
    longest = 0
    for places in seen.values():
        for x in range(len(places)):
            for y in range(x):
                a, b, k = places[y], places[x], 0
                while b + k < len(words) and words[a + k] == words[b + k]:
                    k += 1
                longest = max(longest, k)
    return len(words), len(hit), sum(len(words[i].decode()) for i in hit), longest


def cases():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a " * 400, "one two three " * 30, "x\x85y z w " * 10, "ab\x1ccd ef " * 12]
    for _ in range(150):
        vocabulary = [f"w{i}é" for i in range(rng.choice([2, 3, 8, 200]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(words))
            words[rng.randrange(len(words)):0] = words[a:a + rng.randint(1, 40)]
        out.append(" ".join(words))
    return out


def test_measures_match_brute_force():
    texts = cases()
    for text, row in zip(texts, quality.measured(texts, 8, 20, 30, 0.25, 200)):
        n, repeat, chars, longest = brute(text)
        assert (row[0], row[4], row[5], row[6]) == (n, repeat, chars, longest), text
        assert sum(s["end"] - s["start"] for s in row[8]) == repeat
        assert row[9] == (n < 20 or 100 * repeat > 30 * n)


def test_suffixes_come_in_order():
    text = "a b c a b c a b d a b c a b " * 3
    h = hashes(words_of(text))
    sa, lcp = quality.suffix_array(h, np.zeros(len(h), np.int64), 2)
    assert [tuple(h[p:]) for p in sa] == sorted(tuple(h[p:]) for p in sa)
    for i in range(1, len(sa)):
        k = 0
        while max(sa[i], sa[i - 1]) + k < len(h) and h[sa[i] + k] == h[sa[i - 1] + k]:
            k += 1
        assert k == lcp[i] or (k < 2 and lcp[i] <= k)


def test_table(spark, docs):
    long = "plain " + " ".join(f"word{i}" for i in range(300_000))
    good = " ".join(f"clean{i}" for i in range(60))
    df = in_use(docs([None, "", good, good, good + "\n" + good, long, "# $ <a> x\nx\nx"], [5, None, 1, 1, 3, 4, 6]))
    rows = quality.score(df).collect()
    assert [(r.doc_id, r.n_words, r.kept, r.base_failed) for r in rows] == [
        (5, 0, False, True), (None, 0, False, True), (1, 60, True, False), (1, 60, True, False), (3, 120, False, True), (4, 300_001, True, False), (6, 6, False, True)]
    assert (rows[6].n_symbols, rows[6].n_dup_lines, rows[6].word_chars) == (4, 1, 8)
    kept = quality.keep(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert quality.score(df.limit(0)).count() == 0
