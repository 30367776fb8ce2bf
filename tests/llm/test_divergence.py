import random
import re

import numpy as np
import pytest

from tallyframe.llm import divergence
from tests.llm.conftest import DOCS, in_use

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=3, ranks=200):
    """rows: lang, source, text."""
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [(lang, source, TERM.findall(text.translate(LOW))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, counts = {}, {r[1]: {} for r in rows if r[0] == lang}
        for _, source, terms in [w for w in words if w[0] == lang]:
            for t in set(terms):
                df[t] = df.get(t, 0) + 1
            for t in terms:
                counts[source][t] = counts[source].get(t, 0) + 1
        kept = sorted(t for t, n in df.items() if n >= least)
        n = {s: sum(c.get(t, 0) for t in kept) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c.get(t, 0) + 1) // (n[s] + len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (sum(c.get(t, 0) for c in counts.values()) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s].get(t, 0) and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, text, lang, source, 1) for i, (lang, source, text) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("slice_rows", [2, 16, 1 << 15])
def test_brute_force(spark, slice_rows):
    rng = random.Random(slice_rows)
    pool = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "éa", "ΩΩ", " x", "T1T", "😀"]
    rows = [(rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "é", None, "", "b", "c"]), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for _ in range(120)]
    rows += [("en", "a", None), ("none", "s1", ""), ("none", "s2", None), ("few", "s1", "one two"), ("few", "s2", "one"), ("en", "a", "w" * 70_000), ("en", "a", "hot " * 30_000)] * 3
    rows += [("solo", "s", "x y z")] * 4 + [("rank", "r", " ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)))] * 3 + [("rank", "o", "other " * 900)] * 3
    got = divergence.divergences(in_use(made(spark, rows), "term", "n", "slice", "total").repartition(6), slice_rows=slice_rows)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty(spark):
    assert divergence.divergences(made(spark, [])).count() == 0


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1000), (700, 900), (3, 100_000), (5000, 5000), (64, 64)):
        a, b = (np.unique(rng.integers(0, 3 * max(n, m), k)) for k in (n, m))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()
        at_a, at_b = divergence.overlap(a, b)
        assert (a[at_a] == b[at_b]).all() and set(a[at_a]) == set(a) & set(b)


def test_shares_are_exact():
    for total in (1, 7, 999_999_937, 9_000_000_000_000_000):
        counts = np.unique(np.array([0, total // 3, total // 2, total - 1]))
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
