import random

import numpy as np
import pytest

from tallyframe.llm import similar
from tallyframe.llm.graph import components
from tests.llm.conftest import in_use


def shingles(text, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[top(i)] = min(smallest.get(top(i), doc), doc)
    return sorted(((doc, len(sets[i]), smallest.get(top(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(rng, groups, members):
    passage = [f"hot{i}" for i in range(40)]
    texts = [None, "", " \n ", "A b", "a B", "one two three four five", "one two three four"]
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 15, 30, 60, 150, 400]))]
        if rng.random() < 0.4:
            base[5:5] = passage
        for _ in range(rng.randint(1, members)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[at] = f"x{rng.randrange(10**6)}"
                else:
                    words[at:at + 1] = []
                words = words or ["z"]
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed, size, percent, rounds", [(1, 4, 85, 3), (2, 5, 80, 1), (3, 2, 60, 0)])
def test_brute_force(spark, docs, monkeypatch, seed, size, percent, rounds):
    rng = random.Random(seed)
    texts = corpus(rng, 60, 8)
    ids = [rng.choice([None, *range(500)]) for _ in texts]
    if seed == 3:
        monkeypatch.setattr(similar, "LARGE", 3)
    if seed == 2:
        real = similar.slices
        monkeypatch.setattr(similar, "slices", lambda b, c: real(b, c, 3000))
    got = similar.similar_groups(in_use(docs(texts, ids), "node", "key", "n").repartition(4), size=size, percent=percent, rounds=rounds)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)
    want = brute(list(zip(ids, texts)), size, percent)
    assert rows == want
    assert len({r[2] for r in want}) < 0.7 * len(want)


def test_no_links(spark, docs):
    got = similar.similar_groups(docs(["a b c d e f", None, "x"])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert similar.similar_groups(docs([])).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_blocks(percent):
    """The promise of `scheme`: a pair at the limit of similarity shares more keys than may be dropped as frequent."""
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 101, 333, 1000, 5000]:
        for _ in range(4):
            extra = int(rng.integers(0, n * (100 - percent) // percent + 1)) if n else 0
            lost = max(0, (100 * n - percent * (n + extra)) // 100)
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, extra, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            owner, key = similar.sketch_keys([a, b], percent, similar.SPARE)
            common = len(np.intersect1d(key[owner == 0], key[owner == 1]))
            dropped = max(sum(len(s) >= x for x in similar.spare_steps(percent, similar.SPARE)) for s in (a, b))
            assert common > dropped or np.array_equal(a, b), (n, len(a), len(b), common, dropped)


def test_sketches_bound_the_distance():
    rng = np.random.default_rng(3)
    for n in (1, 5, 80, 700):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 3:], rng.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        differ = int(np.bitwise_count((similar.parity(a) ^ similar.parity(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (n == 1 or differ > 0)


def test_blocks_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for changed in (0, 1, 5, 20):
        other = np.unique(np.concatenate([base[changed:], rng.integers(0, 2**63, changed, dtype=np.uint64)]))
        owner, key = similar.sketch_keys([np.unique(base), other], 85, 0)
        mine, theirs = set(key[owner == 0].tolist()), set(key[owner == 1].tolist())
        assert len(mine - theirs) <= 2 * 2 * changed  # two schemes


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {n: n for e in edges for n in e}
    for _ in range(300):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    loops = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in group.items() if n not in loops}
