import random

import pytest

from tallyframe.llm import substrings
from tests.llm.conftest import in_use


def brute(rows, window=13):
    owner = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for doc, w in split:
        for p in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[p:p + window])
                owner[key] = min(owner.get(key, doc), doc)
    out = []
    for doc, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if doc is not None and owner[tuple(w[p:p + window])] < doc:
                gone.update(range(p, p + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    passages = [[f"p{i}_{j}é" for j in range(rng.randint(8, 40))] for i in range(6)]
    texts = [None, "", "  \n", "short one"]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a:a + rng.randint(5, 40)]
            else:
                words += [f"u{rng.randrange(3 if rng.random() < 0.1 else 10**6)}" for _ in range(rng.randint(0, 30))]
        texts.append(rng.choice([" ", "\n"]).join(words))
    texts += [texts[10], texts[10], "same " * 500, "same " * 100]
    return texts


@pytest.mark.parametrize("seed, slice_bytes", [(1, 4 << 20), (2, 600)])
def test_brute_force(spark, docs, monkeypatch, seed, slice_bytes):
    rng, texts = random.Random(seed), corpus(seed)
    ids = [rng.choice([None, *range(-3, 200)]) for _ in texts]
    real = substrings.slices
    monkeypatch.setattr(substrings, "slices", lambda b, c: real(b, c, slice_bytes))
    got = substrings.without_copies(in_use(docs(texts, ids), "copies", "live").repartition(4))
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(list(zip(ids, texts)))
    assert sum(r[2] for r in rows) > 500


def test_empty_table(spark, docs):
    assert substrings.without_copies(docs([])).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_smallest_reference_reaches_other_slices(spark, docs, monkeypatch, flip):
    w = [f"w{i}" for i in range(13)]
    one = [(1, " ".join(w)), (2, " ".join(["x", *w[:7], "y1", "y2", "y3", "y4", "y5"]))]
    two = [(3, " ".join(["z", *w]))]
    rows = two + one if flip else one + two
    real = substrings.slices
    monkeypatch.setattr(substrings, "slices", lambda b, c: real(b, c, 80))  # documents 1 and 2 in a slice, 3 in another
    got = substrings.without_copies(docs([t for _, t in rows], [i for i, _ in rows]).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == brute(rows)
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}
