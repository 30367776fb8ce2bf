import random
import re

from tallyframe.llm import decontaminate
from tests.llm.conftest import in_use

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    found |= wins[tuple(w[i:i + k])]
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


def run(spark, docs, texts, items, ids=None):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(in_use(docs(texts, ids)), in_use(bench, "win", "item", "size"))
    return sorted((r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), bench


def test_brute_force(spark, docs):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "É", "straße", "x1", "é", "zu", "ΟΔΟΣ", "ΟΔΟΣ'x", "οδος", "K", "İ"]
    def text(n):
        return " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(30)] + [(100, "rare two"), (101, "Lonely"), (None, "no id here but four and more words follow now yes"), (3, text(12)), (5, None), (6, " .,! ")]
    texts = [None, "", "...", "lonely", "a rare two rare-two", "rare two " * 5000, items[12][1], items[12][1]]
    for _ in range(60):
        parts = [text(rng.randint(0, 30))]
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(w))
            parts += [" ".join(w[a:a + rng.randint(0, 14)]), text(rng.randint(0, 9))]
        texts.append("  ".join(parts) + "!")
    ids = [rng.choice([None, 1, 2, 3]) for _ in texts]
    got, bench = run(spark, docs, texts, items, ids)
    assert got == sorted(brute(texts, items))
    df = in_use(docs(texts, ids))
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for t, b in zip(texts, brute(texts, items)) if not b[1])


def test_empty_tables(spark, docs):
    got, bench = run(spark, docs, ["a b"], [(1, "")])
    assert got == [(2, 0, ())]
    assert decontaminate.contamination(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_beyond_the_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    got, _ = run(spark, docs, ["one two three four", "two three"], [(1, "two three"), (2, "three")])
    assert got == [(2, 2, ("1", "2")), (4, 2, ("1", "2"))]
