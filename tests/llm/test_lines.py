import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import lines
from tests.llm.conftest import in_use

SPACES = " \t\n\r\x0b\x0c"


def brute(rows, least, long_words):
    """Documents in order; the first of equal runs stays."""
    seqs = {}
    for doc, text in rows:
        seqs[doc] = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    seen, gone = set(), {d: set() for d in seqs}
    for size in {1, least}:
        for doc in sorted(seqs, key=lambda d: (d is None, d or 0)):
            s = seqs[doc]
            for p in range(len(s) - size + 1):
                run = tuple(s[p:p + size])
                if run in seen and (size == least or len(run[0].encode().split()) >= long_words):
                    gone[doc].update(range(p, p + size))
                seen.add(run)
    out = []
    for doc, text in rows:
        kept, n = [], -1
        for x in (text or "").split("\n") if text else []:
            n += bool(x.strip(SPACES))
            if n < 0 or n not in gone[doc]:
                kept.append(x)
        out.append((doc, None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_brute_force(spark, docs, least):
    rng = random.Random(least)
    pool = ["a", "b", "c é", "a ", "long " * 20, "long2 " * 25]
    texts = [None, "", "\n\n", "a\nb\nc é", " \n\na\n\nb\n \nc é\n"]
    for _ in range(80):
        texts.append("\n".join(rng.choice([*pool, "", f"own {rng.random()}"]) for _ in range(rng.randint(1, 14))))
    ids = [*range(len(texts) - 1), None]
    rng.shuffle(ids)
    df = in_use(docs(texts, ids), "seq", "rank", "n_lines")
    got = lines.without_repeats(df.repartition(3), min_lines=least)
    rows = got.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == brute(list(zip(ids, texts)), least, 20)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r.removed_runs) == r.n_removed


def test_equal_rows(spark, docs):
    got = lines.without_repeats(docs(["x\ny", "x\ny", "x\ny\nz"], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "x\ny"), (1, "x\ny"), (2, "z")]
    assert lines.without_repeats(docs([])).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_runs_of_any_length(spark, docs, least):
    """Ranks end at `least` lines, yet every longer run that stands earlier goes too, with nothing beside it."""
    rng = random.Random(10 + least)
    passages = [[f"p{i} {j}" for j in range(rng.randint(2, 17))] for i in range(5)]
    rows = []
    for i in range(50):
        s = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            s += [*p[a:a + rng.randint(1, 17)], *[f"own {rng.random()}"] * rng.randint(0, 2)]
        rows.append((i, s))
    seen, gone = set(), {i: set() for i, _ in rows}
    for i, s in rows:
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                if (b - a, *s[a:b]) in seen:
                    gone[i].update(range(a, b))
                seen.add((b - a, *s[a:b]))
    got = lines.without_repeats(docs(["\n".join(s) for _, s in rows]).repartition(3), min_lines=least).collect()
    assert {r.doc_id: r.text for r in got} == {i: "\n".join(x for p, x in enumerate(s) if p not in gone[i]) for i, s in rows}
    assert sum(map(len, gone.values())) > 50


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("least", [1, 2, 3])
def test_maximal_runs(spark, docs, least):
    """Against all pairs: every run reported is a maximal pair, each suffix's longest common prefix is found, and no run is missed."""
    rng = random.Random(20 + least)
    passages = [[f"p{i} {j % 7}" for j in range(rng.randint(2, 30))] for i in range(4)] + [["same"] * 19]
    rows = {None: passages[0] + ["x"], 0: passages[0], 1: [], 2: passages[0]}
    for i in range(3, 40):
        s = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            s += [*p[a:a + rng.randint(1, 30)], *[f"own {rng.random()}"] * rng.randint(0, 2)]
        rows[i] = s
    got = lines.without_repeats(docs(["\n".join(s) for s in rows.values()], list(rows)).repartition(3), min_lines=least).collect()
    places = [(d, p) for d, s in rows.items() for p in range(len(s))]
    longest = {a: max((common(rows[a[0]][a[1]:], rows[b[0]][b[1]:]) for b in places if a != b), default=0) for a in places}
    found = {}
    for r in got:
        for run in r.maximal_runs:
            a, b, n = (r.doc_id, run.start), (run.copy_doc, run.copy_start), run.end - run.start
            assert n >= least and a != b and common(rows[a[0]][a[1]:], rows[b[0]][b[1]:]) == n
            assert a[1] == 0 or b[1] == 0 or rows[a[0]][a[1] - 1] != rows[b[0]][b[1] - 1]
            for k in range(n):
                found[a[0], a[1] + k] = max(found.get((a[0], a[1] + k), 0), n - k)
    assert {a: n for a, n in longest.items() if n >= least} == {a: n for a, n in found.items() if n >= least}
    assert max(longest.values()) >= 15


def test_array_order(spark, docs):
    """The last level ranks every suffix of repeating lines alone, in the order of the lines' names."""
    rng = random.Random(30)
    rows = ["\n".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    df = docs(rows).select("doc_id", F.col("doc_id").alias("key_a"), F.lit(0).cast("long").alias("key_b"), "text")
    names = df.mapInArrow(lines._name_arrays(20), lines._NAMES)
    last = lines.suffix_array(names, 2)[-1].ranks.collect()
    name = {r.doc_id: list(zip(r.name_a, r.name_b)) for r in names.collect()}
    ranks = {(r.doc_id, p): k for r in last for p, k in enumerate(r.rank)}
    assert sorted(ranks.values()) == list(range(len(ranks)))
    order = sorted(ranks, key=ranks.get)
    assert [name[d][p:] for d, p in order] == sorted(name[d][p:] for d, p in order)
