import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import manifest, places
from tests.llm.conftest import DOCS, in_use


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def others(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % 3:i - i % 3 + 3]
            out.append((i % 3, run[:i % 3] + run[i % 3 + 1:]))
            i //= 3
        return out

    trees, out = {}, []
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = grow([leaf_of(r) for r in groups[s]])
    top = grow([trees[s][-1][0] for s in order])
    for n, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = others(trees[s], i) + others(top, n)
            digest = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                digest = leaf_of((*r[:4], r[4].replace("\n", "")))
            for at, rest in steps:
                digest = h(*rest[:at], digest, *rest[at:])
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], h(*[x for _, rest in steps for x in rest]), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(docs, **options):
    return sorted(map(tuple, manifest.manifest(docs, **options).select(*COLUMNS).collect()), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], DOCS)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_brute_force(spark, levels):
    """Blocks of 3, 9 and 2,187 leaves: many rounds over the cluster, and one."""
    rng = random.Random(levels)
    sources = [None, "", "é", "b", "a", *[f"s{i}" for i in range(9)]]
    rows = [(rng.randrange(80) if rng.random() < 0.9 else None, rng.choice([None, "b", rng.choice(sources)]), rng.choice([None, "en"]), rng.choice([None, 3]),
             rng.choice([None, "", "a\nb", "é\n\n😀", "plain", f"own {rng.random()}\n"])) for _ in range(120)]
    rows += rows[:10] + [(7, "alone", "en", 1, "x\ny")] + [(None, None, None, None, None)] * 3
    assert got(in_use(made(spark, rows), "place", "members", "block").repartition(5), block_levels=levels) == brute(rows)


def test_small(spark):
    for rows in ([], [(1, "a", "en", 1, "x")], [(4, None, None, None, None), (2, None, "en", 1, "\n" * 50_000)], [(i, f"s{i}", "en", 1, "a\nb") for i in range(4)]):
        assert got(made(spark, rows)) == brute(rows)


def test_versions_share_all_but_the_path():
    nodes = [h(str(i)) for i in range(20)]
    tree = manifest.Tree(nodes, manifest.height(20))
    before = [list(level) for level in tree.levels]
    for i in range(20):
        copies = tree.copied(i, h("other"))
        whole = manifest.Tree([*nodes[:i], h("other"), *nodes[i + 1:]], manifest.height(20))
        differing = [(k, j) for k, level in enumerate(whole.levels) for j, x in enumerate(level) if x != before[k][j]]
        assert differing == [(k, i // 3 ** k) for k in range(len(before))] and copies == [whole.levels[k][j] for k, j in differing]
        assert manifest.folded(h("other"), tree.siblings(i)) == copies[-1]
    assert tree.levels == before


def test_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(30)) for _ in range(300)] + [("hot", 1)] * 200
    out = places.placed(spark.createDataFrame(rows, "g string, v int").repartition(7), ["g"], ["v"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.place, r.v) for r in out if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r.members for r in out if r.g == g} == {len(mine)}
    hot = places.placed(spark.createDataFrame(rows, "g string, v int").repartition(7), [], ["g", "v"])
    assert hot.agg(F.max("place"), F.countDistinct("place")).first() == (499, 500)
