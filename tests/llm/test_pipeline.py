import random

import corpus_pipeline
from tallyframe.llm import quality
from tallyframe.llm.tokens import default_vocabulary, encoder
from tests.llm import test_decontaminate, test_lines, test_packing, test_similar
from tests.llm.conftest import DOCS


def corpus():
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared, bench = [sentence(25) for _ in range(3)], sentence(30)
    texts = [None, "", "too short"]
    for _ in range(60):
        lines = [sentence(rng.randint(3, 30)) for _ in range(rng.randint(2, 7))]
        if rng.random() < 0.4:
            lines.insert(1, rng.choice(shared))
        if rng.random() < 0.15:
            lines.append("start " + bench[20:150] + " end")
        if rng.random() < 0.1:
            lines.append(" ".join(["again and again we say the same"] * 9))
        texts.append("\n".join(lines))
        if rng.random() < 0.3:
            texts.append(" ".join(lines) + " tail")
        if rng.random() < 0.2:
            texts.append("\n".join(lines))
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], [(1, bench), (2, sentence(4))]


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = list(now.items())
        if name == "quality_rules":
            want = {i: t for i, t in before if quality.measured([t], 8, 20, 30, 0.3, 200)[0][-1]}
        elif name == "line_dedup":
            want = {i: t for i, t in test_lines.brute(before, 2, 20) if (t or "").split()}
        elif name == "near_duplicates":
            want = {i: now[i] for i, _, c in test_similar.brute(before, 5, 80) if c == i}
        else:
            hits = test_decontaminate.brute([t for _, t in before], items)
            want = {i: t for (i, t), h in zip(before, hits) if not h[1]}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r.text for r in docs.collect()}
        assert now == want and all(r.n_chars == len(r.text) for r in docs.collect())
        seen.append(len(now))
    assert seen == sorted(seen, reverse=True) and len(set(seen)) == 4
    encode = encoder(default_vocabulary())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    test_packing.check_pieces(pieces, {i: [*encode(t), 1] for i, t in now.items()}, 2048)


def test_one_of_each(spark, docs):
    from tallyframe.llm import similar
    same = "a b c d e f g h"
    df = docs([same, same, same, None, None, "other words here", same.upper()], [4, 4, None, 9, 9, 3, 2])
    kept = similar.one_of_each(df.withColumn("component", df.lang).withColumn("key_a", df.lang))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(2, same.upper()), (3, "other words here")]
    assert kept.where("text IS NULL").count() == 2


def test_stages_take_nulls_long_texts_and_clashing_columns(spark, tmp_path):
    from tests.llm.conftest import in_use
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, None), (None, ""), (1, None), (1, "a"), (2, long), (2, long), (None, long), (3, "x " * 300), (4, " ".join(f"v{i}" for i in range(40)))]
    spark.createDataFrame([(None, "w1 w2 w3"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = in_use(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS), "component", "number", "alone", "w", "n", "hash", "c0", "gone")
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name == "retrieval_packing":
                pieces = out.collect()
                assert {r.doc_id for r in pieces} == ({4} if table is df else set()) and sum(r.length for r in pieces) == max([0, *(r.doc_tokens for r in pieces)])
            else:
                assert out.columns == docs.columns, name
                docs = spark.createDataFrame(out.collect(), out.schema)
        assert [r.doc_id for r in docs.collect()] == ([4] if table is df else [])
