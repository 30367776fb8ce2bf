import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import language
from tests.llm.conftest import DOCS, in_use

SYLLABLES = {
    "en": "the th ing and er tion is wh ly".split(), "de": "der sch ung ein ch keit ü ß zu".split(), "nl": "het ij oo aa een sch van ge tje".split(), "fr": "eau que é ou le ment è aux".split()}


def said(lang, rng, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, lang, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(600)]
    return [(i, lang, said(lang, rng, rng.randint(2, 60)).capitalize() + ".") for i, lang in enumerate(langs)]


def test_held_out_accuracy_and_cases(spark, rows):
    odd = [(1000, "en", None), (1001, "en", ""), (1002, "de", "12 34 !! ☃"), (None, "en", "the thing and theer"), (1003, None, "der schung ein"), (1004, "fr", said("fr", random.Random(1), 50_000)), (1005, "fr", "EAUQUE ÉMENT LEAUX È"),
           (1006, "en", "²³ Ⅷ _"), (7, "en", "same the and"), (7, "en", "same the and")]
    got = language.identify(in_use(made(spark, rows + odd), "label", "class", "features", "pick", "held_out", "score").repartition(4)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id)
    assert len(got) == len(rows) + len(odd)
    right = [by[i][0].lang_pred == lang for i, lang, _ in rows if held(i) and i != 7]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (1000, 1001, 1002, 1006))
    assert [by[i][0].lang_pred for i in (None, 1003, 1004, 1005)] == ["en", "de", "fr", "fr"]
    assert by[7][1:] and len({(r.lang_pred, r.score) for r in by[7] if r.lang_pred == "en"}) >= 1


def test_labels_of_held_out_documents_teach_nothing(spark, rows):
    """Their labels may be anything, and a language only they have is never predicted."""
    some = rows[:250]
    other = [(i, "en" if held(i) else lang, t) for i, lang, t in some] + [(i, "zz", "zz yy") for i in range(5000, 5030) if held(i)]
    before, after = ({r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.identify(made(spark, x)).collect()} for x in (some, other))
    assert {i: after[i] for i in before} == before and "zz" not in {lang for lang, _ in after.values()}


def test_nothing_to_learn(spark, rows):
    unlabelled = [(i, None, t) for i, _, t in rows[:5]]
    assert {(r.lang_pred, r.score) for r in language.identify(made(spark, unlabelled)).collect()} == {("und", 0.0)}
    assert language.identify(made(spark, [])).count() == 0
    one = [(i, "en", t) for i, lang, t in rows if lang == "en"][:40]
    assert {r.lang_pred for r in language.identify(made(spark, one)).collect()} == {"en"}


def test_sample_is_bounded(spark, rows):
    docs = made(spark, rows + [(9, "en", "the very same")] * 200)
    sizes = {r.lang: r["count"] for r in language.sampled(docs.select("doc_id", "lang", "text"), 20).groupBy("lang").count().collect()}
    assert set(sizes) == set(SYLLABLES) and max(sizes.values()) <= 20 and min(sizes.values()) >= 10


def test_votes():
    """Most duels won; of three that beat each other in turn the one with the highest probabilities; families of their own."""
    def duel(a, b, margin):
        return language.Duel(a, b, np.zeros(2, np.float32), margin, 1.0, 0.0)
    x = np.zeros((1, 2), np.float32)
    best, chance = language._decided(x, ["a", "b", "c"], [duel("a", "b", -1), duel("a", "c", 9), duel("b", "c", 1)])
    assert best.tolist() == [1] and abs(chance[0] - 1 / (1 + np.exp(-1))) < 1e-6
    assert language._decided(x, ["a", "b", "c"], [duel("a", "b", 1), duel("a", "c", -2), duel("b", "c", 3)])[0].tolist() == [1]
    assert language._decided(x, ["a"], [])[0].tolist() == [0]
    assert [language.family_of(c) for c in ("en-US", "pt_BR", "fr", "xx")] == ["germanic", "romance", "romance", "own:xx"]


def test_profile_is_of_the_whole_text():
    """Counts of all byte grams, one by one."""
    text = "Aß b-c  d" * 30 + "é"
    raw = b" " + b" ".join("".join(c if c.islower() or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
    want = np.zeros(language.BUCKETS)
    for size, odd in ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D)):
        for i in range(len(raw) - size + 1):
            want[(int.from_bytes(raw[i:i + size], "big") * odd % 2**32) >> 21] += 1
    assert np.allclose(language.profiles([text, None, ""])[0], np.sqrt(want) / np.sqrt(want.sum()), atol=1e-6)
    assert not language.profiles([None, ""]).any()
