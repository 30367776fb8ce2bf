import random
import re

from tallyframe.llm import private
from tests.llm.conftest import in_use

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), list(PLAIN).index(k), m.end()))
    return sorted(out)


def texts():
    rng = random.Random(8)
    bits = ["a@b.c", "_d@e-f.gh", "é", "1.2.3.4", ".5.6.7", "999.1.1.1", "0000255.00.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (456) 555-2186", "+49", " ", "-", ".", "@", "x",
            "😀", "12", "\n", "+12345678901234567", "(456) 555-2186", "37828224631 0005", "4111  1111", "%", "me at host dot com", "you [at] site.org"]
    out = [None, "", "no data", "9" * 20_000, "1.2.3." * 4000, "a" * 60_000 + "@", "a@" + "b." * 20_000 + "c", "1-" * 9000, "+1" + "-" * 30_000]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_base_matches_plain_patterns(spark, docs):
    made = texts()
    df = in_use(docs(made), "hit", "gap", "kind", "more", "features")
    rows = {r.doc_id: r for r in private.find(df).collect()}
    for i, t in enumerate(made):
        assert [tuple(s) for s in rows[i].base] == brute(t), t
        assert set(map(tuple, rows[i].base)) <= set(map(tuple, rows[i].spans))
        spans = [tuple(s) for s in rows[i].spans]
        added = sorted(set(spans) - set(map(tuple, rows[i].base)))
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in added for b in spans if a != b)


def test_trees_add_spelt_out_forms(spark, docs):
    rng = random.Random(9)
    made = []
    for _ in range(400):
        d = "".join(str(rng.randrange(10)) for _ in range(16))
        made += [f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now", f"number {d} here", f"version {rng.randint(1, 900)}.{rng.randint(1, 900)}.3.4 out", f"write ab{d[:3]}@host{d[0]}.com please", "+1 23 45"]
    made += ["phone (456) 555-2186 please", "plain words only"]
    rows = {r.doc_id: r for r in private.find(docs(made)).collect()}
    assert [tuple(s) for s in rows[len(made) - 2].spans] == [(6, 3, 20)]
    assert rows[len(made) - 1].spans == []


def test_rows(spark, docs):
    got = private.find(docs(["a@b.c", "a@b.c", None, "x"], [None, None, 1, 1])).select("doc_id", private.as_text("spans").alias("t"), private.count_of("base", "email").alias("n"))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "", 0), (1, "", 0), (None, "email:0:5", 1), (None, "email:0:5", 1)]
    assert private.find(docs([])).count() == 0


def test_trees_learn_from_every_match(spark, docs, monkeypatch):
    """Far more matches than any sample: the weights of the rows that fit the trees and give the threshold add up to all of them."""
    seen = []
    real = private.folded

    def counted(spans, *labels):
        rows = real(spans, *labels)
        seen.append((rows.agg({"weight": "sum"}).first()[0], spans.count()))
        return rows

    monkeypatch.setattr(private, "folded", counted)
    text = " ".join(f"write ab{i}@host.com or 1.{i % 400}.3.4" for i in range(4000))
    private.find(docs([text, "phone (456) 555-2186 please"])).count()
    assert [w for w, _ in seen] == [n for _, n in seen] and seen[0][0] >= 8000
