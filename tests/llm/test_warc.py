import gzip
import os
import random

from tallyframe.llm import warc
from tests.llm.conftest import in_use

PAGES = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_RECORDS", 7)
    monkeypatch.setattr(warc, "MERGE_LINES", 9)
    rng = random.Random(2)
    bodies = ["", "a", "é\r\n\r\nWARC/1.1\r\n", "same", "x" * 500_000]
    rows = [(i, rng.choice(["http://www.b.com/x", "https://a.org:8080/Y?q=1", "http://[bad", None, "http://b.com/x\r\ny"]), rng.choice([*bodies, f"own {i}", None])) for i in range(60)]
    folder = f"{tmp_path}/archives"
    got = warc.archive(in_use(spark.createDataFrame(rows, PAGES).repartition(5), "run", "leader", "sha1"), folder).collect()
    leader = {}
    for i, _, h in rows:
        leader[h or ""] = max(leader.get(h or "", -1), i)
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(by_id) == 60
    for i, _, h in rows:
        payload, top, r = (h or "").encode(), leader[h or ""], by_id[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), warc.digest_of(payload), "response" if top == i else "revisit", None if top == i else top)
        assert r.payload is None if top != i else bytes(r.payload) == payload
    keys = [(r.urlkey, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)
    records = sum(gzip.open(f"{folder}/{f}").read().count(b"WARC-Record-ID: ") for f in os.listdir(folder) if f.endswith(".gz"))
    assert records == 60 and len(os.listdir(folder)) >= 9


def test_ids_that_are_missing_or_repeat(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "b"), (None, "u", "b"), (2, "v", "c"), (2, "v", "c"), (1, "v", "c")]
    got = warc.archive(spark.createDataFrame(rows, PAGES), f"{tmp_path}/x").collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in got) == [
        (-1, "response", -1), (-1, "response", -1), (-1, "revisit", 1), (1, "response", -1), (1, "revisit", 2), (2, "response", -1), (2, "response", -1)]
    assert warc.archive(spark.createDataFrame([], PAGES), f"{tmp_path}/y").count() == 0
    small = warc.archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], PAGES), f"{tmp_path}/z", least_bytes=3).collect()
    assert {r.record_type for r in small} == {"response"}


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_base32():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
