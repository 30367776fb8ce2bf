import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import packing
from tallyframe.llm.tokens import default_vocabulary, encoder
from tests.llm.conftest import in_use

PIECES = ["the ", "'s", "é", " ", "\x1c", "\x85", " ", "  ", "\n\n", "\t", "12", "½", "漢字", "<|endoftext|>", "<|", "á", "😀", "\r\n", "x" * 40, "!?", "_", "​"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=6)), max_size=20))
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    library = Tokenizer.from_file(default_vocabulary())
    assert encoder(default_vocabulary())(text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs_of_white_space():
    text = "a" + " " * 200_000 + "b"
    assert encoder(default_vocabulary())(text) == Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids


def check_pieces(rows, ids_of, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            own = np.array(ids_of[doc][r.start:r.start + r.length], "<u4")
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids_of[doc]) and r.ids_crc32 == zlib.crc32(own.tobytes())
            assert "ids" not in r or list(r.ids) == own.tolist()
            at += r.length
        assert at == len(ids_of[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0


def test_every_id_once(spark, docs):
    rng = random.Random(3)
    texts = [None, "", "a", "long " * 9000] + [" ".join(rng.choice(["red", "blue", "green", "sea", "sky", "tree"]) for _ in range(rng.randint(1, 400))) for _ in range(80)]
    encode = encoder(default_vocabulary())
    df = in_use(docs(texts), "ids", "width", "offset")
    rows = packing.pack(df.repartition(3), shard_docs=16, with_ids=True).collect()
    check_pieces(rows, {i: [*encode(t or ""), 1] for i, t in enumerate(texts)}, 2048)
    assert packing.pack(df.limit(0)).count() == 0
    same = packing.pack(docs(["x", "x", None], [None, None, None])).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in same) == [(None, 1), (None, 2), (None, 2)]


def test_scores_match_the_formula():
    rng = random.Random(1)
    docs = [np.array([rng.randrange(12) for _ in range(rng.randint(3, 30))], "<u2") for _ in range(20)]
    df = np.bincount([t for d in docs for t in set(d.tolist())], minlength=12)
    idf = np.array([max(0.0, math.log((40 - n + 0.5) / (n + 0.5))) for n in df])
    mean, index = 15.0, packing.Index(docs, idf, 15.0, 1.2, 0.75)
    for seed in range(20):
        got = index.scores(seed)
        for other in range(20):
            want = 0
            for t in set(docs[seed].tolist()):
                tf = int((docs[other] == t).sum())
                want += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[other]) / mean)) if tf else 0
            assert got[other] == pytest.approx(want)


def test_neighbours_share_a_window():
    """Documents on two themes, mixed: a window holds its seed's theme while any is left."""
    rng = random.Random(2)
    docs = [np.array([rng.randrange(50) + (i % 2) * 100 for _ in range(100)], "<u2") for i in range(40)]
    df = np.bincount([t for d in docs for t in set(d.tolist())], minlength=200)
    idf = np.log((200 - df + 0.5) / (df + 0.5))
    mixed = sum(len({doc % 2 for doc, _, _ in pieces}) > 1 for pieces in packing.filled(docs, packing.Index(docs, idf, 100.0, 1.2, 0.75), 250))
    assert mixed <= 2
