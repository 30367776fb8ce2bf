import hashlib

from tallyframe.llm import chat
from tests.llm.conftest import in_use

ROWS = [
    (1, 0, "user", "a </s> b"), (1, 1, "assistant", "x<part>y [INST]\\[/INST]"), (1, 2, "assistant", "</s>"), (1, 3, "user", None),
    (2, None, "assistant", "only"), (2, None, "assistant", "only"), (3, 5, None, "<\\/s> <\\\\part> [\\/INST] </s></s>"), (3, 4, "<s>[INST]", ""),
    (None, 1, "assistant", "é" * 200_000), (None, 0, "system", "x\n\ny"), (4, 1, "user", "tie b"), (4, 1, "user", "tie a")]


def test_round_trip(spark):
    df = in_use(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"), "formatted", "loss_runs", "turns")
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(made).collect()}
    want = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for r, t in turns if r == "assistant")
    text = got[1].formatted
    assert text.startswith("<s>[INST]user[/INST]a <\\/s> b</s><s>[INST]assistant[/INST]") and text.count("<part>") == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    from tallyframe.llm.queries import QUOTED, op8_relational_chats
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: r for r in op8_relational_chats(spark, str(tmp_path)).collect()}
    assert rows[-1].loss_sha256 == hashlib.sha256(QUOTED.encode()).hexdigest() and rows[-1].n_turns == 2
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{QUOTED}\nassistant\n{QUOTED}\n".encode()).hexdigest()
