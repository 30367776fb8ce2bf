"""Chat transcripts: turns sorted, joined into one training text with a loss mask, and read back, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. Texts never hold one of them unescaped.
OPEN, HEAD_END, PART, CLOSE = "<s>[INST]", "[/INST]", "<part>", "</s>"
_CONTROL = r"(<(?=\\*(?:/?s>|part>))|\[(?=\\*/?INST\]))"
_ESCAPED = r"(<|\[)\\(?=\\*(?:/?s>|part>|/?INST\]))"


def escaped(text: Column) -> Column:
    """Control strings get a backslash behind their bracket; so do those that have backslashes there already, hence it is reversible."""
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs.

    A block is `<s>[INST]role[/INST]text</s>`; texts of adjacent turns of one role share a block, parted by `<part>`.
    loss_runs has a run for each turn, in the order of the pieces between `<part>` and `</s>`: `skip` characters of marks,
    then `take` characters of text that count for the loss (0 if the role isn't `learn`).

    Turns sort by turn (null first), then role and text, so equal turn numbers and repeated rows have a fixed order and all stay.
    A null role or text is empty. Rows with a null conv_id make one conversation. A conversation becomes one text, so its turns
    meet in one row; nothing larger does. Other columns are not read.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def starts(t: Column, i: Column) -> Column:
        return (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])

    def piece(t: Column, i: Column) -> Column:
        mark = F.when(starts(t, i), F.concat(F.when(i == 0, "").otherwise(CLOSE), F.lit(OPEN), escaped(t["role"]), F.lit(HEAD_END))).otherwise(PART)
        return F.concat(mark, escaped(t["text"]))

    def run(t: Column, i: Column) -> Column:
        skip = F.when(starts(t, i), F.char_length(escaped(t["role"])) + len(OPEN) + len(HEAD_END)).otherwise(0)
        return F.struct(skip.alias("skip"), F.when(t["role"] == learn, F.char_length(escaped(t["text"]))).otherwise(0).alias("take"))

    return sorted_turns.select(
        "conv_id", F.concat(F.array_join(F.transform("turns", piece), ""), F.lit(CLOSE)).alias("formatted"), F.transform("turns", run).alias("loss_runs"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text) and loss_text, from the formatted text and its loss runs alone."""
    def block(b: Column) -> Column:
        halves = F.split(b, r"\[/INST\]", 2)
        role = unescaped(F.substring(halves[0], len(OPEN) + 1, 2**31 - 1))
        return F.transform(F.split(halves[1], PART, -1), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")
    pieces = F.split("formatted", f"{PART}|{CLOSE}", -1)
    learnt = F.zip_with(pieces, "loss_runs", lambda p, r: F.when(r["take"] > 0, F.substring(p, r["skip"] + 1, r["take"])))
    return chats.select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), F.array_join(F.transform(F.array_compact(learnt), unescaped), "").alias("loss_text"))
