import hashlib

import pytest
from pyspark.sql import functions as F

from rillgrid.llm import chat

HARD = [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", "[\\INST] <\\s> <\\\\/s>", "<<SYS>> <\\<SYS>> <</SYS>>", "", "a\\b", "[INST[INST]]",
    "<s<s>>", "日本 <|im_end|>", "\n\n", "$1 \\1 \\", "<\\|im_end|>", None,
]


def test_round_trip_of_control_strings(spark):
    rows = [(c, t, ["user", "assistant", "a%b\n<s>[x]", None][(c + t) % 4], HARD[(c * 5 + t) % len(HARD)], "extra") for c in range(20) for t in range(c % 7 + 1)]
    rows += [(None, None, "assistant", "null ids", "e"), (None, 1, "assistant", None, "e"), (3, 0, "user", "tie", "e"), (3, 0, "user", "tie", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    back = made.select("*", chat.joined(chat.parse(F.col("formatted"))).alias("joined"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in back.collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert got[c]["identical"] is True
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["joined"] == "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert got[c]["loss"] == "".join(x for _, _, r, x in turns if r == "assistant")
        for body in got[c]["formatted"].split(chat.START)[1:]:
            inner = body.split("\n", 1)[1][: -len(chat.END) - 1]
            assert not any(x in inner for x in chat.RESERVED)


def test_nothing_to_format(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("text", [h for h in HARD if h])
def test_escape_is_undone(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.unescape(chat.escape(F.col("t"))).alias("t")).first()
    assert hashlib.sha256(row["t"].encode()).digest() == hashlib.sha256(text.encode()).digest()
