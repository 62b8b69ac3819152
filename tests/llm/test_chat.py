import random

import duckdb
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sigloom.llm import chat

BITS = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "\n", "\\", "<\\|im_end|>", "<\\\\|im_start|>", "\\n", "user", "a", "<", "|>", "é"]), max_size=8).map("".join)


@given(st.lists(st.tuples(BITS, BITS), max_size=5))
def test_round_trip(turns):
    text, _, rounds = chat.format_turns(turns)
    assert chat.parse(text) == turns and rounds <= 2


def test_plain_content_stays_as_it_is():
    assert chat.format_turns([("user", "hi"), ("assistant", "<b>")]) == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<b><|im_end|>\n", 0, 0)


def test_parser_refuses_what_is_not_in_the_grammar():
    for text in ("x", "<|im_start|>user", "<|im_start|>user\nno end", "<|im_start|>a\nb<|im_end|>\nrest"):
        assert chat.parse(text) is None


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_sql(spark, seed):
    r = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "\\", "<\\|im_end|>", "a", "b ", None]
    text = lambda: None if r.random() < 0.1 else "".join(r.choice(bits[:-1]) for _ in range(r.randint(0, 5)))
    rows = [(r.choice([0, 1, 2, 3, None]), r.choice([0, 1, 1, 2, None]), r.choice(["user", "a\nb", "c\\", None, "<|im_end|>"]), text(), "x") for _ in range(60)]
    rows += [rows[0], rows[0], (9, 0, "user", "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    got = sorted(map(tuple, chat.format_chats(df).collect()), key=str)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "chat"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(chat.ORACLE_SQL).fetchall()
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
