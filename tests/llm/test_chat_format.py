import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import SF
from pyspark.sql import functions as F

from lantern.llm import chat_format as C
from lantern.llm.queries import MARKED, op9_chat_format

TEXT = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "s>", "/", "]", "a", "\n", "INST]", "SYS>>", " ", "é", "🙂"]), max_size=9).map("".join)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXT)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=6))
def test_any_conversation_parses_to_its_source(turns):
    segments = []
    for role, text in turns:
        segment, a, b, _ = C.round_trip(role, text)
        assert C.parse(segment) == [(role, text)] and C.unescape(segment[a:b]) == text
        segments.append(segment)
    assert C.parse("".join(segments)) == turns


def test_plain_text_is_not_escaped():
    assert C.round_trip("user", "5 < 6 [sic]") == ("[INST]5 < 6 [sic][/INST]", 6, 17, 0)
    assert C.round_trip("user", "a\\b")[3] == 1 and C.round_trip("assistant", "</s>")[0] == "<s>\\</s></s>"


@pytest.mark.parametrize("bad", ["x", "[INST]a", "[INST]a</s>", "[INST]a[/INST]b", "[ROLE=user]a[/ROLE]", "[ROLE=x", "[INST]a\\"])
def test_what_is_not_in_the_grammar_is_an_error(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def plain(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_query_against_plain_statement(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = defaultdict(list)
    for conv, _, role, text in sorted([*rows, *MARKED]):
        by[conv].append((role, text or ""))
    got = {r.conv_id: r for r in op9_chat_format(spark, SF).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: plain(v) for k, v in by.items()}
    assert got[-1].formatted_chars == len("".join(C.round_trip(r, t)[0] for _, _, r, t in MARKED))


def test_awkward_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (None, 0, "user", "x"), (2, None, "user", "b"), (2, None, "user", "a"),
            (2, 3, "assistant", "y" * 300_000), (2, 3, "assistant", "y" * 300_000), (None, 1, "odd]role", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).repartition(3)
    turns = C.format_turns(df)
    assert turns.columns == ["conv_id", "turn", "role", "text", "segment", "text_begin", "text_end", "escape_level", "in_loss"]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(turns).collect()}
    long = ("assistant", "y" * 300_000)
    assert got == {1: plain([("", "hi"), ("assistant", "")]), None: plain([("user", "x"), ("odd]role", "")]),
                   2: plain([("user", "a"), ("user", "b"), long, long])}
    assert C.digests(C.format_turns(df.limit(0))).count() == 0
