from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from confuscope.llm import chat_masks as c
from confuscope.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = ["\\", "###", "#", "</turn>", "\n", ":", " ok", "### Assistant:\n", "\n</turn>\n", "é", "\U0001f600", "東京", "<|endoftext|>", "a"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_reversible(turns):
    r = c.render(turns)
    assert c.parse(r.text) == turns
    for (s, e, _), (_, text) in zip(r.spans, turns, strict=True):
        assert c.unescape(r.text[s:e]) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), max_size=5))
def test_mask_holds_just_the_assistant(turns):
    r = c.render(turns)
    e = c._tokenizer(PATH).encode(r.text, add_special_tokens=False)
    mask, loss = c.mask_tokens(e.offsets, r.spans)
    assert "".join(c.unescape(r.text[a:b]) for a, b in loss) == "".join(t for who, t in turns if who == "assistant")
    for m, (a, b) in zip(mask, e.offsets, strict=True):
        assert m == any(trained and a < hi and lo < b for lo, hi, trained in r.spans)


def test_table(spark):
    rows = [(1, 1, "assistant", "yes ### x"), (1, 0, "user", "q </turn>"), (2, 0, None, None), (None, 3, "user", "n"), (None, 3, "user", "two"), (3, 0, "assistant", ""),
            (3, 0, "assistant", ""), (4, None, "user", "late"), (4, 0, "assistant", "w " * 30_000), (5, 0, "user", "tie b"), (5, 0, "user", "tie a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, mask int")
    made = c.format_conversations(df, PATH)
    rows = c.digest(made).collect()
    assert sorted((r["n_turns"], r["formatted_chars"]) for r in rows if r["conv_id"] is None) == [(1, 20), (1, 22)]
    got = {r["conv_id"]: r for r in rows}
    assert len(rows) == 7 and set(got) == {1, 2, None, 3, 4, 5}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, 9)
    assert got[1]["turns_sha256"] == sha256(b"user\nq </turn>\nassistant\nyes ### x\n").hexdigest()
    assert got[1]["loss_sha256"] == sha256(b"yes ### x").hexdigest()
    assert got[2]["turns_sha256"] == sha256(b"\n\n").hexdigest() and got[2]["loss_chars"] == 0
    assert got[3]["n_turns"] == 2 and got[4]["loss_chars"] == 60_000
    assert got[5]["turns_sha256"] == sha256(b"user\ntie a\nuser\ntie b\n").hexdigest()
    for r in made.collect():
        assert len(r["ids"]) == len(r["mask"]) and len(r["turn_spans"]) == r["n_turns"]
    assert c.format_conversations(df.where("1 = 0"), PATH).count() == 0


def test_ranges():
    spans = [(2, 6, True), (6, 6, True), (8, 10, False), (10, 14, True)]
    assert c.mask_tokens([], spans) == ([], [])
    assert c.mask_tokens([(0, 1), (1, 3), (3, 4), (5, 9), (9, 11), (12, 14)], spans) == ([0, 1, 1, 1, 1, 1], [(2, 4), (5, 6), (10, 11), (12, 14)])
    assert c.mask_tokens([(0, 3), (2, 3), (2, 3), (3, 20)], spans) == ([1, 1, 1, 1], [(2, 6), (10, 14)])


def test_not_a_conversation():
    with pytest.raises(ValueError):
        c.parse("### user\nno end")
