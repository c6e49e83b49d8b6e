import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm import chat_format as cf

TRICKY = st.lists(st.sampled_from([*cf.CONTROLS, "\\", " ", "a", "\n", "é", "<", "s>", "[/", "INST]"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]"]), TRICKY), max_size=5))
def test_rendered_turns_parse_back(turns):
    pieces = [cf.render(r, t) for r, t in turns]
    found = list(cf.parse("".join(p[0] for p in pieces)))
    assert [x[:2] for x in found] == turns
    assert all(cf.unescape(out[start:end]) == t for (out, start, end), (_, t) in zip(pieces, turns))


@given(TRICKY)
def test_escaping_is_reversible(text):
    assert cf.unescape(cf.escape(text)) == text


@pytest.mark.parametrize("bad", ["x", "[INST] a", "[INST]a [/INST]", "[INST] a [/SYS]", "[INST] [OUT] a </s> [/INST]", "[ROLE] r [/ROLE]"])
def test_other_text_is_no_sentence(bad):
    with pytest.raises(cf.GrammarError):
        list(cf.parse(bad))


def test_conversations_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] x"), (1, 1, "assistant", "</s>[INST] x"), (1, None, "system", None), (2, 5, None, "é" * 9000), (2, 6, "assistant", ""), (None, 0, "tool", "\\[OUT]"), (None, 1, "assistant", "ö\\</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as formatted")
    got = {r["conv_id"]: r for r in cf.read_back(cf.format_turns(frame)).collect()}
    streamed = {r["conv_id"]: r for r in cf.read_back(cf.format_turns(frame), ordered=True).collect()}
    assert got == streamed and set(got) == {1, 2, None}
    for conv in got:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    pieces = [r for r in cf.format_turns(frame).collect() if r["conv_id"] == 1]
    whole = "".join(r["formatted"] for r in sorted(pieces, key=lambda r: r["position"]))
    assert len(whole) == got[1]["formatted_chars"] and [t[0] for t in cf.parse(whole, len(cf.BEGIN))] == ["system", "user", "assistant", "assistant"]
    assert cf.read_back(cf.format_turns(frame.limit(0))).count() == 0
