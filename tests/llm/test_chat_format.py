import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.chat_format import Template, format_segments, join_segments
from tallyframe.llm.queries import read_back

T = Template()
PIECES = ["\\", "#", "##", "### ", "### User: ", "</turn>", " </turn>\n", "<", " ", "a", "\n", ":"]
NASTY = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a:b\\c", "=x"]), NASTY), max_size=5))
def test_round_trip(turns):
    formatted = "".join(T.heading(role) + T.escape(text) + T.end for role, text in turns)
    assert T.read_turns(formatted) == turns
    for _, text in turns:
        escaped = T.escape(text)
        assert T.unescape(escaped) == text
        assert " </turn>\n" not in escaped.replace("\\</turn>", "")


@pytest.mark.parametrize("bad", [{"mark": "##"}, {"end": "  "}, {"names": {"user": "a:b"}}, {"end": "\\e"}])
def test_templates_that_cannot_be_read_back(bad):
    with pytest.raises(ValueError):
        Template(**bad)


ROWS = [
    (1, 0, "system", "be\nbrief"), (1, 1, "user", "hi </turn>"), (1, 2, "assistant", "ho"),
    (2, 0, "assistant", "first"), (2, 1, "assistant", None),
    (3, 1, "user", "b"), (3, 1, "user", "a"), (3, None, "assistant", "null turn"),
    (4, 0, None, None), (4, 0, None, None),
    (None, 0, "user", "x"), (None, 1, "assistant", "y" * 100000),
    (5, 0, "robot", "?"), (5, 1, "user", "q"),
]
ORDER = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")


def test_digests_and_errors(spark):
    said = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in read_back(format_segments(said.repartition(4)), T).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        turns = sorted((x for x in ROWS if x[0] == conv), key=ORDER)
        assert r.n_turns == len(turns)
        want = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in turns)
        assert r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        learned = "".join(text or "" for _, _, role, text in turns if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    errors = {r.conv_id: r.errors for r in join_segments(format_segments(said)).collect()}
    assert errors[1] == [] and errors[None] == []
    assert errors[2] == ["assistant after start", "assistant after answered"]
    assert errors[3] == ["assistant after start", "user after asked", "incomplete"]
    assert errors[4] == ["no role after start", "no role after start", "incomplete"]
    assert errors[5] == ["robot after start", "incomplete"]


def test_joined_text(spark):
    said = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    row = join_segments(format_segments(said)).first()
    assert row.formatted == "### System: be\nbrief </turn>\n### User: hi \\</turn> </turn>\n### Assistant: ho </turn>\n"
    assert [row.formatted[s["from"] : s["upto"]] for s in row.loss_spans] == ["ho"]
