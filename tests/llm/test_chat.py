import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rulewright.llm import chat

PARTS = st.lists(st.sampled_from([*chat.CONTROLS, "<", "\\", "|im_end|>", "<\\s>", "[\\INST]", "\n", "é", "x", "[", "/", "user"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(PARTS, PARTS)
def test_any_turn_comes_back(role, text):
    segment = chat.render_turn(role, text)
    assert chat.parse_turn(segment)[:2] == (role, text)
    assert segment.count(chat.OPEN) == segment.count(chat.CLOSE) == 1
    assert chat.unescape(chat.escape(text)) == text


def test_conversations(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[INST] x <|im_end|>"), (1, 2, None, None), (2, 0, "assistant", "a"), (2, 1, "assistant", "é\nb"), (None, 0, "user", "n"), (3, 1, "user", "t"), (3, 1, "user", "t")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.render(df.limit(0))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), PARTS), max_size=6), st.integers(1, 9))
def test_a_conversation_is_read_from_its_text_alone(turns, step):
    whole = "".join(chat.render_turn(*t) for t in turns)
    reader = chat.Reader()
    got = [x for i in range(0, len(whole), step) for x in reader.turns(whole[i : i + step])]
    assert [x[:2] for x in got] == turns and reader.close() == len(whole)
    assert [chat.unescape(whole[a:b]) for _, _, a, b, _ in got] == [t if r == "assistant" else "" for r, t in turns]
    assert all(whole[a:b] == under for _, _, a, b, under in got)
