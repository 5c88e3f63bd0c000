import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import chat
from hopweave.llm.queries import BYTE_BPE
from hopweave.llm.tokenfile import encoder

ROWS = [
    (1, 0, "system", "be <s> good\\"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "</s>ok"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 5, None, "null role"), (2, 1, "tool[TEXT]", "\\<\\s>"), (None, 0, "assistant", "\U0001f600 é"), (3, 0, "user", "word " * 20000), (3, 0, "user", "word " * 20000),
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.MARKS, "\\", "a", "<", "[", " "]), max_size=8))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(m in out for m in chat.MARKS)


def test_mask_covers_the_text():
    seg = np.array([5, 6, 7], np.int32)
    ids, mask = chat.assemble("assistant", [seg], True)
    assert ids[mask].tolist() == [5, 6, 7] and ids[0] == chat.VOCAB
    for role, parts in (("user", [seg]), ("system", [seg, seg])):
        assert not chat.assemble(role, parts, False)[1].any()


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 9) for r in ROWS], "conv_id long, turn long, role string, text string, ids int")
    formatted = chat.format_turns(df, BYTE_BPE)
    got = {r.conv_id: r for r in chat.digests(formatted, BYTE_BPE).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted(((t, role or "", text or "") for c, t, role, text in ROWS if c == conv), key=lambda x: x)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        said = "".join(b for _, a, b in turns if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    shown = "<s>[ROLE]system[TEXT]be <\\s> good\\\\[END][INST]hi [\\INST][/INST][SAY]<\\/s>ok</s>[INST][/INST][SAY]</s>"
    assert got[1].formatted_chars == len(shown)
    assert chat.digests(chat.format_turns(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0
    # the reader shows what the template says
    reader, e = chat.Reader(BYTE_BPE), encoder(BYTE_BPE)
    seg = np.frombuffer(e.encode(chat.escape("hi [INST]")), "<u4").astype(np.int32)
    assert reader.parse(chat.assemble("user", [seg], False)[0]) == ("user", "hi [INST]", "[INST]hi [\\INST][/INST]")
