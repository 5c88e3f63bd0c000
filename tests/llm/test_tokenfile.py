import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import tokenfile
from hopweave.llm.queries import BYTE_BPE


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


def direct(texts):
    t = library()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab Zé.,'\n\t \x1c1!ß<|endoftext|>", max_size=40))
def test_encoder_equals_library(text):
    got = np.frombuffer(tokenfile.encoder(BYTE_BPE).encode(text), "<u4").tolist()
    assert got == direct([text])[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab9é×½ \n.'\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b“、中", max_size=12), max_size=8))
def test_encoder_cuts_no_word(texts):
    """Wide white space, borders of texts, nulls, and a slice of a longer array."""
    column = pa.array(["x y", *texts, "z"], pa.string()).slice(1, len(texts))
    got = tokenfile.encoder(BYTE_BPE).encode_many(column)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == direct([t or "" for t in texts])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_pack_round_trip(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], np.uint32)
    raw = tokenfile.pack(ids, bits)
    assert len(raw) == (len(ids) * bits + 7) // 8
    assert (tokenfile.unpack(raw, bits, 0, len(ids)) == ids).all()
    for lo in range(0, len(ids), 7):
        assert (tokenfile.unpack(raw, bits, lo, min(lo + 5, len(ids))) == ids[lo : lo + 5]).all()


def test_pack_refuses_large_ids():
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([8]), 3)


def test_documents(spark):
    rows = [(3, "some text, and more", "x"), (1, None, "x"), (2, "", None), (None, "no id", "y"), (3, "some text, and more", "x"), (9, "  odd \n spaces ", None), (5, "long " * 30000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = tokenfile.encode_documents(df, BYTE_BPE).toPandas().sort_values("start")
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for (_, row), want in zip(got.iterrows(), order, strict=True):
        ids = [*direct([want[1] or ""])[0], 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not tokenfile.encode_documents(df.limit(0), BYTE_BPE).count()


def test_vocabulary_bits():
    assert tokenfile.bits_for(len(json.load(open(BYTE_BPE))["model"]["vocab"])) == 16
