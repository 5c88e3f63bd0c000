import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import pieces
from hopweave.llm.queries import PIECES


@pytest.fixture(scope="module")
def solver():
    return pieces.Solver(pieces.Vocabulary(PIECES))


def brute(vocab, text):
    """Scores of all segmentations of a short text, best first."""
    s = pieces.MARK + text.replace(pieces.MARK, pieces.LITERAL).replace(" ", pieces.MARK)
    done = {len(s): [0.0]}
    for a in range(len(s) - 1, -1, -1):
        done[a] = []
        for b in range(a + 1, len(s) + 1):
            i = vocab.ids.get(s[a:b])
            if i is not None or b == a + 1:
                w = vocab.scores[i] if i is not None else vocab.unknown
                done[a] += [w + x for x in done[b]]
    return sorted(done[0], reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thean in.,ß\n▁é", min_size=1, max_size=11))
def test_n_best_equals_all_segmentations(solver, text):
    ids, scores = solver.solve([text], 4)[0]
    want = brute(solver.v, text)[:4]
    assert np.allclose(scores, want)
    assert pieces.decode(solver.v, np.frombuffer(ids, "<u4")) == text
    got = sum(solver.v.scores[i] for i in np.frombuffer(ids, "<u4"))
    if not any(i in solver.v.bytes_id.values() for i in np.frombuffer(ids, "<u4")):
        assert np.isclose(got, want[0])


def test_a_star_agrees_with_linear(solver):
    for text in ("▁onethousand", "▁" + "thing" * 20, "abc\ndef"):
        a, b = pieces.a_star(solver.v, [text], 2), solver._linear(text)
        assert np.allclose([x[0] for x in a], [x[0] for x in b])


def test_frame(spark):
    texts = ["Hello  world, again.", None, "", "x" * 5000, "日本語 text " * 4000, "\U0001f600 ▁ \x00 tab\t", "Hello  world, again."]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = pieces.digests(pieces.encode(df.select('doc_id', 'text'), PIECES, 3), PIECES).toPandas().set_index("doc_id").sort_index()
    assert got.round_trip.all() and len(got) == len(texts)
    assert got.n_pieces[1] == got.n_pieces[2] == 0 and np.isnan(got.best_score[1])
    assert got.ids_crc32[0] == got.ids_crc32[6]
    assert all(list(x) == sorted(x, reverse=True) for x in got.n_best)
    assert not pieces.encode(df.limit(0), PIECES).count()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="thean in.,ß\n▁é", min_size=1, max_size=11))
def test_all_n_segmentations_have_their_ids(solver, text):
    found, scores = solver.solve_all([text], 4)[0]
    assert len(set(found)) == len(found) == len(scores) == min(4, len(brute(solver.v, text)))
    assert found[0] == solver.solve([text], 4)[0][0]
    for raw, score in zip(found, scores, strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert pieces.decode(solver.v, ids) == text
        if not any(i in solver.v.bytes_id.values() for i in ids):
            assert np.isclose(sum(solver.v.scores[i] for i in ids), score)


def test_frame_has_the_alternatives(spark):
    texts = ["Hello  world, again.", None, "", "thing " * 3000, "\U0001f600 ▁ tab\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encode(df, PIECES, 4)
    v = pieces.Vocabulary(PIECES)
    for r in rows.collect():
        assert len(r.alternatives) == max(0, len(r.n_best) - 1)
        assert all(pieces.decode(v, np.array(x)) == (r.text or "") and x != r.ids for x in r.alternatives)
    assert all(r.round_trip and len(r.other_crc32) == len(set(r.other_crc32)) == len(r.other_pieces) == max(0, len(r.n_best) - 1) for r in pieces.digests(rows, PIECES).collect())


def test_ties_are_settled_alike_at_every_length(solver, monkeypatch):
    """Segments of equal letters have many segmentations of one score; 48 and 49 characters go the same way."""
    words = ["▁" + "a" * 47, "▁" + "a" * 48, "▁" + "abab" * 11 + "aba", "▁" + "abab" * 12, "▁" + "xyzzy" * 8, "▁" + "=" * 30, "ßé" * 20]
    for wide in (5, 48, 60):
        monkeypatch.setattr(pieces, "WIDE", wide)
        one = pieces.Solver(solver.v)
        one.learn(list(words))
        got = [(one.ids[one.at[w]], float(np.concatenate(one.score)[one.at[w]]), float(np.concatenate(one.gap)[one.at[w]])) for w in words]
        want = want if wide > 5 else got
        assert got == want


def test_clashing_names_and_letter_case(spark):
    df = spark.createDataFrame([(1, "some text", "x", "y")], "doc_id long, text string, IDS string, N_Best string")
    out = pieces.encode(df, PIECES, 2)
    assert out.columns == ["doc_id", "text", "ids", "best_score", "n_best", "alternatives"] and len(out.first().ids)


def test_same_bytes_is_equal_decoding(solver):
    v, rng = solver.v, np.random.default_rng(2)
    raw = lambda x: b"".join(v.raw[i] for i in x)
    some = [v.ids[p] for p in ("a", "t", "h", "e", "th", "the", "he", "at", "▁", "▁a")]
    lists = [np.array(rng.choice(some, rng.integers(0, 6))) for _ in range(300)] + [np.array(v.bytes_id and [v.bytes_id[97]])]
    equal = 0
    for a in lists:
        for b in lists:
            assert pieces.same_bytes(v, a, b) == (raw(a) == raw(b))
            equal += raw(a) == raw(b) and a.tolist() != b.tolist()
    assert equal


def test_a_slice_of_a_column_is_solved_text_by_text(solver):
    texts = ["one, two", None, "", " ß  and a, b.", "▁ x.", "中." * 900, "end ", " "] * 40
    column = pa.array(["before", *texts, "behind"], pa.string()).slice(1, len(texts))
    for lo, hi in ((0, 320), (3, 90), (7, 9), (1, 3), (5, 5)):
        got = solver.solve_all(column.slice(lo, hi - lo), 3)
        assert got == [solver.solve_all([t], 3)[0] for t in texts[lo:hi]]
        for t, (found, _) in zip(texts[lo:hi], got, strict=True):
            assert all(pieces.decode(solver.v, np.frombuffer(x, "<u4")) == t for x in found) and bool(found) == bool(t)
