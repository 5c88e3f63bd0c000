"""Chat formatting by token-level assembly.

Each segment of a turn (its text, and its role where the template spells it
out) is encoded on its own; reserved ids above the tokenizer's vocabulary are
spliced between the segments, so no text can forge a marker id. In the rendered
form the markers are control strings, hence a text that contains one is escaped,
reversibly, before it is encoded. The loss mask is the prefix sum of +1 where an
assistant text begins and -1 behind its end.

Template, with reserved ids in brackets:

    <s>                                       before the first turn
    [INST] text [/INST]                       user
    [SAY] text </s>                           assistant
    [ROLE] role [TEXT] text [END]             any other role, null as empty
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.llm.tokenfile import encoder

#: Reserved ids are VOCAB + the place in this list; the strings are what a rendering shows.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[SAY]", "[ROLE]", "[TEXT]", "[END]")
BOS, EOS, USER, USER_END, SAY, ROLE, TEXT, END = range(len(MARKS))
VOCAB = 50257
ESCAPE = "\\"
_CONTROL = re.compile("|".join(re.escape(m) for m in (ESCAPE, *MARKS)))


def escape(text: str) -> str:
    """Doubles every backslash and puts one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def assemble(role: str, segments: list[np.ndarray], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one turn. ``segments``: the encoded text, before it the role of other turns."""
    mark = lambda k: np.array([VOCAB + k], np.int32)
    if role == "user":
        parts = [mark(USER), segments[-1], mark(USER_END)]
    elif role == "assistant":
        parts = [mark(SAY), segments[-1], mark(EOS)]
    else:
        parts = [mark(ROLE), segments[0], mark(TEXT), segments[-1], mark(END)]
    if first:
        parts.insert(0, mark(BOS))
    ids = np.concatenate(parts)
    step = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        step[1 + first] += 1
        step[len(ids) - 1] -= 1
    return ids, np.cumsum(step)[:-1].astype(bool)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, first, ids array<int>, mask array<boolean>), a row per turn.

    Null role or text: empty. Turns of equal number are ordered by role and
    text, nulls first; repeated rows stay. A null conv_id is a conversation of its
    own. A task streams its conversations turn by turn, so one may be of any length.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        last: object = enc  # no conversation yet
        for batch in batches:
            ids, masks, firsts = [], [], []
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            segments = [np.frombuffer(e, "<u4").astype(np.int32) for e in enc.encode_many([escape(t) for t in roles + texts])]
            for conv, role, r, t in zip(batch.column(0).to_pylist(), roles, segments[: len(roles)], segments[len(roles) :], strict=True):
                first, last = conv != last, conv
                i, m = assemble(role, [r, t], first)
                ids.append(i)
                masks.append(m)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, pa.bool_()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "turn", "first", "ids", "mask"])

    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, "conv_id long, turn long, first boolean, ids array<int>, mask array<boolean>")


class Reader:
    """Turns ids back into text: reserved ids to markers, the others through the tokenizer."""

    def __init__(self, tokenizer: str):
        self.encoder = encoder(tokenizer)

    def text(self, ids: np.ndarray) -> str:
        return self.encoder.decode(ids)

    def parse(self, ids: np.ndarray) -> tuple[str, str, str]:
        """(role, text, rendered) of one turn."""
        at = np.flatnonzero(ids >= VOCAB)
        kinds = (ids[at] - VOCAB).tolist()
        pieces = [self.text(ids[a + 1 : b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
        shown = "".join(MARKS[k] + p for k, p in zip(kinds, pieces, strict=True))
        by = dict(zip(kinds, pieces, strict=True))
        if USER in by:
            return "user", unescape(by[USER]), shown
        if SAY in by:
            return "assistant", unescape(by[SAY]), shown
        return unescape(by[ROLE]), unescape(by[TEXT]), shown


def digests(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Read ``format_turns`` rows back, one row per conversation. The hashes run
    along the sorted turns of a part, so a conversation is never held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(tokenizer)
        open_: dict = {}
        done: list[dict] = []

        def close() -> None:
            if open_:
                done.append({"conv_id": open_["conv"], "n_turns": open_["n"], "turns_sha256": open_["turns"].hexdigest(), "loss_chars": open_["chars"], "loss_sha256": open_["loss"].hexdigest(), "formatted_chars": open_["shown"]})

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for conv, ids_, mask_ in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if not open_ or open_["conv"] != conv:
                    close()
                    open_ = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "shown": 0}
                ids, mask = ids_.values.to_numpy(), mask_.values.to_numpy(zero_copy_only=False)
                role, text, shown = reader.parse(ids)
                learned = unescape(reader.text(ids[mask]))
                open_["n"] += 1
                open_["turns"].update(f"{role}\n{text}\n".encode())
                open_["loss"].update(learned.encode())
                open_["chars"] += len(learned)
                open_["shown"] += len(shown)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kinds).select(names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds).select(names)

    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
