"""Token-id files with fixed-width bit packing.

A file is a set of blocks; a block holds whole documents and starts with a
header of fixed size:

    magic 4s | version u8 | bits u8 | pad u16 | n_docs u32 | n_ids u64 |
    first u64                            (ids of its file part before the block)
    offsets u64 * (n_docs + 1)           (ids before each document, from 0)
    payload                              (each id in ``bits`` bits, LSB first)

Any id of any document is found by its offset alone, and a block is unpacked by
a few numpy operations. Blocks are stored as binary rows of a Parquet table, so
any store that Spark can write works; a row also carries its document ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.llm.common import binaries, chunks, distinct_chunks, shared_dir, slices, text_bytes

HEAD = struct.Struct("<4sBBHIQQ")
MAGIC, VERSION = b"HWTK", 1
#: A block is closed once it has so many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Entries of the memo of encoded chunks, some 250 MB a worker; emptied when full, it never changes a result.
MEMO = 1_200_000
#: Bytes of text that are encoded together.
PASS = 1 << 22


def bits_for(vocab: int) -> int:
    return max(1, (vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes | memoryview, bits: int, lo: int, hi: int) -> np.ndarray:
    """ids lo:hi of a payload as uint32, reading only their bytes."""
    raw = np.frombuffer(payload, np.uint8)
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}")[lo:hi].astype("<u4")
    first = lo * bits // 8
    part = np.unpackbits(raw[first : (hi * bits + 7) // 8], bitorder="little")
    rows = np.zeros((hi - lo, 32), np.uint8)
    rows[:, :bits] = part[lo * bits - first * 8 : hi * bits - first * 8].reshape(-1, bits)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_block(docs: list[bytes], bits: int, first: int) -> bytes:
    """``docs``: each document's ids as little-endian u32 bytes."""
    offsets = np.concatenate(([0], np.cumsum([len(d) // 4 for d in docs]))).astype("<u8")
    ids = np.frombuffer(b"".join(docs), "<u4")
    return HEAD.pack(MAGIC, VERSION, bits, 0, len(docs), len(ids), first) + offsets.tobytes() + pack(ids, bits)


class Block:
    """Random access to one block: ``ids(i)`` unpacks document i only."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, _, self.n_docs, self.n_ids, self.first = HEAD.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        self.offsets = np.frombuffer(raw, "<u8", self.n_docs + 1, HEAD.size).astype(np.int64)
        self.payload = memoryview(raw)[HEAD.size + 8 * (self.n_docs + 1) :]

    def ids(self, doc: int) -> np.ndarray:
        return unpack(self.payload, self.bits, int(self.offsets[doc]), int(self.offsets[doc + 1]))

    def all_ids(self) -> np.ndarray:
        return unpack(self.payload, self.bits, 0, self.n_ids)


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the
    others, in ascending order, as the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _table(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SPACES = _table(*range(9, 14), *range(28, 33))
GAPS = _table(10, 32)
WORD = _table(*range(48, 58), *range(65, 91), *range(97, 123))
STOPS = _table(*(b for b in range(33, 127) if not chr(b).isalnum()))
#: Lead bytes of the white space that UTF-8 writes in two or three bytes.
WIDE = _table(0xC2, 0xE1, 0xE2, 0xE3)


def white(data: np.ndarray) -> np.ndarray:
    """The bytes of UTF-8 text that belong to white space; a few characters of
    the blocks where wide white space stands count as such too."""
    out = SPACES[data]
    lead = np.flatnonzero(WIDE[data])
    if len(lead):
        second = data[np.minimum(lead + 1, len(data) - 1)]
        kind = data[lead]
        two = lead[(kind == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        three = lead[((kind == 0xE1) & (second == 0x9A)) | ((kind == 0xE2) & (second <= 0x81)) | ((kind == 0xE3) & (second == 0x80))]
        for at in (two, two + 1, three, three + 1, three + 2):
            out[at] = True
    return out


class Encoder:
    """Encodes with the tokenizers library.

    Byte-level BPE never merges across a single space or line feed that stands
    between two characters that are no white space, nor from an ASCII letter or
    digit into a punctuation mark. Texts are cut there (a gap belongs to the
    chunk behind it), each distinct chunk is encoded once, and the ids are joined.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.raw: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        #: the number of a chunk; its ids are ids[at[number]:at[number + 1]]
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(0, "<u4")
        self.at = np.zeros(1, np.int64)

    def _learn(self, missing: list[bytes]) -> None:
        """Plain words behind a gap go to the library thousands in one call, told
        apart by the word numbers it gives: one word behind a space, two (the line
        feed is one) behind a line feed. All others are encoded one by one."""
        plain: list[str] = []
        odd: list[str] = []
        for c in missing:
            t = c.decode()
            (plain if t[0] in " \n" and (t[1:].isalpha() or t[1:].isdecimal()) else odd).append(t)
        order: list[str] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            words = np.cumsum([1 + (t[0] == "\n") for t in part])
            enc = self.tokenizer.encode("".join(part), add_special_tokens=False)
            at = np.array(enc.word_ids, np.int64)
            if at[-1] != words[-1] - 1 or (np.diff(at) < 0).any():  # the library cuts some word
                odd += part
                continue
            order += part
            ids.append(np.array(enc.ids, "<u4"))
            sizes.append(np.diff(np.searchsorted(at, words), prepend=0))
        for lo in range(0, len(odd), 1024):
            got = [e.ids for e in self.tokenizer.encode_batch(odd[lo : lo + 1024], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(got), "<u4"))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        order += odd
        self.memo.update(zip(map(str.encode, order), range(len(self.memo), len(self.memo) + len(order)), strict=True))
        self.ids = np.concatenate((self.ids, *ids))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))))

    def encode_many(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of whole texts as little-endian u32 bytes; null and empty give none."""
        if len(self.memo) > MEMO:
            self.clear()
        data, ends = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(data):
            return [b""] * (len(ends) - 1)
        gap, space = GAPS[data], white(data)
        gap[:1] = gap[-1:] = False
        gap[1:-1] &= ~space[:-2] & ~space[2:]
        # a gap at the border of two texts is no cut
        inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
        gap[inner - 1] = False
        gap[1:] |= STOPS[data[1:]] & WORD[data[:-1]]
        gap[inner] = gap[0] = True
        cut = np.append(np.flatnonzero(gap), len(data))
        chunk, number = distinct_chunks(data, cut)
        place = np.fromiter(map(self.memo.get, chunk, repeat(-1)), np.int64, len(chunk))
        new = np.flatnonzero(place < 0)
        if len(new):
            missing = [chunk[i] for i in new.tolist()]
            self._learn(missing)
            place[new] = np.fromiter(map(self.memo.__getitem__, missing), np.int64, len(missing))
        got = binaries(self.ids, 4 * self.at).take(pa.array(place[number]))
        return slices(got, np.searchsorted(cut, ends))

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The exact text of ids of this vocabulary: a byte-level token is the bytes it stands for."""
        if not self.raw:
            of = byte_symbols()
            self.raw = [bytes(map(of.__getitem__, self.tokenizer.id_to_token(i))) if all(c in of for c in self.tokenizer.id_to_token(i)) else b"" for i in range(self.tokenizer.get_vocab_size())]
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, out: str, encode: Callable[[], Callable[[pa.Array], list[bytes]]], vocab: int, end_id: int) -> None:
    """Encode every whole text, add ``end_id`` and write the token file to ``out``.

    Rows go to ascending ranges of (doc_id, hash of the text), nulls first, so
    even one id on a third of all rows is dealt over many parts; equal rows are
    interchangeable. A part's blocks are numbered in its order.
    """
    bits = bits_for(vocab)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode()
        held: list[bytes] = []
        who: list[int | None] = []
        state = {"first": 0, "block": 0, "n": 0}
        part = None

        def flush() -> pa.RecordBatch:
            raw = write_block(held, bits, state["first"])
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([state["block"]], pa.int64()), pa.array([state["n"]], pa.int64()), pa.array([list(who)], pa.list_(pa.int64())), pa.array([raw], pa.binary())], ["part", "block", "n_ids", "doc_ids", "data"])
            state["first"] += state["n"]
            state["block"] += 1
            state["n"] = 0
            held.clear()
            who.clear()
            return row

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in chunks(sizes, PASS):
                got = enc(batch.column(1).slice(lo, hi - lo))
                for d, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), got, strict=True):
                    held.append(ids + end)
                    who.append(d)
                    state["n"] += len(ids) // 4 + 1
                    if state["n"] >= BLOCK_IDS:
                        yield flush()
        if held:
            yield flush()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), F.asc("h")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc("h"))
    rows.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, block long, n_ids long, doc_ids array<bigint>, data binary").write.parquet(out)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``before``: the ids of all blocks before them. One row per
    part (there are as many as shuffle partitions) is summed in order."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(parts), "part")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, who, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(raw.as_py())
                ids, at = block.all_ids().tobytes(), block.offsets
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(at[:-1] + base + block.first), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).select("base", "doc_ids", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, vocab: int = 50257, end_id: int = 2) -> DataFrame:
    """Write the token file of ``docs`` below the shared folder and read it back.

    Null and empty texts have the end id only; repeated rows are written as
    often as they stand; rows with a null id come first; other columns than
    doc_id and text are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, lambda: encoder(tokenizer).encode_many, vocab, end_id)
    return read_digests(spark, out)
