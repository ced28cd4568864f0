"""Token ids in directly addressable codes (DAC), written as a table of blocks.

A block holds the ids of consecutive documents.  Ids are split into chunks of
CHUNK_BITS bits.  Level 0 has the lowest chunk of every id; level k+1 has one
chunk for each id of level k whose continuation bit is set.  Each level's bitmap
has a rank directory (ones before every RANK_BITS bits), so token j is found by
one rank look-up per level and nothing else of the block is decoded.

Block layout, little-endian:
    magic b"DAC1", uint32 documents, uint64 tokens, uint32 levels
    uint64 x (documents + 1): start of each document within the block
    per level: uint64 chunks, bytes of chunks, bytes of bitmap, uint32 directory

The table has a row per block: part, block, before (tokens in the part before
it), n_docs, n_tokens, doc_ids, payload; parts follow ascending doc_id.

Edge cases: a null or empty text holds only the end id; a null doc_id comes
first; repeated doc_ids are kept side by side, by checksum and text; no rows give
no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import texts_of
from .store import saved, table
from .token_memo import PieceMemo, byte_alphabet, plain_word

CHUNK_BITS, RANK_BITS, MAGIC = 8, 512, b"DAC1"
#: A block is closed at this many tokens.
BLOCK_TOKENS = 1 << 19
BLOCKS = "part int, block int, before long, n_docs int, n_tokens long, doc_ids array<long>, payload binary"


@lru_cache(maxsize=2)
def library_memo(path: str) -> PieceMemo:
    """Ids from the tokenizers library, special tokens not added."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    model, chars = tok.model, str.maketrans(dict(enumerate(byte_alphabet())))

    def encode(piece: bytes) -> list[int]:
        word = plain_word(piece)
        if word is not None:
            # One word of letters: the library's normaliser and splitter leave it whole, its model does the rest.
            return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(chars))]
        return tok.encode(piece.decode(errors="replace"), add_special_tokens=False).ids

    return PieceMemo(encode, np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.uint32)


def encode_block(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """ids of all documents in a row, and the start of each document (one more entry at the end)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.int64) if len(goes_on) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = more[goes_on]
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IQI", len(starts) - 1, len(ids), len(levels))
    return head + starts.astype("<u8").tobytes() + b"".join(levels)


class Block:
    """Random access to an encoded block."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token codes")
        docs, self.n_tokens, count = struct.unpack_from("<IQI", payload, 4)
        at = 20
        self.starts = np.frombuffer(payload, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, (n + 7) // 8, at + 8 + n)
            ranks = np.frombuffer(payload, "<u4", (n + RANK_BITS - 1) // RANK_BITS + 1, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // RANK_BITS
        inside = np.unpackbits(bits[block * RANK_BITS // 8 : (i + 7) // 8], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(inside.sum())

    def tokens(self, i: int, j: int) -> np.ndarray:
        """ids i to j - 1 of the block."""
        ids = np.zeros(j - i, dtype=np.uint32)
        at = np.arange(j - i)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            ids[at] |= chunks[i:j].astype(np.uint32) << (CHUNK_BITS * level)
            on = np.unpackbits(bits[i // 8 : (j + 7) // 8], bitorder="little")[i % 8 : i % 8 + j - i].astype(bool)
            at = at[on]
            if not len(at):
                break
            i = self._rank(bits, ranks, i)
            j = i + len(at)
        return ids

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_memo(path)
        end = np.array([end_id], dtype=memo.dtype).tobytes()
        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) // memo.dtype().itemsize
            payload = encode_block(np.frombuffer(b"".join(ids), memo.dtype), starts)
            values = [[part], [number], [before], [len(ids)], [int(starts[-1])], [names], [payload]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")).cast(pa.large_binary())):
                ids.append(memo.ids(text.as_py()) + end)
                names.append(name)
                size += len(ids[-1]) // memo.dtype().itemsize
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, names, number, before, size = [], [], number + 1, before + size, 0
        if ids:
            yield block()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block, first = Block(row["payload"]), row["first"]
            crcs = [zlib.crc32(block.document(k).astype("<u4").tobytes()) for k in range(row["n_docs"])]
            starts = block.starts
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(first + starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_codes(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order; the block table, written and read back."""
    # Rows of one id, or none, are dealt and ordered by their texts, so that places are the same in every run.
    order = ["doc_id", "text_crc32", "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    return saved(rows.mapInArrow(_write(tokenizer, end_id), BLOCKS), "codes")


def _located(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of tokens before them in the whole table (first)."""
    # One row per part that wrote a file, so the running sum is over as many rows as there were write tasks.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(ahead), "part").withColumn("first", F.col("ahead") + F.col("before"))


def read_codes(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = _located(blocks).select("first", "n_docs", "doc_ids", "payload")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_range(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """(at, ids): tokens start to end - 1 of the whole table, a row per block that holds some of them; only these blocks' payloads are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, first = Block(row["payload"]), row["first"]
                i, j = max(start - first, 0), min(end - first, block.n_tokens)
                yield pa.RecordBatch.from_arrays([pa.array([first + i]), pa.array([block.tokens(i, j).tolist()], pa.list_(pa.int64()))], ["at", "ids"])

    rows = _located(blocks).where((F.col("first") < end) & (F.col("first") + F.col("n_tokens") > start))
    return rows.select("first", "payload").mapInArrow(run, "at long, ids array<long>")


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_codes(write_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))
