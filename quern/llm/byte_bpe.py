"""Byte-level BPE through a sentencepiece model written directly from the vocabulary.

Every token of the rank file becomes a piece, its bytes mapped to printable
characters and its score the negative rank, so that sentencepiece merges pairs
in rank order; normalisation is the identity.  Pre-tokens are encoded apart;
decoding is the inverse byte mapping of the pieces.

Null and empty texts have no ids and decode to no bytes.  Texts of any length
are encoded whole.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pretokens import UnitEncoder, byte_alphabet, column_parts
from quern.llm.shared import bounded_batches


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, content: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(content)) + content


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto: piece 0 is the unknown piece, piece rank + 1 the token of that rank."""
    chars = byte_alphabet()

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _number(2 << 3 | 5) + struct.pack("<f", score) + _number(3 << 3) + _number(kind))

    pieces = [piece("<unk>", 0.0, 2)]
    order = sorted(ranks.items(), key=lambda item: item[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without a gap")
    pieces += [piece("".join(chars[b] for b in token), -float(rank), 1) for token, rank in order]
    trainer = _field(2, _number(3 << 3) + _number(2))  # model_type BPE
    plain = _number(3 << 3) + _number(0) + _number(4 << 3) + _number(0) + _number(5 << 3) + _number(0)
    return b"".join(pieces) + trainer + _field(3, _field(1, b"identity") + plain)

#: Units that a worker keeps, about 200 bytes each, and bytes of text that it encodes at once: workers live on from stage to stage beside others' memos.
MEMO, PART_BYTES = 200_000, 2_000_000


class Codec:
    """Encodes and decodes whole texts by a rank file and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i + 1)) for i in range(len(ranks))]
        self.units = UnitEncoder(pattern, self._pieces, MEMO)

    def _pieces(self, pieces: list[str]) -> list[list[int]]:
        return [[i - 1 for i in ids] for ids in self.model.encode(pieces, num_threads=1)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        return self.units.encode(texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.asarray(ids).tolist()))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _arrays(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in ids)], dtype=np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for a, b in column_parts(batch.column(1), PART_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], _arrays(own.encode(batch.column(1)[a:b]))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                out = [own.decode(x.values) for x in rows.column(1)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): ``encode`` and ``decode`` in one pass over the workers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for a, b in column_parts(batch.column(1), PART_BYTES):
                ids = own.encode(batch.column(1)[a:b])
                back = pa.array([own.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], _arrays(ids), back], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(whole: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``."""
    return whole.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
