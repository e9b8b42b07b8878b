"""Token-id files in directly addressable codes.

An id is cut into bytes, lowest first.  Level k holds the k-th byte of every
id that has one, a bitmap telling which of them go on to level k + 1, and a
rank directory over that bitmap.  The i-th id is read by one look-up per level:
its place in the next level is the rank of its continuation bit, so no block is
decoded to reach it.

The files are Parquet tables whose rows are blocks of whole documents in
ascending id order (null ids first, rows that repeat an id by their text's
hash); a block has the coded ids, the documents' ids and lengths, and its start
within the shard.  Spark's commit protocol makes them survive lost tasks.
Null and empty texts are a document of the end id alone; an empty table gives
no blocks and no rows.  Where asked for, the tokenizer's added tokens in a text
get their own ids, as the library has it by default; else they are plain text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.pretokens import UnitEncoder, column_parts
from quern.llm.shared import bounded_batches

_MAGIC = b"DAC1"
_RANK_BYTES = 64
BLOCK_TOKENS = 1 << 18
#: Units that a worker keeps the ids of, about 200 bytes each.
MEMO = 1_000_000


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest >> 8
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.bitwise_count(np.pad(bits, (0, -len(bits) % _RANK_BYTES))).reshape(-1, _RANK_BYTES).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else np.empty(0, "<u4")
        levels.append(struct.pack("<I", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not goes_on.any():
            return _MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = more[goes_on]


class Packed:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (count,), at, self.levels = struct.unpack_from("<I", data, 4), 8, []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            m = -(-n // 8)
            r = -(-m // _RANK_BYTES)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, m, at + 4 + n)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u4", r, at + 4 + n + m)))
            at += 4 + n + m + 4 * r

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Continuation bits before position i."""
        byte, block = i >> 3, (i >> 3) // _RANK_BYTES
        if block >= len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bits[(len(ranks) - 1) * _RANK_BYTES :]).sum()) if len(ranks) else 0
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * _RANK_BYTES : byte]).sum())
        return n + (int(bits[byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n: a contiguous range on each level, as continuations keep their order."""
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if not n:
                break
            out[where] |= chunks[start : start + n].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 3
            on = np.unpackbits(bits[first : (start + n + 7) >> 3], bitorder="little")[start - 8 * first :][:n].astype(bool)
            where = where[on]
            start, n = self._rank(bits, ranks, start), len(where)
        return out


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, pattern: str) -> UnitEncoder:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path).model
    return UnitEncoder(pattern, lambda pieces: [[t.id for t in model.tokenize(p)] for p in pieces], MEMO)


@lru_cache(maxsize=2)
def _added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Ids of the added tokens by content; those that need more than a plain match are an error, not another result."""
    with open(tokenizer_path, encoding="utf-8") as f:
        own = json.load(f)
    for t in own["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and own["normalizer"]):
            raise ValueError(f"added token {t['content']!r} isn't matched as plain text")
    return {t["content"]: t["id"] for t in own["added_tokens"] if t["content"]}


def _encoded(own: UnitEncoder, texts: pa.Array, added: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text; ``added`` tokens are cut out before units are made, the leftmost and of these the longest first."""
    if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in added):
        return own.encode(texts)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    pieces = [cut(t or "") for t in texts.to_pylist()]
    found, out = iter(own.encode([x for p in pieces for x in p[::2]])), []
    for p in pieces:
        out.append(np.concatenate([np.array([added[x]], "<u4") if k % 2 else next(found) for k, x in enumerate(p)]))
    return out


_BLOCKS = "shard int, block int, shard_start long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_added: bool = False
) -> None:
    """Writes the ids of all texts, each with the end id behind it, in ascending order of document ids."""
    bounded_batches(docs.sparkSession)
    added = _added_tokens(tokenizer_path) if with_added else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = _encoder(tokenizer_path, pattern), TaskContext.get().partitionId()
        names: list = []
        ids: list = []
        block = start = held = 0
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            lengths = [len(ids[i]) + 1 for i in range(0, len(ids), 2)]
            columns = [[shard], [block], [start], [len(flat)], [names], [lengths], [pack(flat)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

        for batch in batches:
            texts, docs_here = batch.column(1), batch.column(0).to_pylist()
            for a, b in column_parts(texts):
                for doc, found in zip(docs_here[a:b], _encoded(own, texts[a:b], added), strict=True):
                    names.append(doc)
                    ids += [found, end]
                    held += len(found) + 1
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        names, ids, block, start, held = [], [], block + 1, start + held, 0
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, _BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, at, names, lengths = (batch.column(c)[r].as_py() for c in range(4))
                codes = Packed(batch.column(4)[r].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                for a in range(0, len(names), 512):
                    some = lengths[a : a + 512]
                    begins = ends[a : a + 512] - some
                    out = [codes.slice(int(s), n).astype("<u4").tobytes() for s, n in zip(begins, some, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(some), pa.int32()), pa.array(names[a : a + 512], pa.int64()),
                            pa.array(begins + at, pa.int64()), pa.array(some, pa.int64()), pa.array(out, pa.binary()),
                        ],
                        ["shard", "doc_id", "place", "n_tokens", "ids"],
                    )

    blocks = spark.read.parquet(path)
    per_shard = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = blocks.select("shard", "shard_start", "doc_ids", "lengths", "codes").mapInArrow(
        run, "shard int, doc_id long, place long, n_tokens long, ids binary"
    )
    # One row for each partition that was written, as many as spark.sql.shuffle.partitions: small enough to broadcast.
    return found.join(F.broadcast(per_shard), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, at, token): the ``at``-th id (from 0) of each wanted document (doc_id, at), read in place without decoding its block.

    Unknown documents and places beyond a document's end give no row; null ids
    aren't found; a document id written twice gives a row for each; repeated
    wishes are answered each.
    """

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, names, lengths in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                first = np.cumsum([0, *lengths[:-1]], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(names), pa.int32()), pa.array([block] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(first), pa.array(lengths, pa.int64())],
                    ["shard", "block", "doc_id", "first", "n"],
                )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = None
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for kind, doc, at, place, data in zip(*(batch.column(c).to_pylist() for c in range(2, 7)), strict=True):
                if kind == 0:
                    codes = Packed(data)
                else:
                    rows[0].append(doc), rows[1].append(at), rows[2].append(codes[place])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "at", "token"])

    blocks = spark.read.parquet(path)
    places = blocks.select("shard", "block", "doc_ids", "lengths").mapInArrow(directory, "shard int, block int, doc_id long, first long, n long")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at")).join(places, "doc_id").filter("at >= 0 and at < n")
    asked = asked.select("shard", "block", F.lit(1).alias("kind"), "doc_id", "at", (F.col("first") + F.col("at")).alias("place"), F.lit(None).cast("binary").alias("codes"))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "at", "place")]
    held = blocks.join(asked.select("shard", "block").distinct(), ["shard", "block"], "left_semi").select("shard", "block", F.lit(0).alias("kind"), *nothing, "codes")
    # A block comes before the places asked of it, which stream past: one block is held at a time.
    both = held.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    return both.mapInArrow(read, "doc_id long, at long, token long")
