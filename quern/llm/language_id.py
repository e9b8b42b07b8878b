"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a cell holds a mask with a bit for
each language, so the AND of an n-gram's cells names all languages that contain
it.  A language's share of a text's n-grams, less what its filter's false
positives would give, is its evidence; the largest decides.

Filters are learned from about ``SAMPLE`` distinct labelled texts of each
language, chosen by a bound on their hash that the number of distinct texts
sets, so that no language is gathered or ordered and a text's copies count
once; predictions use nothing but the text.  A null text, or one without letters, is ``und`` with score 0.  A text whose
n-grams no filter knows gets the first learned language with score 0.  Ties go
to the first language in code point order.  Without labelled rows every text
is ``und``.  Texts of any length are read whole, a megabyte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.fitting import within
from quern.llm.shared import bounded_batches, written

SAMPLE = 1500
#: N-grams kept of a language: those in this share of its sampled texts at least.
COMMON = 0.02
CELLS = 1 << 18
HASHES = (0x9E3779B1, 0x85EBCA77)
PIECE = 1 << 20
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of the four-byte n-grams of lower-cased letters and blanks, by pieces."""
    data = b" " + text.lower().encode().translate(_BLANKS) + b"  "
    for a in range(0, len(data) - 3, PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - a), a).astype(np.uint32)
        yield b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def _cells(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes * np.uint32(h)) >> np.uint32(32 - CELLS.bit_length() + 1) for h in HASHES]


class Filters:
    """Bit-sliced Bloom filters: ``masks[cell]`` has a bit for each language, in words of 64 languages."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        self.masks = np.zeros((-(-len(self.languages) // 64) or 1, CELLS), np.uint64)
        for i, lang in enumerate(self.languages):
            for cells in _cells(np.asarray(by_language[lang], np.uint32)):
                self.masks[i // 64, cells] |= np.uint64(1 << (i % 64))
        full = [np.count_nonzero(self.masks[i // 64] & np.uint64(1 << (i % 64))) / CELLS for i in range(len(self.languages))]
        self.false_rate = np.array(full) ** len(HASHES)

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """Masks (words, n-grams) of all languages that contain each n-gram."""
        first, *others = _cells(codes)
        found = self.masks[:, first]
        for cells in others:
            found &= self.masks[:, cells]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UND, 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for codes in grams(text):
            found, n = self.languages_of(codes), n + len(codes)
            hits += [np.count_nonzero(found[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))]
        evidence = np.maximum(0, (hits / max(n, 1) - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9))
        best = int(np.argmax(evidence))
        total = evidence.sum()
        return self.languages[best], float(evidence[best] / total) if total > 0 else 0.0


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from rows with a language; what reaches the driver is the n-grams common in a bounded sample."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).filter("lang is not null and text is not null")
    # One row a language; the filters of all languages, 32 KB each, are held by the driver anyway.
    shares = rows.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.approx_count_distinct("h", 0.02)).alias("share"))
    sample = rows.join(F.broadcast(shares), "lang").filter(within(F.col("h"), F.col("share")))
    sample = sample.dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(grams(text))
                held.setdefault(lang, []).append(np.unique(np.concatenate(own)) if own else np.empty(0, np.uint32))
                docs[lang] = docs.get(lang, 0) + 1
        for lang, all_ in held.items():
            codes, n = np.unique(np.concatenate(all_), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(codes) + 1)), pa.array([*codes.tolist(), -1], pa.int64()), pa.array([*n.tolist(), docs[lang]], pa.int64())],
                ["lang", "gram", "docs"],
            )

    counts = written(sample.mapInArrow(count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "grams")
    texts = counts.filter("gram = -1").select("lang", F.col("docs").alias("all"))
    kept = counts.filter("gram >= 0").join(F.broadcast(texts), "lang").filter(F.col("docs") >= F.greatest(F.lit(1), F.col("all") * COMMON))
    table = kept.select("lang", "gram").toPandas()
    return Filters({str(lang): group["gram"].to_numpy() for lang, group in table.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; the filters (2 MB for 64 languages) are broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
