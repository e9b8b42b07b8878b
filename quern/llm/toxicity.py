"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on windows of ordinary texts
and one on windows of toxic texts.  A window is a word; it is compressed with
each of them, and what the toxic one saves, as a share of what the word costs
under the ordinary one, is its gain.  A text's statistic is the number of
windows whose gain reaches a threshold, over the root of their number; from a
second threshold on it is toxic.  Both thresholds are calibrated on labelled
texts that the dictionaries have not seen.

Most words of a toxic text are ordinary, so plain training fills both
dictionaries with the same common syllables.  Training goes in ``ROUNDS``, to and
fro between two halves of the texts: dictionaries of one half judge the words of
the other, and the words with the greatest gain train the next toxic
dictionary, ever fewer and smaller.  What only one text holds gains nothing in
the other half and drops out; so that near copies in both halves don't count as
many texts, a word is taken once between the same neighbours.  A gain counts by
the word's surplus, the standard errors by which it is more frequent in toxic
windows than in ordinary ones, in either half; words without one train no toxic
dictionary, and the others train it once each, so that the most frequent don't
fill it.  The ordinary dictionary takes in the ordinary words that gained
most although they should not.

Compressors find no match in the last bytes of a frame, and the first match of
a frame costs most; so each window stands between a mark that both dictionaries
hold and a tail that neither does.

Fitted on about ``SAMPLE`` labelled texts of each class and about so many of
their windows as ``TOXIC_WINDOWS`` and ``ORDINARY_WINDOWS`` say, both chosen by
hash; windows are at most ``WINDOW_CHARS`` characters, so what reaches the
driver is bounded.  Null and empty texts have one empty window and no gain.
Texts of any length are read whole.  Without labels of both classes the score is
the smoothed share of the one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.fitting import sampled_texts
from quern.llm.shared import bounded_batches

SAMPLE = 4000
TOXIC_WINDOWS, ORDINARY_WINDOWS = 150_000, 240_000
WINDOW_CHARS = 400
MARK, TAIL = b"\x01window:\x01", b"\x02\x03\x04\x05\x06\x07\x08\x02\x05"
ROUNDS = 8
#: Bytes of the toxic dictionary in the first round and at least (half as many each round), and of either half of the ordinary one.
FIRST_BYTES, LAST_BYTES, ORDINARY_BYTES = 96 << 10, 8 << 10, 50 << 10
#: Sizes of the segments that training picks, and of the substrings it counts: for single words, and for ordinary text at large.
WORDS, LARGE = (16, 6), (64, 8)
#: Share of the windows that train the next round: at first, from round to round, and at least.
HARDEST, LESS, FEWEST, LEAST = 0.06, 0.75, 0.015, 500
#: Least surplus of a word that trains the toxic dictionary.
SURPLUS = 1.0
#: Shortest match; a window that shares no such run with the toxic dictionary gains nothing.
MATCH = 4
#: Words that cost less than this under the ordinary dictionary count as if they cost so much.
CHEAP = 6
#: Of ten sampled texts, so many make the dictionaries; the others calibrate.
FOR_DICTIONARIES = 6
#: Gains tried as threshold, and the share of ordinary texts that may be flagged in calibration.
GAINS, FALSE_ALARMS = (0.2, 0.3, 0.4, 0.5, 0.6), 0.01
#: Words whose gain a worker keeps.
MEMO = 500_000


def windows(text: str | None) -> list[str]:
    """The words of a text in lower case; longer ones in pieces."""
    found = (text or "").lower().split()
    if any(len(w) > WINDOW_CHARS for w in found):
        found = [w[a : a + WINDOW_CHARS] for w in found for a in range(0, len(w), WINDOW_CHARS)]
    return found or [""]


@lru_cache(maxsize=4)
def _compressor(content: bytes):
    import zstandard

    # As raw content, so that a window's length depends on what the dictionary holds and not on its entropy tables.
    own = zstandard.ZstdCompressionDict(content + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=19, search_log=6, min_match=MATCH, target_length=16, strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress


def cost(window: str, content: bytes) -> int:
    """Bytes of a window under a dictionary."""
    return len(_compressor(content)(MARK + f" {window} ".encode("utf-8", "surrogatepass") + TAIL))


def gain(window: str, toxic: bytes, ordinary: bytes) -> float:
    """The share of a window's cost under the ordinary dictionary that the toxic one saves."""
    under = cost(window, ordinary)
    return (under - cost(window, toxic)) / max(CHEAP, under - len(_compressor(ordinary)(MARK + TAIL)))


def _gains(of: list[str], toxic: bytes, ordinary: bytes) -> np.ndarray:
    each = {w: gain(w, toxic, ordinary) for w in set(of)}
    return np.array([each[w] for w in of])


def _trained(of: list[str], size: int, segment: int, counted: int) -> bytes:
    """A dictionary trained on windows; of too few windows for that, their own bytes."""
    import zstandard

    own = [f" {w} ".encode("utf-8", "surrogatepass") for w in of]
    if sum(map(len, own)) > 4 * size:
        try:
            return zstandard.train_dictionary(size, own, k=segment, d=counted).as_bytes()
        except zstandard.ZstdError:  # windows without anything that repeats
            pass
    return b"".join(own)[-size:]


def _hardest(of: list[str], by: np.ndarray, share: float) -> list[str]:
    return [of[i] for i in np.argsort(-by, kind="stable")[: max(LEAST, int(len(of) * share))]]


def _surplus(toxic_windows: tuple[list[str], list[str]], ordinary_windows: tuple[list[str], list[str]]) -> dict[str, float]:
    """For words that both halves hold and have a surplus in: the lesser of the two."""
    halves = []
    for toxic, ordinary in zip(toxic_windows, ordinary_windows, strict=True):
        more, fewer, ratio = Counter(toxic), Counter(ordinary), max(1, len(toxic)) / max(1, len(ordinary))
        halves.append({w: (n - fewer[w] * ratio) / math.sqrt(n + (fewer[w] + 1) * ratio) for w, n in more.items()})
    both = {w: min(z, halves[1][w]) for w, z in halves[0].items() if w in halves[1]}
    return {w: z for w, z in both.items() if z > SURPLUS}


def _marks(of: list[str], by: np.ndarray, surplus: dict[str, float], share: float) -> list[str]:
    """The words of greatest gain times surplus, each once; without one the windows of greatest gain."""
    each = {w: g * surplus[w] for w, g in zip(of, by.tolist(), strict=True) if g > 0 and w in surplus}
    return sorted(each, key=lambda w: (-each[w], w))[: max(LEAST, int(len(of) * share))] or _hardest(of, by, share)


def dictionaries(toxic_windows: tuple[list[str], list[str]], ordinary_windows: tuple[list[str], list[str]]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from the windows of two halves of the texts each."""
    toxic, ordinary = _trained(toxic_windows[0], FIRST_BYTES, *WORDS), _trained(ordinary_windows[0], 2 * ORDINARY_BYTES, *LARGE)
    false: list[list[str]] = [[], []]
    surplus = _surplus(toxic_windows, ordinary_windows)
    share = HARDEST
    for i in range(ROUNDS):
        other = (i + 1) % 2
        hard = _marks(toxic_windows[other], _gains(toxic_windows[other], toxic, ordinary), surplus, share)
        false[other] = _hardest(ordinary_windows[other], _gains(ordinary_windows[other], toxic, ordinary), share)
        toxic = _trained(hard, max(LAST_BYTES, FIRST_BYTES * 2 // 3 >> i), *WORDS)
        ordinary = _trained(false[0] + false[1], ORDINARY_BYTES, *WORDS) + _trained(ordinary_windows[other], ORDINARY_BYTES, *LARGE)
        share = max(FEWEST, share * LESS)
    return toxic, ordinary


class Flags(dict):
    """Whether a window's gain reaches the threshold; filled as windows are met."""

    def __init__(self, toxic: bytes, ordinary: bytes, least: float):
        super().__init__()
        self.toxic, self.ordinary, self.least = toxic, ordinary, least
        self.none = len(_compressor(ordinary)(MARK + TAIL))
        self.runs = {toxic[i : i + MATCH] for i in range(len(toxic) - MATCH + 1)}

    def __missing__(self, window: str) -> bool:
        if len(self) >= MEMO:
            self.clear()
        own = f" {window} ".encode("utf-8", "surrogatepass")
        found = any(own[i : i + MATCH] in self.runs for i in range(len(own) - MATCH + 1))
        if found:
            # At most all bytes of a window are saved, so what it costs under the toxic dictionary bounds its gain.
            most = len(own) + 2
            found = (self.none + most - cost(window, self.toxic)) / max(CHEAP, most) >= self.least and gain(window, self.toxic, self.ordinary) >= self.least
        self[window] = found
        return found

    def statistic(self, text: str | None) -> float:
        own = windows(text)
        return sum(map(self.__getitem__, own)) / math.sqrt(len(own))


class Model:
    """Dictionaries with the two thresholds; or, of one class alone, a share."""

    def __init__(self, toxic: bytes, ordinary: bytes, least: float, cut: float, share: float | None = None):
        self.toxic, self.ordinary, self.least, self.cut, self.share = toxic, ordinary, least, cut, share

    def scorer(self):
        """A function of texts: the statistic mapped to (0, 1), a half at the threshold."""
        if self.share is not None:
            return lambda texts: np.full(len(texts), self.share)
        flags = Flags(self.toxic, self.ordinary, self.least)

        def scores(texts: list[str | None]) -> np.ndarray:
            found = np.array([flags.statistic(t) for t in texts])
            return found / (found + self.cut)

        return scores


def _sampled_windows(sample: DataFrame) -> dict[int, tuple[list[str], list[str]]]:
    """Windows of (label, text, h) by label and half of the texts: those whose hash lies below a bound that their number sets, in the order of their hashes.

    A window counts once between the same neighbours, however many near copies
    of a text repeat it: what sets a class apart stands in many surroundings.
    """
    words = F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"\S+")))
    counts = {r["label"]: r["n"] or 1 for r in sample.groupBy("label").agg(F.sum(words).alias("n")).collect()}
    bound = {label: int(min(1.0, most / max(1, counts.get(label, 1))) * (1 << 32)) for label, most in ((0, ORDINARY_WINDOWS), (1, TOXIC_WINDOWS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text, half in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                # A word is hashed with its neighbours, so that a common word isn't taken or left out everywhere at once, but one of a copied passage is.
                own, most = windows(text), bound[label]
                kept = [(h, w) for before, w, after in zip(["", *own], own, [*own[1:], ""]) if (h := zlib.crc32(f"{before} {w} {after}".encode("utf-8", "surrogatepass"))) < most]
                columns = [pa.array([label] * len(kept), pa.int32()), pa.array([half] * len(kept), pa.int32()), pa.array([h for h, _ in kept], pa.int64()), pa.array([w for _, w in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "half", "h", "w"])

    rows = sample.select("label", "text", F.pmod("h", F.lit(2)).cast("int").alias("half"))
    found = rows.mapInArrow(run, "label int, half int, h long, w string").toPandas().sort_values(["h", "w", "half"])
    found = found.drop_duplicates(["label", "h", "w"])
    return {label: tuple(found["w"][(found["label"] == label) & (found["half"] == half)].tolist() for half in (0, 1)) for label in (0, 1)}


def _cut(ordinary: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(threshold, share of toxic texts caught): above what all but ``FALSE_ALARMS`` of the ordinary texts have, halfway to the next toxic one."""
    low = np.sort(ordinary)[max(0, len(ordinary) - 1 - int(FALSE_ALARMS * len(ordinary)))] if len(ordinary) else 0.0
    above = toxic[toxic > low]
    return (low + (above.min() if len(above) else low + 1)) / 2, len(above) / max(1, len(toxic))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Dictionaries and calibrated thresholds from bounded samples."""
    bounded_batches(docs.sparkSession)
    sample = sampled_texts(docs, labels, label, SAMPLE, id_col, text_col).withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(10)))
    found = _sampled_windows(sample.filter(F.col("part") < FOR_DICTIONARIES))
    if not any(found[0]) or not any(found[1]):
        counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        return Model(b"", b"", 0.0, 0.0, (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + counts.get(1, 0) + 1))
    toxic, ordinary = dictionaries(found[1], found[0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = [Flags(toxic, ordinary, least) for least in GAINS]
        for batch in batches:
            rows = [[f.statistic(t) for f in flags] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    seen = sample.filter(F.col("part") >= FOR_DICTIONARIES).select("label", "text").mapInArrow(measure, "label int, x array<double>").toPandas()
    x, y = np.array(seen["x"].tolist()).reshape(-1, len(GAINS)), seen["label"].to_numpy()
    cuts = [_cut(x[y == 0, i], x[y == 1, i]) for i in range(len(GAINS))]
    best = max(range(len(GAINS)), key=lambda i: (cuts[i][1], GAINS[i]))
    return Model(toxic, ordinary, GAINS[best], cuts[best][0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scorer()
        for batch in batches:
            p = scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
