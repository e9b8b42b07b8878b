"""Words of a whole Arrow column at once, by numpy over its bytes.

A column's texts lie one after another in one buffer, so a word is a run of
bytes that a table of 256 entries keeps; texts that such a table cannot judge
(Korean endings, other scripts) go through the functions for single texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.functions.terms import SHORTEST, LONGEST, index_terms, is_korean, keywords

_COMMA, _LEAD = 0x2C, 0xC3
#: Lower-case letters and digits stand for themselves, capitals for their small letter, all else ends a word.
_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _FOLD[_c] = _c + 32
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    found = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return found, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(text, word) of the runs of non-zero bytes that have a keyword's length; no run reaches from one text into the next."""
    inside = np.concatenate([data != 0, [False]])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[offsets] = inside[offsets]
    ends = np.concatenate([[False], inside[:-1]])  # a word ends before this place
    ends[1:] &= ~inside[1:] | starts[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    own = (e - s >= SHORTEST) & (e - s <= LONGEST)
    s, e = s[own], e[own]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    edge[e] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept)))
    return np.searchsorted(offsets, s, side="right") - 1, words


def _with_others(texts: pa.Array, folded: np.ndarray, offsets: np.ndarray, others: np.ndarray, of_one: Callable[[str], list[str]]) -> tuple[np.ndarray, pa.Array]:
    """The runs of most texts, and what ``of_one`` gives for the numbered others, in the order of the texts."""
    owners, words = _runs(folded, offsets)
    if not len(others):
        return owners, words
    found = [(i, w) for i in others.tolist() for w in of_one(texts[i].as_py())]
    keep = ~np.isin(owners, others)
    owners = np.concatenate([owners[keep], np.array([i for i, _ in found], owners.dtype)])
    words = pa.concat_arrays([words.filter(pa.array(keep)), pa.array([w for _, w in found], pa.large_string())])
    order = np.argsort(owners, kind="stable")
    return owners[order], words.take(pa.array(order))


def index_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``terms.index_terms`` of each text: (number of the text, term), in order."""
    data, offsets = _buffer(texts)
    folded, gone = _FOLD[data], np.zeros(len(data), bool)
    high = np.flatnonzero(data >= 0x80)
    others = np.zeros(0, np.int64)
    if len(high):
        lead = high[data[high] == _LEAD]
        after = lead + 1
        strange = np.setdiff1d(high, np.concatenate([lead, after]), assume_unique=True)
        others = np.unique(np.searchsorted(offsets, strange, side="right") - 1)
        letter = (data[after] != 0x97) & (data[after] != 0xB7)  # U+00D7 and U+00F7 are signs
        gone[lead[letter]] = gone[after[letter]] = True
    commas = np.flatnonzero(data == _COMMA)
    commas = commas[(commas > 0) & (commas < len(data) - 1)]
    commas = commas[_DIGIT[data[commas - 1]] & _DIGIT[data[commas + 1]]]
    if len(commas):
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        gone[commas[~border[commas] & ~border[commas + 1]]] = True
    if gone.any():
        before = np.concatenate([[0], np.cumsum(~gone)])
        folded, offsets = folded[~gone], before[offsets]
    return _with_others(texts, folded, offsets, others, index_terms)


def keyword_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``terms.keywords`` of each text: (number of the text, keyword), in order."""
    data, offsets = _buffer(texts)
    high = np.unique(np.searchsorted(offsets, np.flatnonzero(data >= 0xE1), side="right") - 1)
    others = np.array([i for i in high.tolist() if is_korean(texts[i].as_py())], np.int64)
    return _with_others(texts, _FOLD[data], offsets, others, keywords)


def listed(n: int, owners: np.ndarray, words: pa.Array) -> pa.Array:
    """A list of words for each of ``n`` texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), words.cast(pa.string()))
