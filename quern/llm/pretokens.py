"""Splitting text for byte-level BPE, with a memo of pieces that a worker has seen.

A *unit* is a run of white space and the run of other characters behind it,
less the punctuation at its end if that follows a letter or digit.  No pre-token
of the byte-level pattern crosses the edges of units, so they can be encoded one
by one and their ids put side by side.  Arrow splits whole columns into units
and numbers the distinct ones, so that Python sees each only once a column.
Most units of a corpus repeat; each worker keeps the ids of those it has met.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Unicode white space, as the pattern's \s has it.
_SPACE = "\t-\r \x85\xa0  -     　"
_PLAIN = "A-Za-z0-9À-ÖØ-öø-ÿ"
#: Put before each unit but the first; texts that hold it themselves are encoded as one unit.
_MARK = "\0"
_BEFORE_ENDS = rf"([{_PLAIN}])([.,|;:!?]+)([{_SPACE}]|\z)"
_BEFORE_SPACE = rf"([{_SPACE}]+)"
#: A word with a blank before it or none: one pre-token.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Entries of the memo, about 200 bytes each, in two generations: when the younger is full it becomes the older, and what
#: the older held and nobody asked for since is forgotten.
MEMO = 400_000


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    chars, free = [], 256
    for b in range(256):
        chars.append(chr(b if b in plain else free))
        free += b not in plain
    return chars


class _Packed(dict):
    """Bytes of an id as a little-endian unsigned 32-bit integer."""

    def __missing__(self, i: int) -> bytes:
        value = self[i] = struct.pack("<I", i)
        return value


class UnitEncoder:
    """Encodes texts by units; ``encode_pieces`` turns byte-mapped pre-tokens into lists of ids."""

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[list[int]]], memo: int = MEMO):
        self.split = regex.compile(pattern).findall
        self.encode_pieces = encode_pieces
        self.to_chars = dict(enumerate(byte_alphabet()))
        self.most, self.memo, self.older = memo // 2, {}, {}
        self.pack = _Packed().__getitem__

    def _learn(self, units: list[str]) -> None:
        """Adds units to the memo: words are one pre-token each, others are split by the pattern."""
        pack, chars = self.pack, self.to_chars
        mapped = lambda p: p.encode().decode("latin-1").translate(chars)
        words = list(filter(_WORD.match, units))
        pieces = [("Ġ" + u[1:] if u[0] == " " else u) if u.isascii() else mapped(u) for u in words]
        self.memo.update(zip(words, [pack(x[0]) if len(x) == 1 else b"".join(map(pack, x)) for x in self.encode_pieces(pieces)], strict=True))
        others = [u for u in units if not _WORD.match(u)]
        pieces, ends = [], []
        for unit in others:
            pieces += map(mapped, self.split(unit))
            ends.append(len(pieces))
        ids, at = self.encode_pieces(pieces), 0
        for unit, end in zip(others, ends, strict=True):
            self.memo[unit] = b"".join(pack(i) for piece in ids[at:end] for i in piece)
            at = end

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units, which are learned if they are new."""
        new = [u for u in units if u not in self.memo]
        if new:
            if len(self.memo) + len(new) > self.most:
                self.older, self.memo, new = self.memo, {}, units
            older = self.older
            known = {u: older[u] for u in new if u in older}
            self.memo.update(known)
            self._learn([u for u in new if u not in known])
        return list(map(self.memo.__getitem__, units))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = pc.match_substring(column, _MARK)
        marked = pc.replace_substring_regex(column, _BEFORE_ENDS, rf"\1{_MARK}\2\3")
        marked = pc.split_pattern(pc.replace_substring_regex(marked, _BEFORE_SPACE, rf"{_MARK}\1"), _MARK)
        if pc.any(whole).as_py():
            rare = [[t] if w else own for t, w, own in zip(column.to_pylist(), whole.to_pylist(), marked.to_pylist(), strict=True)]
            marked = pa.array(rare, pa.list_(pa.string()))
        numbered = marked.flatten().dictionary_encode()
        ids, at = self._ids(numbered.dictionary.to_pylist()), numbered.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        first, each = np.cumsum(size, dtype=np.int32) - size, size[at]
        ends = np.cumsum(each, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(first[at] - ends + each, each)]
        cuts = np.concatenate([[0], ends])[marked.offsets.to_numpy() - marked.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def column_parts(column: pa.Array, size: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of rows of about so many bytes each, one row at least: bounds what is in memory at once."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
