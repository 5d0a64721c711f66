"""Vectorised word kernel shared by the text operators.

A word is a maximal run of bytes other than space and ``\\x09-\\x0d``. All work
is on numpy arrays over the UTF-8 bytes of an Arrow batch: no Python loop over
words. Hashes are 64 bits wide and depend on nothing but the bytes of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR = r"[\x20\x09-\x0D]+"

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
#: Bytes of a stretch that is hashed at a time; bounds the scratch memory. Positions in a word with a table of their own.
_SEGMENT, _DEPTH = 1 << 18, 64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cells(position: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each byte at each position: no two positions share a table."""
    return mix((position.astype(np.uint64) * _U(256) + byte.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


#: ``CELLS[256 * i + c]`` belongs to byte ``c`` at position ``i`` of a span.
CELLS = _cells(np.repeat(np.arange(_DEPTH), 256), np.tile(np.arange(256), _DEPTH))


def cells(position: int, byte: np.ndarray) -> np.ndarray:
    """What each byte adds to the hash of a span if it stands at ``position``."""
    return CELLS[256 * position + byte.astype(np.int64)] if position < _DEPTH else _cells(np.full(len(byte), position), byte)


@dataclass
class Words:
    """Words of some texts. ``first[d] : first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokenize(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; ``lower`` turns A-Z into a-z first."""
    data, offsets = text_bytes(texts)
    n = len(data)
    sep = _IS_SEP[data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    if n:
        before[1:], after[:-1] = sep[:-1], sep[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = True
        after[inner - 1] = True
    np.logical_not(sep, out=sep)
    start, end = np.flatnonzero(sep & before), np.flatnonzero(sep & after) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return Words(data, start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are disjoint and ascending.

    The sum of a table entry for each byte at its position (tabulation): unlike a
    polynomial, it has no structure that words made by a rule could meet."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(end, low + _SEGMENT, side="right")))
        if end[to - 1] - low <= _SEGMENT:
            s, e = start[at:to] - low, end[at:to] - low
            part = data[low : low + e[-1]]
            position = np.arange(len(part), dtype=np.int32)
            position -= np.repeat(s, np.diff(np.append(s, len(part)))).astype(np.int32)
            deep = np.flatnonzero(position >= _DEPTH)
            far = position[deep]
            position[deep] = 0
            each = CELLS[(position << 8) + part]
            each[deep] = _cells(far, part[deep])
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(each, out=total[1:])
            out[at:to] = total[e] - total[s]
        else:  # one word longer than a segment: piece by piece
            h = _U(0)
            for x in range(low, end[at], _SEGMENT):
                part = data[x : min(end[at], x + _SEGMENT)]
                h = h + _cells(np.arange(x - low, x - low + len(part)), part).sum(dtype=np.uint64)
            out[at] = h
        at = to
    return mix(out)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order; not linear in either."""
    h = a * _U(0xD6E8FEB86659FD93)
    h += b
    h ^= h >> _U(32)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes (over all words, so mask runs that leave a text).

    Runs of doubled width are paired; the last pair overlaps where ``k`` is no power of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n > _SEGMENT:
        return np.concatenate([window_hashes(h[x : min(n, x + _SEGMENT) + k - 1], k) for x in range(0, n, _SEGMENT)])
    width = 1
    while 2 * width <= k:
        h = _pair(h[:-width], h[width:])
        width *= 2
    return mix(h[:n]) if width == k else mix(_pair(h[:n], h[k - width : k - width + n]))


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the span ``a`` holds the bytes of the span ``b``, for each pair of spans."""
    size = a_end - a
    same = size == b_end - b
    at, live = 0, np.flatnonzero(same & (size > 0))
    reach = np.cumsum(size[live])
    while at < len(live):  # a bounded number of bytes at a time
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SEGMENT, side="right")))
        x, n = live[at:to], size[live[at:to]]
        if to == at + 1:
            same[x[0]] = np.array_equal(data[a[x[0]] : a_end[x[0]]], data[b[x[0]] : b_end[x[0]]])
        else:
            first = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(first, n)
            same[x] = np.logical_and.reduceat(data[np.repeat(a[x], n) + inside] == data[np.repeat(b[x], n) + inside], first)
        at = to
    return same


def first_equal(key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """For each span the first span with the same bytes (and the same ``apart``): equal keys are confirmed on the bytes."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else order
    out = np.empty(len(key), dtype=np.int64)
    out[order] = head
    again = order[~new]
    wrong = ~same_bytes(data, start[again], end[again], start[out[again]], end[out[again]])
    if apart is not None:
        wrong |= apart[again] != apart[out[again]]
    if wrong.any():  # two contents have one key: tell them apart by their bytes
        known: dict = {}
        for i in np.flatnonzero(np.isin(key, key[again[wrong]])).tolist():
            out[i] = known.setdefault((None if apart is None else int(apart[i]), data[start[i] : end[i]].tobytes()), i)
    return out


def window_ok(words: Words, k: int) -> np.ndarray:
    """Whether the window of ``k`` words that begins at each word stays in its text (one entry per window)."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    last = np.repeat(words.first[1:], words.counts)
    return np.arange(k, n + k) <= last[:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text at most (one row at least)."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text joined by one space: bytes, and where each word starts and ends in them."""
    length = words.end - words.start
    end = np.cumsum(length + 1)
    start = end - length - 1
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    if len(out):
        inside = np.ones(len(out), dtype=bool)
        inside[end - 1] = False
        out[inside] = words.data[~_IS_SEP[words.data]]
    return out, start, end - 1
