"""Word kernels over Arrow string columns: byte positions and 64-bit hashes of all words of a block of texts, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that memory does not follow the size of an Arrow batch.
SLICE_BYTES = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Everything but ASCII letters, digits and bytes of other scripts.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (every input bit reaches every output bit)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256) * 2, _BASE, np.uint64)]))
    return _powers


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each; a longer text has a range of its own."""
    at = string_offsets(texts)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        yield begin, min(end, len(texts))
        begin = end


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null becomes the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def string_offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry for the end)."""
    at = string_offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_bounds(raw: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run without a ``gap`` byte; runs stop at the end of a text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; spans are in order, not empty and don't overlap."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    first = np.cumsum(length) - length
    shift = np.repeat(begin - first, length)
    place = np.arange(len(shift))
    values = _TABLE[raw[place + shift]]
    values *= powers(int(length.max()))[place - np.repeat(first, length)]
    return mixed(np.add.reduceat(values, first) + length.astype(np.uint64))


def words_per_text(begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the first word of each text (one more entry for the end)."""
    return np.searchsorted(begin, at)


def coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of first use, the code of each key, and where each distinct key is first used."""
    d = pa.array(keys).dictionary_encode()
    codes = d.indices.to_numpy()
    distinct = d.dictionary.to_numpy()
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(keys))[::-1]
    return distinct, codes, first
