"""Words and shingles of whole Arrow batches as 64-bit hashes, by array operations.

A word's hash is a sum over its bytes of a table value for the byte times a power
for its place, so that all words of many texts are hashed at once and no cache of
words is held.  Texts are worked off in pieces of about ``PIECE`` bytes, cut at
white space, so memory does not grow with a text beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once, about; a longer word is hashed whole.
PIECE = 1 << 17

_U = np.uint64
_M1, _M2, _M3 = (_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = _RNG.integers(0, 1 << 63, dtype=np.uint64) * _U(2) + _U(1)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64), dtype=np.uint64)


def _kind(space: list[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes part words, and the value of each byte; ``lower``: A-Z count as a-z."""
    parts, value = np.zeros(256, bool), _BYTE.copy()
    parts[space] = True
    if lower:
        value[65:91] = value[97:123]
    return parts, value


#: Words between \x20 and \x09-\x0D, lower-cased; runs between spaces and newlines, as they are.
LOWER, PLAIN = _kind([0x20, *range(0x09, 0x0E)], True), _kind([0x20, 0x0A], False)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers; equal for equal ones only."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def _hash_piece(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    inside = ~parts[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds] = inside[bounds]
    letters = data[inside]
    first = np.flatnonzero(begins[inside])
    sizes = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    longest = int(sizes.max(initial=0))
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, _BASE, np.uint64), dtype=np.uint64)
    value = values[letters]
    value *= powers[place]
    sums = np.add.reduceat(value, first) if len(first) else np.empty(0, np.uint64)
    return mixed(sums + sizes.astype(np.uint64) * _M1), np.flatnonzero(begins), sizes


def hashed_runs(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of the words of ``data``, the places where they begin and their sizes;
    no word crosses a place in ``bounds`` (ascending)."""
    out: list[tuple] = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    low = 0
    while low < len(data):
        high = min(len(data), low + PIECE)
        if high < len(data):  # back to the last white space, or on to the next
            back = np.flatnonzero(parts[data[low:high]])
            if len(back):
                high = low + int(back[-1]) + 1
            while not len(back) and high < len(data):
                back = np.flatnonzero(parts[data[high : high + PIECE]])
                high += int(back[0]) + 1 if len(back) else min(PIECE, len(data) - high)
        x, y = np.searchsorted(bounds, (low, high))
        hashes, begins, sizes = _hash_piece(data[low:high], bounds[x:y] - low, parts, values)
        out.append((hashes, begins + low, sizes))
        low = high
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, nulls as empty texts, and the offsets of its texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words before each text."""
    data, at = text_bytes(texts)
    hashes, begins, _ = hashed_runs(data, at[:-1][at[:-1] < len(data)], *LOWER)
    return hashes, np.searchsorted(begins, at)


def by_bytes(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs [start, end) of rows with about ``most`` bytes of text, one row at least."""
    _, at = text_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, min(high, len(texts))
        low = high


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text its distinct ``k``-word shingles, as sorted 64-bit hashes; with
    fewer words the whole sequence is one, without words there is none."""
    words, before = word_hashes(texts)
    n = np.diff(before)
    out: list[np.ndarray] = []
    joined = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        joined = mixed(joined * _M1 + words[j : j + len(joined)])
    for a, many in zip(before[:-1].tolist(), n.tolist(), strict=True):
        if many >= k:
            own = np.sort(joined[a : a + many - k + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own if new.all() else own[new])
        elif many:
            one = np.full(1, many, np.uint64)
            for w in words[a : a + many]:
                one = mixed(one * _M1 + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out
