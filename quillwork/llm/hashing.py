"""Words, shingles and minhashes of many texts at once, in numpy over Arrow buffers.

A word is `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Hashes have 64 bits; every
function here is a pure function of the bytes, so a repeated task gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 500_000  # text bytes hashed together, at some 50 bytes of memory a byte; a longer text is hashed alone

_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_EXACT, _BYTE = _BYTE, _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size < n:
            size = max(n, CHUNK_BYTES + 1)
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([one, np.cumprod(np.full(size, _BASE))])
                self.down = np.concatenate([one, np.cumprod(np.full(size, _INVERSE))])
        return self.up, self.down


_POWERS = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of about `size` bytes."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of each text's first word plus the total)."""
    if not data.size:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(data.size, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(data.size, bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = offsets[(offsets > 0) & (offsets < data.size)]
    before[inner] = True
    after[inner - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of the bytes in each of the spans, which are in order; A-Z count as a-z if `lower`."""
    if not starts.size:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(data.size)
    with np.errstate(over="ignore"):
        sums = np.cumsum((_BYTE if lower else _EXACT)[data] * up[: data.size])
        low = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return mix((sums[ends - 1] - low) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word plus the total)."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words; a text of fewer words is one shingle. Repeats are kept.

    Returns them with the index of each text's first shingle plus the total.
    """
    count = np.diff(first)
    total = words.size
    with np.errstate(over="ignore"):
        if total >= SHINGLE:
            grams = words[: total - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                grams = grams * _STEP + words[k : total - SHINGLE + 1 + k]
            owner_end = np.repeat(first[1:], count)[: grams.size]
            inside = np.arange(grams.size) + SHINGLE <= owner_end
            grams = mix(grams[inside])
            per = np.maximum(count - SHINGLE + 1, 0)
        else:
            grams, per = np.empty(0, np.uint64), np.zeros(len(count), np.int64)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if short.size:
            own = np.empty(short.size, np.uint64)
            for i, text in enumerate(short):
                value = np.uint64(count[text])
                for word in words[first[text] : first[text + 1]]:
                    value = value * _STEP + word
                own[i] = value
            at = np.cumsum(per)[short] - per[short]
            grams = np.insert(grams, at, mix(own ^ _STEP))
            per[short] = 1
    return grams, np.concatenate([[0], np.cumsum(per)])


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(data, offsets))


class MinHasher:
    """`functions` minhashes of shingle sets."""

    def __init__(self, functions: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.flip = random.integers(0, 1 << 63, functions, np.uint64)
        self.odd = random.integers(0, 1 << 63, functions, np.uint64) | np.uint64(1)

    def __call__(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Array of texts x functions; texts without shingles get zeros."""
        full = np.flatnonzero(np.diff(first) > 0)
        out = np.zeros((len(first) - 1, len(self.odd)), np.uint64)
        if full.size:
            starts = first[full]
            with np.errstate(over="ignore"):
                for k, (flip, odd) in enumerate(zip(self.flip, self.odd, strict=True)):
                    out[full, k] = np.minimum.reduceat((grams ^ flip) * odd, starts)
        return out


def combine(parts: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit key for each row of hashes."""
    with np.errstate(over="ignore"):
        key = np.full(parts.shape[0], np.uint64(salt))
        for k in range(parts.shape[1]):
            key = mix(key * _STEP + parts[:, k])
    return key


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of distinct hashes, whatever their order."""
    with np.errstate(over="ignore"):
        one = int(mix(grams).sum(dtype=np.uint64))
        two = int(mix(grams * _STEP + np.uint64(1)).sum(dtype=np.uint64))
    return one, two


def set_digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`set_digest` of many sets side by side, none of them empty; `first` is where each starts."""
    with np.errstate(over="ignore"):
        return np.add.reduceat(mix(grams), first), np.add.reduceat(mix(grams * _STEP + np.uint64(1)), first)


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as the signed integers that Spark has."""
    return values.view(np.int64)
