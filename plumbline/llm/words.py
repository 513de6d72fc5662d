"""Words and shingles of Arrow text columns as 64-bit hashes, by NumPy over whole batches.

Words are the maximal runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is a polynomial
over a random number per byte, taken from one running sum over the text, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_SEGMENT = 1 << 19
_U = np.uint64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES = _BYTES[_LOWER]  # upper and lower case have the same number
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def small(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of text in a column (a longer text is a slice of its own), so
    that arrays by word stay small however long the texts of a batch are."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each text's offsets in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_SEGMENT`` bytes that end at white space or at the end of a text."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + _SEGMENT, end)
        if stop < end:
            blanks = np.flatnonzero(_BLANK[data[at:stop]])
            ends = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            cut = max(at + int(blanks[-1]) + 1 if len(blanks) else at, ends)
            if cut <= at:  # a single word longer than a segment
                cut = int(offsets[np.searchsorted(offsets, at, "right")])
                for look in range(stop, cut, _SEGMENT):
                    more = np.flatnonzero(_BLANK[data[look:min(look + _SEGMENT, cut)]])
                    if len(more):
                        cut = look + int(more[0])
                        break
            stop = cut
        yield at, stop
        at = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words."""
    data, offsets = buffer_of(texts)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in _segments(data, offsets):
        piece = data[at:stop]
        word = ~_BLANK[piece]
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        edges = offsets[np.searchsorted(offsets, at, "left"):np.searchsorted(offsets, stop, "left")] - at
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        powers, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * powers[:len(piece)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * inverse[starts]
        hashes.append(mix(raw + (ends - starts).astype(np.uint64) * _U(_ODD)))
        places.append(starts + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def windows_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; runs across texts are for the caller to leave out."""
    n = max(0, len(words) - size + 1)
    total = words[:n].copy()
    for k in range(1, size):
        total *= _U(_ODD)
        total += words[k:k + n]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; a text of fewer words is one shingle, one without words none."""
    words, offsets = words_of(texts)
    windows = windows_of(words, size)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(windows[a:b - size + 1])
            if len(found) > 1:
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            yield found
        elif b > a:
            yield windows_of(np.concatenate((words[a:b], np.arange(1, size - (b - a) + 1, dtype=np.uint64))), size)
        else:
            yield words[a:a]
