"""Words of whole texts as numpy arrays: where they are, and 64-bit hashes of them with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Random numbers for the bytes, and an odd base with its inverse modulo 2**64.
BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text that are worked on at once. Texts that are longer are cut between words.
CHUNK = 1 << 21

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[LOWER[data]] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, starts and ends of words, hashes of words, the texts' first words and one past the last) for a few texts at a time. A null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        data, at = whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        word = ~SPACE[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        begins[at[:-1][at[:-1] < len(data)]] |= word[at[:-1][at[:-1] < len(data)]]
        inner = at[1:][at[1:] > 0] - 1
        stops[inner] |= word[inner]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if len(data) <= 2 * CHUNK:
            hashes = _hashes(data, starts, ends)
        else:
            parts, k = [], 0
            while k < len(starts):
                to = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK, side="right")))
                parts.append(_hashes(data[starts[k] : ends[to - 1]], starts[k:to] - starts[k], ends[k:to] - starts[k]))
                k = to
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield first, data, starts, ends, hashes, np.searchsorted(starts, at)
        first = last


def shingle_sets(texts: pa.Array | pa.ChunkedArray, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words; of a shorter text, of all its words as one; none if it has no words."""
    for _, _, _, _, hashes, at in chunks(texts):
        n = max(0, len(hashes) - words + 1)
        shingles = np.zeros(n, dtype=np.uint64)
        for k in range(words):
            shingles = shingles * np.uint64(BASE) + hashes[k : k + n]
        shingles = mixed(shingles)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(shingles[a : b - words + 1])
            elif b > a:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        one = one * np.uint64(INVERSE) + h
                yield mixed(np.array([one], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
