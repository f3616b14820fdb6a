"""Word shingles of many texts at once: ASCII letters lower-cased, words between the characters 0x20 and 0x09-0x0D."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5BD1E9955BD1E995
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; the tables of powers have this size whatever the texts.
BLOCK = 1 << 18


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to BLOCK."""
    out = []
    for base in (_BASE, _INVERSE):
        factors = np.full(BLOCK + 1, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base ** place before each place of at most BLOCK bytes, modulo 2 ** 64."""
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers()[0][: data.size], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words; of all words as one if there are fewer;
    none without words."""
    raw = [(x or "").encode().lower() for x in texts]
    out: list[np.ndarray] = []
    start = 0
    while start < len(raw):
        end, size = start, 0
        while end < len(raw) and (end == start or size + len(raw[end]) < 2 << 20):
            size += len(raw[end]) + 1
            end += 1
        out += _sets(raw[start:end], words)
        start = end
    return out


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for the bytes of each word; words stand in order. Equal words have equal hashes wherever they stand."""
    out = np.empty(begin.size, np.uint64)
    down, at = powers()[1], 0
    while at < begin.size:
        low = int(begin[at])
        stop = int(np.searchsorted(end, low + BLOCK, side="right"))
        if stop == at:  # longer than a block: the sums of its blocks, each moved to its place
            total = 0
            for place in range(low, int(end[at]), BLOCK):
                block = data[place : min(place + BLOCK, int(end[at]))]
                total += int(prefix_sums(block)[-1]) * pow(_BASE, place - low, 1 << 64)
            out[at] = np.uint64(total % (1 << 64))
            at += 1
            continue
        first, last = begin[at:stop] - low, end[at:stop] - low
        sums = prefix_sums(data[low : int(end[stop - 1])])
        out[at:stop] = (sums[last] - sums[first]) * down[first]
        at = stop
    return mixed(out + (end - begin).astype(np.uint64) * _ODD)


def _sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = word_hashes(data, begin, end)
    sizes = np.array([len(x) for x in raw], np.int64)
    edges = np.searchsorted(begin, np.append(np.cumsum(sizes + 1) - sizes, data.size))
    value = np.zeros(max(0, word.size - words + 1), np.uint64)
    for i in range(words):
        value = value * _ODD + word[i : i + value.size]
    value = mixed(value)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(value[a : b - words + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = one * _ODD + word[i]
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
