"""Words of many texts at a time, as spans of one byte array and their hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word, and n + 1 offsets of texts into the words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~space
    begin = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    last = np.flatnonzero(solid & (edge[1:] | np.concatenate([space[1:], [True]])))
    return begin, last, np.searchsorted(begin, offsets)


def span_hashes(value: np.ndarray, begin: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of spans of value (one 64-bit number for each byte), mixed with their lengths."""
    return span_hash_lists((value,), begin, last, (base,))[0]


def span_hash_lists(values: tuple[np.ndarray, ...], begin: np.ndarray, last: np.ndarray, bases: tuple[int, ...]) -> list[np.ndarray]:
    """As span_hashes, for several values and bases of the same spans."""
    length = last - begin + 1
    if not len(length):
        return [np.zeros(0, np.uint64) for _ in values]
    longest = int(length.max())
    # the longest first, so that spans of more than k bytes stand at the front; 16 bits sort fastest
    order = np.argsort((longest - length).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
    start, size = begin[order], length[order]
    shorter = -size
    pairs = [(np.zeros(len(order), np.uint64), v, np.uint64(b)) for v, b in zip(values, bases)]
    for k in range(longest):
        n = int(np.searchsorted(shorter, -k, "left"))
        if n < 64 and k > 64:  # a few very long words: finish each at once
            for h, value, base in pairs:
                for w in range(n):
                    rest = value[start[w] + k : start[w] + size[w]]
                    powers = np.cumprod(np.full(len(rest), base, np.uint64))
                    tail = (rest * np.concatenate([powers[:-1][::-1], np.ones(1, np.uint64)])).sum(dtype=np.uint64, keepdims=True)
                    h[w : w + 1] = h[w : w + 1] * powers[-1:] + tail
            break
        at = start[:n] + k
        for h, value, base in pairs:
            h[:n] = h[:n] * base + value[at]
    out = []
    for h, _, _ in pairs:
        found = np.empty(len(order), np.uint64)
        found[order] = mix(h + size.astype(np.uint64))
        out.append(found)
    return out
