"""Content-defined boundaries by a gear hash, for many texts at a time."""

from __future__ import annotations

import numpy as np

#: A fixed table of 256 random 32-bit values, made from a rule.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
#: The hash at a byte depends on this many bytes, itself included.
WINDOW = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over j < 32, by doubling the span five times."""
    h = GEAR[data]
    span = 1
    while span < WINDOW and len(h) > span:
        g = h.copy()
        g[span:] += h[:-span] << np.uint32(span)
        h, span = g, span * 2
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray, low: int, mean: int, high: int) -> list[list[int]]:
    """Chunk ends within each text (relative to its start, the last is its length; none for an empty text).

    Normalised chunking: between `low` and `mean` bytes a cut needs two more zero bits than 1/mean, after `mean`
    two fewer, and at `high` bytes a chunk ends anyway. As low >= 32, a cut depends only on bytes of its own chunk.
    """
    assert low >= WINDOW
    bits = max(3, int(np.log2(mean)))
    h = gear_hashes(data)
    loose = np.flatnonzero(h >> np.uint32(32 - bits + 2) == 0) + 1
    strict = (h[loose - 1] >> np.uint32(32 - bits - 2) == 0).tolist()
    loose = loose.tolist()
    out, k, n = [], 0, len(loose)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, start = [], a
        while b - start > low:
            floor, middle, last = start + low, start + mean, min(start + high, b)
            while k < n and loose[k] < floor:
                k += 1
            end, j = last, k
            while j < n and loose[j] < last:
                if strict[j] or loose[j] >= middle:
                    end = loose[j]
                    break
                j += 1
            k = j
            ends.append(end - a)
            start = end
        if start < b:
            ends.append(b - a)
        out.append(ends)
    return out
