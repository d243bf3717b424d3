"""Content-defined anchors of byte windows (minimisers), vectorised.

Of the PART-byte strings in a window of `width` bytes, the one of least hash is
the window's anchor. Equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share theirs, so that windows are dealt out as runs:
maximal stretches of consecutive window starts with one anchor."""

from __future__ import annotations

import numpy as np

from changeloom.llm.common import mix

#: Bytes of an anchor; bits of a place in a block, the rest are the hash's.
PART, BITS = 50, 26
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def rolling(data: np.ndarray, width: int, table: np.ndarray = _TABLE) -> np.ndarray:
    """A mixed polynomial hash of each `width` consecutive bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * down, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * up[: n - width + 1])


def runs(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of all documents in data (document d is data[starts[d]:starts[d+1]]):
    first window start, number of windows, anchor place, anchor hash."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64)
    h = rolling(data, PART)
    place = np.empty(len(data) - width + 1, np.int64)
    span, block = width - PART + 1, 1 << BITS
    for a in range(0, len(place), block - span + 1):  # hash and place in 64 bits; blocks overlap by a window
        part = h[a : a + block]
        least = (part >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        n = len(part) - span + 1
        least = np.minimum(least[:n], least[span - size : span - size + n])
        place[a : a + n] = (least & np.uint64(block - 1)).astype(np.int64) + a
    at = np.arange(len(place))
    doc = np.searchsorted(starts, at, "right") - 1
    valid = np.flatnonzero(at + width <= starts[doc + 1])
    if not len(valid):
        return none, none, none, none.astype(np.uint64)
    place = place[valid]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)))
    first = np.flatnonzero(new)
    return valid[first], np.diff(np.concatenate((first, [len(valid)]))), place[first], h[place[first]]
