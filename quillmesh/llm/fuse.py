"""Static binary-fuse filters of 64-bit keys: 3 places a key, 8-bit fingerprints, no false negatives."""

from __future__ import annotations

import math

import numpy as np


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed & ((1 << 64) - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three places a key, in consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, fingerprints) of distinct keys; equal keys count once, none is allowed."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    size = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, -(-round(n * size) // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15)
        place = _places(h, segment, segments)
        total = (segments + 2) * segment
        count = np.bincount(place.ravel(), minlength=total)
        whose = np.bincount(place.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=total).astype(np.int64)
        order: list[tuple[np.ndarray, np.ndarray]] = []
        alone = np.flatnonzero(count == 1)
        peeled = 0
        while len(alone):
            key, at = np.unique(whose[alone], return_index=True)
            order.append((key, alone[at]))
            peeled += len(key)
            touched = place[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(whose, touched, np.tile(key, 3))
            alone = np.unique(touched)
            alone = alone[count[alone] == 1]
        if peeled == n:
            break
        if seed % 20 == 0:
            segments += max(1, segments // 10)
    else:
        raise RuntimeError("no filter found")
    out = np.zeros(total, np.uint8)
    prints = _prints(h)
    for key, at in reversed(order):  # a key's other places are settled before its own
        three = out[place[:, key]]
        out[at] = prints[key] ^ three[0] ^ three[1] ^ three[2]  # its own place is still zero
    return seed, segment, segments, out.tobytes()


def contains(filter_: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 of others."""
    seed, segment, segments, data = filter_
    h = _mix(keys, seed * 0x9E3779B97F4A7C15)
    three = np.frombuffer(data, np.uint8)[_places(h, segment, segments)]
    return (three[0] ^ three[1] ^ three[2]) == _prints(h)
