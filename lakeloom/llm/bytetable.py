"""A hash table of short byte strings whose lookups are vectorized: millions of words cost a few array passes."""

from __future__ import annotations

import numpy as np

#: Longest key: three 64-bit lanes, of which the last byte holds the length.
LONGEST = 23
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Odd multipliers of the mixing steps.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def padded(data: bytes) -> np.ndarray:
    """The bytes, and as many zeros as lanes() reads beyond them."""
    return np.frombuffer(data + bytes(32), np.uint8)


def lanes(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys (n, 3) of the strings at start; each has at most LONGEST bytes."""
    at_any = np.lib.stride_tricks.as_strided(buffer[:8].view(np.uint64), (len(buffer) - 7,), (1,))
    out = np.empty((len(start), 3), np.uint64)
    for j in range(3):
        out[:, j] = at_any[start + 8 * j] & _MASK[np.clip(length - 8 * j, 0, 8)]
    out[:, 2] |= length.astype(np.uint64) << np.uint64(56)
    return out


def _hash(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * _MIX[0]
    for j in (1, 2):
        h ^= h >> np.uint64(31)
        h += keys[:, j]
        h *= _MIX[j]
    h ^= h >> np.uint64(32)
    return h * _MIX[0]


class ByteTable:
    def __init__(self, room: int):
        """room: entries that fit."""
        self.bits = max(4, int(room * 2 - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((room, 3), np.uint64)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 for none."""
        slot = (_hash(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        entry = self.slots[slot]
        own, there = self.keys[entry], entry >= 0
        same = there & (own[:, 0] == keys[:, 0]) & (own[:, 1] == keys[:, 1]) & (own[:, 2] == keys[:, 2])
        out = np.where(same, entry, -1).astype(np.int64)
        left = np.flatnonzero(there & ~same)
        slot = (slot[left] + 1) & (len(self.slots) - 1)
        while len(left):
            entry = self.slots[slot]
            there = entry >= 0
            left, slot, entry = left[there], slot[there], entry[there]
            own, want = self.keys[entry], keys[left]
            same = (own[:, 0] == want[:, 0]) & (own[:, 1] == want[:, 1]) & (own[:, 2] == want[:, 2])
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Entries of keys that are all different and not in the table yet."""
        new = np.arange(self.size, self.size + len(keys))
        self.keys[new] = keys
        self.size += len(keys)
        slot, left = (_hash(keys) >> np.uint64(64 - self.bits)).astype(np.int64), new
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            placed = self.slots[slot] == left
            left, slot = left[~placed], (slot[~placed] + 1) & (len(self.slots) - 1)
        return new


def distinct(keys: np.ndarray) -> np.ndarray:
    """Places of one of each key."""
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(1)
    return order[new]


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] places, then the same for the next."""
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - length), length)
