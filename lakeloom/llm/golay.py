"""The binary [23, 12, 7] Golay code as a fuzzy hash.

The code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. All codewords within 4 bits
of a word number one (the word is within 2 of a codeword) or six. A word's keys are the indices of these
codewords: two words that differ in at most one bit share a key, as the codeword nearest to one (3 bits at most)
lies within 4 bits of the other.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0xC75
BITS, CHECK = 23, 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 leading bits, and for each syndrome the up to six error patterns of at most 4 bits (-1: none)."""
    rest = np.zeros(1 << (BITS - CHECK), np.int64)
    for i in range(len(rest)):
        r = i << CHECK
        for b in range(BITS - 1, CHECK - 1, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - CHECK)
        rest[i] = r
    errors = np.full((1 << CHECK, 6), -1, np.int64)
    count = np.zeros(1 << CHECK, np.int64)
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            e = sum(1 << b for b in at)
            s = int(rest[e >> CHECK]) ^ (e & ((1 << CHECK) - 1))
            if weight < 4 or errors[s, 0].item().bit_count() == 3:
                errors[s, count[s]] = e
                count[s] += 1
    return rest, errors


def keys(words: np.ndarray) -> np.ndarray:
    """Indices (word, 6) of the codewords within 4 bits; -1 fills up."""
    rest, errors = tables()
    e = errors[rest[words >> CHECK] ^ (words & ((1 << CHECK) - 1))]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> CHECK)
