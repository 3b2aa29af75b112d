"""The perfect binary Golay code of length 23: every 23-bit value lies within three bits of exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, DATA_BITS = 23, 12
# Fixed value: the code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainders() -> np.ndarray:
    """The remainder, modulo the generator, of each single bit."""
    out = []
    for i in range(LENGTH):
        r = 1 << i
        for bit in range(LENGTH - 1, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        out.append(r)
    return np.array(out, np.int64)


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    bit = _remainders()
    by_byte = []
    for start in (0, 8, 16):
        t = np.zeros(1, np.int64)
        for i in range(start, min(start + 8, LENGTH)):
            t = np.concatenate((t, t ^ bit[i]))
        by_byte.append(t)
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(LENGTH), weight):
            error[np.bitwise_xor.reduce(bit[list(places)])] = sum(1 << p for p in places)
    return by_byte, error


_BY_BYTE, _ERROR = _tables()


def decode(values: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword nearest to each 23-bit value."""
    rest = _BY_BYTE[0][values & 255] ^ _BY_BYTE[1][values >> 8 & 255] ^ _BY_BYTE[2][values >> 16]
    return (values ^ _ERROR[rest]) >> (LENGTH - DATA_BITS)


def near_indices(values: np.ndarray, bits: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The codeword indices of each value and of all values one bit away (in its low `bits`): six at most, as the code is
    perfect. Returns them sorted by row, shape (n, bits + 1), and which are the first of their kind in the row.

    If u and v differ in one bit at most, decode(v) is among the indices of u."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    found = np.sort(decode(values[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first
