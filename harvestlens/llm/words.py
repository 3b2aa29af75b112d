"""Words and word-run hashes of many texts at once, by numpy over their joined bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240611)
# One random odd-free 64-bit value for each byte, and odd multipliers for positions in a word and in a run of words.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
RUN_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Letters, digits and everything beyond ASCII make up words; the rest separates them.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    """step**i for i below n, modulo 2**64. Made anew each time: what a task keeps in its globals outlives it on the executor."""
    steps = np.full(n, step, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in lower-cased bytes."""
    inside = IN_WORD[raw]
    flips = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return flips[::2], flips[1::2]


@dataclass
class Words:
    """hash: a 64-bit hash of each word; text and line: the text and the line (over all texts) that each stands in;
    first_line: the first line of each text, and one entry more."""

    hash: np.ndarray
    text: np.ndarray
    line: np.ndarray
    first_line: np.ndarray


def split_words(texts: list[bytes]) -> Words:
    """Lower-cased words of all texts in order. Texts are joined by a line feed, so no word spans two."""
    joined = b"\n".join([*texts, b""])
    raw = LOWER[np.frombuffer(joined, np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    begin, end = edges(raw)
    up, down = _powers(STEP, len(raw) + 1), _powers(STEP_BACK, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:-1], out=total[1:])
    hashes = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    feeds = np.flatnonzero(raw == 10)
    line = np.searchsorted(feeds, begin)
    first_line = np.concatenate(([0], np.searchsorted(feeds, ends - 1) + 1))
    return Words(hashes, np.searchsorted(ends, begin, side="right"), line, first_line)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A rolling hash of each run of `length` words, whatever text it starts in."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * RUN_STEP + hashes[i : i + n]
    return mixed(out)
