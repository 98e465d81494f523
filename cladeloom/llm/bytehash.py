"""Hashes of words and of runs of words, straight from a text's bytes."""

from __future__ import annotations

import numpy as np

#: Odd multipliers: of bytes in a word, and of words in a run.
IN_WORD = 0xD6E8FEB86659FD93
IN_RUN = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes whose prefix sums are held together.
SEGMENT = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd multiplier modulo 2^64, and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, np.uint64(x)))])
                for x in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up, self.down

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hashes of values[start:end], equal for equal contents wherever they stand."""
        up, down = self.upto(len(values))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)])])
        return (sums[ends] - sums[starts]) * down[starts]


class ByteHasher:
    def __init__(self):
        self.in_word = Powers(IN_WORD)
        self.in_run = tuple(map(Powers, IN_RUN))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words data[start:end]; long texts in segments."""
        out, i = np.zeros(len(starts), dtype=np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
            first, last = starts[i], ends[j - 1]
            part = data[first:last].astype(np.uint64) + np.uint64(1)
            out[i:j] = self.in_word.spans(part, starts[i:j] - first, ends[i:j] - first)
            i = j
        return _mixed(out ^ (ends - starts).astype(np.uint64))

    def runs(self, hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """A mixed 64-bit hash of every run of ``length`` words."""
        n = len(hashes) - length + 1
        if n < 1:
            return hashes[:0]
        at = np.arange(n)
        return _mixed(self.in_run[which].spans(hashes, at, at + length))


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a text's words: what ASCII white space separates."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return data, *edges(~_SPACE[data])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    """The words, or those to keep, with one space between."""
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    out = np.append(data, np.uint8(32))
    out[ends] = 32
    # a word's mark runs one byte beyond it, over its space; a next word may begin right there
    cover = np.zeros(len(out) + 1, dtype=np.int8)
    cover[starts] += 1
    cover[ends + 1] -= 1
    return out[np.cumsum(cover[:-1], dtype=np.int8) > 0].tobytes()[:-1]
