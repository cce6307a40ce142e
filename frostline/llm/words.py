"""Words of raw UTF-8 text as 64-bit hashes, in whole-array steps."""

from __future__ import annotations

import numpy as np

SPACE = (32, *range(9, 14))
CHUNK = 1 << 20            # bytes hashed at once; a longer word makes its own chunk
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            ones = np.ones(max(n, 2 * len(self.up)), np.uint64)
            ones[0] = 1
            up, down = ones * self.base, ones * self.inverse
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_LETTERS, _WORDS = Powers(0xD1342543DE82EF95), Powers(0xA0761D6478BD642F)


class WordHasher:
    """Words between the bytes of ``gaps``, with A-Z as a-z if ``lower``."""

    def __init__(self, gaps: tuple[int, ...] = SPACE, lower: bool = False):
        self.gap = np.zeros(256, bool)
        self.gap[list(gaps)] = True
        letters = np.arange(256)
        if lower:
            letters[65:91] += 32
        self.letter = mix(np.arange(1, 257, dtype=np.uint64) * _M)[letters]

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (in bytes) and hash of every word, in order."""
        parts, a = [], 0
        while a < len(raw):
            b = self._cut(raw, a)
            start, end, found = self._chunk(raw[a:b])
            parts.append((start + a, end + a, found))
            a = b
        if len(parts) == 1:
            return parts[0]
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _cut(self, raw: np.ndarray, a: int) -> int:
        b = a + CHUNK
        if b >= len(raw):
            return len(raw)
        inside = np.nonzero(self.gap[raw[a:b]])[0]
        if len(inside):
            return a + int(inside[-1]) + 1
        while b < len(raw) and not self.gap[raw[b:b + CHUNK]].any():
            b += CHUNK
        after = np.nonzero(self.gap[raw[b:b + CHUNK]])[0]
        return b + int(after[0]) + 1 if len(after) else len(raw)

    def _chunk(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = self.gap[raw]
        edge = np.nonzero(gap[1:] != gap[:-1])[0]
        start, end = edge[0::2], edge[1::2]
        up, down = _LETTERS.to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letter[raw] * up[:-1], out=total[1:])
        return start, end, mix((total[end] - total[start]) * down[start])


def sums(words: np.ndarray) -> np.ndarray:
    """Running sums from which ``grams`` reads the hash of any run of words."""
    up, _ = _WORDS.to(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return total


def grams(total: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by the place of the first."""
    count = len(total) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    _, down = _WORDS.to(count)
    return mix((total[n:] - total[:count]) * down + np.uint64(n * int(_M) % (1 << 64)))


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x
