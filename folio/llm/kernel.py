"""Vectorised word and n-gram hashing over blocks of texts (numpy on UTF-8 bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time; bounds the temporary arrays (about 60 bytes a byte).
BLOCK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, BLOCK + 4096)
        for k, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(n, np.uint64(base))
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def word_table() -> np.ndarray:
    """Bytes that belong to words: digits, ASCII letters, and every byte of a non-ASCII character."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


WORD = word_table()


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` bytes each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of a block: their hashes, byte ranges, and the text that each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts) + b"\n"
        a = np.frombuffer(self.buf, np.uint8)
        inside = WORD[a]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        p, q = _power(len(a) + 1)
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[a] * p[: len(a)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))
        self.text_start = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        #: first word of each text, and one past the last
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words within one text, and the index of each one's first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(_P) + self.hash[k : k + m]
        at = np.flatnonzero(self.owner[:m] == self.owner[n - 1 :])
        return mix(h[at]), at
