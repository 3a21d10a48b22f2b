"""Hashes of words and of runs of words, for many texts at once, as NumPy arrays.

Words are [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes. A word is mixed eight bytes at a time, its length included; a run of k
words is a polynomial of their hashes modulo 2**64, mixed once more.
"""

from __future__ import annotations

import hashlib

import numpy as np

_C1, _C2, _Q = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MASKS = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 8)] + [(1 << 64) - 1], np.uint64)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONG = 1024


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: start and end bytes in `data`, hashes, and `first`: each text's first word, and the
    number of all words at its end."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n" * 9
        buf = np.frombuffer(self.data, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begins)
        size = self.end - self.start
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(self.data, "<u8", 1), (len(self.data) - 7,), (1,))
        h = size.astype(np.uint64) * _Q
        at, todo = self.start, np.arange(len(size))
        left = size
        while len(todo):
            part = eight[at] & _MASKS[np.minimum(left, 8)]
            h[todo] = mix(h[todo] ^ part)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
            if len(todo) and (size[todo[0]] - left[0]) >= LONG:
                for i in todo.tolist():  # words of over LONG bytes: one digest each
                    h[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8).digest(), "little"))
                break
        self.hashes = h

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside a text, and where each text's runs begin (and their number)."""
        n = len(self.hashes)
        count = np.maximum(np.diff(self.first) - k + 1, 0)
        first = np.concatenate([[0], np.cumsum(count)])
        if n < k:
            return np.zeros(0, np.uint64), first
        h = self.hashes[: n - k + 1].copy()
        for j in range(1, k):
            h *= _Q
            h += self.hashes[j : n - k + 1 + j]
        whole = np.diff(self.first) >= k
        # a text's runs start at its first word and end k - 1 words before the next text's
        marks = np.zeros(n - k + 2, np.int64)
        np.add.at(marks, self.first[:-1][whole], 1)
        np.add.at(marks, self.first[1:][whole] - k + 1, -1)
        keep = np.cumsum(marks)[:-1] > 0
        return mix(h[keep]), first

    def whole(self, i: int) -> np.uint64:
        """Hash of text i's whole sequence of words."""
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in self.hashes[self.first[i] : self.first[i + 1]]:
                h = h * _Q + w
        return mix(np.array([h], np.uint64) ^ np.uint64(self.first[i + 1] - self.first[i]))[0]
