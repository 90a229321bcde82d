"""Vectorised text kernel shared by the corpus operators.

Texts of one Arrow batch are laid end to end as UTF-8 bytes; words, word hashes and
hashes of word n-grams come from whole-array numpy operations, so no Python code runs
per word.  All hashes are deterministic across processes and machines.

Everything here works on bounded pieces (`pieces`), so that memory does not follow the
size of a partition: a piece holds about `PIECE` bytes, or one longer text.
"""

from __future__ import annotations

import contextlib
import gc

import numpy as np

PIECE = 2_000_000
_P = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = (~SPACE).astype(np.uint8)
#: Bytes to themselves, A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> None:
    """Powers of an odd base and of its inverse modulo 2**64, up to n."""
    global _POW, _INV
    if len(_POW) >= n:
        return
    n = max(n, PIECE + PIECE // 2)
    with np.errstate(over="ignore"):
        _POW = np.cumprod(np.full(n, _P, np.uint64)) * np.uint64(pow(_P, -1, 2**64))
        _INV = np.cumprod(np.full(n, pow(_P, -1, 2**64), np.uint64)) * np.uint64(_P)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit scrambler (SplitMix64's output function)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pieces(texts, size: int = PIECE):
    """Split a sequence of texts (None: empty) into slices of about `size` bytes; yields (first index, list of bytes)."""
    first, held, room = 0, [], size
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and len(b) > room:
            yield first, held
            first, held, room = i, [], size
        held.append(b)
        room -= len(b) + 1
    if held:
        yield first, held


class Words:
    """Words of a list of byte texts.

    A word is a longest run of bytes of one kind other than 0.

    buf: all bytes, a line feed after each text; start, end: of each word in buf;
    doc: the index of its text; count: words of each text; first: its first word;
    at: where each text begins in buf.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if fold is not None:
            self.buf = fold[self.buf]
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.at = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if self.n else np.zeros(0, np.int64)
        of = np.zeros(len(self.buf) + 2, np.uint8)
        of[1:-1] = kind[self.buf]
        of[1 + self.at + lens] = 0
        change = of[1:] != of[:-1]
        self.start = np.flatnonzero(change & (of[1:] > 0))
        self.end = np.flatnonzero(change & (of[:-1] > 0))
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(np.concatenate([self.first, [len(self.start)]]))
        self.doc = np.repeat(np.arange(self.n), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        _powers(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _POW[: len(self.buf)], out=total[1:])
            return mix((total[self.end] - total[self.start]) * _INV[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, n: int) -> np.ndarray:
        """Word indices at which n consecutive words of one text start."""
        if len(self.start) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])


def ngram_hash(words: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the n word hashes that start at each index in `at`."""
    if not len(at):
        return np.zeros(0, np.uint64)
    q = np.uint64((0xD6E8FEB86659FD93 + 2 * seed * 0x632BE59BD9B4E019) % 2**64 | 1)
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = h * q + words[k : len(words) - n + 1 + k]
    return mix(h[at], seed)


def common(x: bytes, y: bytes, at: int = 0) -> int:
    """Length of the common prefix of x and y, of which `at` bytes are known."""
    n = min(len(x), len(y))
    if at < n and x[at] != y[at]:
        return at
    differ = int.from_bytes(x[at:n]) ^ int.from_bytes(y[at:n])
    return n - (differ.bit_length() + 7) // 8 if differ else n


@contextlib.contextmanager
def acyclic():
    """Python's search for reference cycles off: it would look through millions of small containers without any again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
