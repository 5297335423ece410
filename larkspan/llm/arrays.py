"""Numpy kernels over batches of texts: words by hash, grouped counts, bounded chunks. Runs on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd multiplier of the polynomial hash, its inverse modulo 2^64, and the multipliers of the finaliser (splitmix64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BLOCK = 1 << 18
#: By byte: what it counts in a hash, A-Z as a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        at = 1
        while at < size:
            more = min(at, size - at)
            have[at : at + more] = have[:more] * np.uint64(pow(base, at, 1 << 64))
            at += more
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def _blank(b: np.ndarray) -> np.ndarray:
    # bytes below 9 wrap round
    return (b == 32) | (b - np.uint8(9) <= 4)


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a block; A-Z count as a-z."""
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _blank(b)
    # words begin and end by turns
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[::2], edge[1::2]
    low = np.frombuffer(b.tobytes().translate(LOWER), np.uint8).astype(np.uint64)
    low += np.uint64(1)
    low *= powers(BASE, len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(low, out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(INVERSE, len(b) + 1)[first] + (last - first).astype(np.uint64)), first


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 `data` and the bytes at which they begin. Works in blocks that end at blanks."""
    b = np.frombuffer(data, np.uint8)
    hashes, firsts, at = [], [], 0
    while at < len(b):
        end = min(at + BLOCK, len(b))
        if end < len(b):
            window = b[at:end]
            blanks = np.flatnonzero(_blank(window))
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word longer than a block
                rest = b[end:]
                blanks = np.flatnonzero(_blank(rest))
                end = end + int(blanks[0]) + 1 if len(blanks) else len(b)
        h, f = _block(b[at:end])
        hashes.append(h)
        firsts.append(f + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def chunks(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list]]:
    """Ranges of a column of texts of about `most` bytes, one text at least, and these texts as UTF-8."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to, column.slice(at, to - at).cast(pa.binary()).to_pylist()
        at = to


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (strings or UTF-8) in order, and bounds: those of text i are hashes[bounds[i]:bounds[i+1]]."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    hashes, first = word_hashes(b"\n".join(raw))
    return hashes, np.searchsorted(first, starts)


class Recent:
    """Remembers the last keys, up to a number that bounds its memory."""

    def __init__(self, most: int = 100_000):
        self.now: set[int] = set()
        self.old: set[int] = set()
        self.most = most

    def new(self, key: int) -> bool:
        """Whether `key` hasn't been seen lately."""
        if key in self.now:
            return False
        was = key in self.old
        self.now.add(key)
        if 2 * len(self.now) > self.most:
            self.now, self.old = set(), self.now
        return not was


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of n (1 each) over equal ones."""
    if len(keys) == 0:
        return keys, np.empty(0, np.int64)
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at)


class Counter:
    """Counts by 64-bit key in bounded memory: hands out what it has when that exceeds `most` keys."""

    def __init__(self, most: int = 1_500_000):
        self.keys: list = []
        self.n: list = []
        self.size, self.most = 0, most

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys, n = summed(keys, n)
        self.keys.append(keys)
        self.n.append(n)
        self.size += len(keys)
        if self.size > self.most:
            keys, n = self._merged()
            if len(keys) > self.most // 2:
                yield keys, n
                self.keys, self.n, self.size = [], [], 0
            else:
                self.keys, self.n, self.size = [keys], [n], len(keys)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate(self.keys), np.concatenate(self.n))

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            yield self._merged()


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if len(table) == 0:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Index:
    """Sorted distinct 64-bit hashes with the place at which each range of their first bits begins, so that a search looks at a few
    neighbours in place of halving the whole table."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(table, np.uint64((1 << 64) - 1))  # no key is above the last
        self.size = len(table)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As find() of the table."""
        if not self.size:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self.first[(keys >> self.shift).astype(np.int64)]
        below = np.flatnonzero(self.keys[at] < keys)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < keys[below]]
        have = (self.keys[at] == keys) & (at < self.size)
        return np.minimum(at, self.size - 1), have
