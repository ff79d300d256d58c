"""Words of Arrow text columns as flat numpy arrays: byte spans and 64-bit hashes.

A batch of texts is one byte buffer; words are found by a table over byte values, so UTF-8 texts
need no decoding. Hashes are polynomial over the lower-cased (A-Z only) bytes, computed by prefix
sums in blocks of BLOCK bytes, then mixed; equal words have equal hashes everywhere. What a tokenizer or
a model says of a word is learned once for each different word and remembered, in bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For hashes that tell A-Z from a-z.
AS_IT_IS = np.arange(256, dtype=np.uint8)

#: Bytes of words split by blanks (all but 0x20 and 0x09-0x0D).
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of lower-case alphanumeric words: digits, a-z (A-Z once lower-cased) and everything from 0x80.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Tables:
    size = 0
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def least(cls, n: int) -> None:
        if n > cls.size:
            cls.size = max(n, BLOCK + 4096)
            cls.up, cls.down = _powers(_BASE, cls.size), _powers(pow(_BASE, -1, 1 << 64), cls.size)


def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one character (or byte) longer."""
    return ((h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(_BASE)) ^ (h >> np.uint64(29))


def step_one(h: int, c: int) -> int:
    """The same for one string."""
    return ((h ^ (c + 1)) * _BASE & _MASK) ^ (h >> 29)


_settled: list = []


def settle() -> None:
    """Fits a worker to the one core of its task: matrix products start no threads, whose idle ones would spin, and large arrays reuse memory rather than map it anew."""
    import ctypes
    import glob
    import os

    if _settled:
        return
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break
    libc = ctypes.CDLL(None)
    _settled.append(libc)
    if hasattr(libc, "mallopt"):  # glibc: M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
        libc.mallopt(-3, 1 << 25)
        libc.mallopt(-1, 1 << 26)


def tidy(run):
    """A task's function over batches that settles the worker first and gives freed memory back at the end: idle workers stay beside later stages."""

    def tidied(batches):
        settle()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Returns freed memory to the system."""
    settle()
    if hasattr(_settled[0], "malloc_trim"):
        _settled[0].malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each text's words begin among them (n + 1 values)."""
    inside = table[buf]
    first, last = np.empty_like(inside), np.empty_like(inside)
    if len(buf):
        first[0], last[-1] = inside[0], inside[-1]
        np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
        np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
        at = offs[:-1][offs[:-1] < offs[1:]]
        first[at] = inside[at]
        at = offs[1:][offs[:-1] < offs[1:]] - 1
        last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """One 64-bit hash for each word, over its bytes as `fold` maps them."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        s0 = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s0 + BLOCK, side="right")))
        n = int(ends[j - 1] - s0)
        _Tables.least(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        part = fold[buf[s0 : s0 + n]].astype(np.uint64)
        part += np.uint64(1)
        part *= _Tables.up[:n]
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = (sums[e] - sums[s]) * _Tables.down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes; of a shorter, non-empty text, the whole as one."""
    if len(h) == 0:
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, (k * 0x632BE59BD9B4E019) & _MASK, dtype=np.uint64)
    m = 1
    for i in range(k):
        m = (m * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & _MASK | 1
        out += h[i : len(h) - k + 1 + i] * np.uint64(m)
    return mix(out)


def cuts(offs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes of text each (a longer text stands alone)."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = j
    return out


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class Remembered:
    """What `learn` says of words, by their hash: a run of numbers for each.

    learn(words as bytes) -> (flat, sizes): the runs one after another and the length of each. `given` are
    (sorted hashes, flat, length of each run or of all) of words that need no learning. When more than `most` words or `long`
    numbers are held, only the given ones stay, so memory is bounded by these and a batch.
    """

    def __init__(self, learn, dtype, given: tuple[np.ndarray, np.ndarray, int | np.ndarray] | None = None, most: int = 1_500_000, long: int = 12_000_000):
        self.learn, self.most, self.long = learn, most, long
        self.given = given or (np.zeros(0, np.uint64), np.zeros(0, dtype), 1)
        self.forget()

    def forget(self) -> None:
        self.keys, self.flat, each = self.given
        self.sizes = np.full(len(self.keys), each)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, u)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == u if len(self.keys) else np.zeros(len(u), bool)

    def look_up(self, h: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, starts, sizes): for each hash the number of its run, and where in `flat` the runs are.

        spell(places) gives the words at some places of h as bytes.
        """
        u, first, which = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._find(u)
        if not known.all():
            if len(self.keys) - len(self.given[0]) + int((~known).sum()) > self.most or len(self.flat) - len(self.given[1]) > self.long:
                self.forget()
                at, known = self._find(u)
            flat, sizes = self.learn(spell(first[~known]))
            begin = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, flat])
            self.keys, self.starts, self.sizes = (np.insert(x, at[~known], y) for x, y in ((self.keys, u[~known]), (self.starts, begin), (self.sizes, sizes)))
            at = np.searchsorted(self.keys, u)
        return which, self.starts[at], self.sizes[at]


def speller(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = AS_IT_IS):
    """Gives words at places among these spans as bytes."""

    def spell(places: np.ndarray) -> list[bytes]:
        raw = fold[ragged(buf, starts[places], ends[places] - starts[places])].tobytes()
        at = np.concatenate([[0], np.cumsum(ends[places] - starts[places])]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    return spell
