"""Words and word n-grams of a column of texts as arrays of 64-bit hashes.

Everything works on the bytes of an Arrow string column, a slice of at most ``SLICE`` bytes at a time (a longer
text is a slice of its own), so the memory of a task does not follow the size of its batch. A word's hash is a
polynomial of its bytes, taken from one running sum; an n-gram's hash is a sum of its words' hashes times odd
constants. All arithmetic is modulo 2**64 and both are finished by a bijective mix. Distinct words of one text meet
with a probability of about n * n / 2**65.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
BASE = 0x9E3779B97F4A7C15   # odd, so it has an inverse modulo 2**64
LONGEST = 64                # words of an n-gram


def lowered() -> np.ndarray:
    """Byte table: A-Z to a-z, all others unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lowered text: digits, a-z and all of non-ASCII."""
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    return keep


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    keep = np.ones(256, bool)
    keep[9:14] = keep[32] = False
    return keep


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIERS = mix(np.arange(1, LONGEST + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
TAGS = np.arange(LONGEST + 1, dtype=np.uint64) * MULTIPLIERS[-1]   # tell lengths of n-grams apart


class Powers:
    """Powers of ``BASE`` and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            self.up = np.ones(size, np.uint64)
            self.down = np.ones(size, np.uint64)
            self.up[1:], self.down[1:] = BASE, pow(BASE, -1, 1 << 64)
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``limit`` bytes, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


class Words:
    """Words of the rows of a slice: byte ranges, hashes, and the first word of each row (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, powers: Powers):
        self.data, base = lowered()[data[offsets[0]: offsets[-1]]], offsets - offsets[0]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = keep[self.data]
        edges = np.diff(inside)
        # a word ends where its row ends
        cuts = base[1:-1]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        self.start = np.sort(np.concatenate([np.flatnonzero(edges == 1), cuts]))
        self.end = np.sort(np.concatenate([np.flatnonzero(edges == -1), cuts]))
        up, down = powers.of(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + length * MULTIPLIERS[0])
        self.first = np.searchsorted(self.start, base)

    def __len__(self):
        return len(self.start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words and the index of their first word; runs do not cross rows."""
        count = max(0, len(self) - n + 1)
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total += self.hash[i: i + count] * MULTIPLIERS[i]
        left = np.repeat(self.first[1:], np.diff(self.first))[:count] - np.arange(count)
        at = np.flatnonzero(left >= n)
        return mix(total[at] + TAGS[n]), at

    def whole(self, row: int) -> np.uint64:
        """Hash of a row's words as one n-gram, for rows of fewer than ``LONGEST`` words."""
        words = self.hash[self.first[row]: self.first[row + 1]]
        total = (words * MULTIPLIERS[: len(words)]).sum(dtype=np.uint64)
        return mix(total + TAGS[[len(words)]])[0]


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct n-word shingles, sorted by hash; a row of fewer words has one of all its words."""
    grams, at = words.grams(n)
    bound = np.searchsorted(at, words.first)
    for row in range(len(words.first) - 1):
        have = words.first[row + 1] - words.first[row]
        if have >= n:
            found = np.sort(grams[bound[row]: bound[row + 1]])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif have:
            yield np.array([words.whole(row)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
