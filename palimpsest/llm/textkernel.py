"""Vectorised helpers on words and their hashes, used inside Arrow batches.

Words are maximal runs of characters other than space and U+0009..U+000D. On UTF-8 bytes that is
exactly what bytes.split() yields, so a text is encoded once and split in C.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def odd_constants(n: int, salt: int = 0) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    steps = np.arange(1 + 1000 * salt, n + 1 + 1000 * salt, dtype=np.uint64)
    return mix(steps * GOLDEN) | np.uint64(1)


#: Bytes that a task's memory of words may take.
CACHE_BYTES, ENTRY_BYTES = 16 << 20, 200
#: Multipliers by the place of a byte in its word; later places are worked out.
PLACES = 4096
SPACE = np.isin(np.arange(256), (*range(9, 14), 32))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes that are hashed at once.
HASH_BYTES = 2 << 20


@lru_cache(maxsize=8)
def place_factors(salt: int) -> np.ndarray:
    """Multipliers of the first PLACES places of a word."""
    return far_factors(np.arange(PLACES), salt)


def far_factors(place: np.ndarray, salt: int) -> np.ndarray:
    return mix((place.astype(np.uint64) + np.uint64(1 + 1_000_000 * (salt + 1))) * GOLDEN) | np.uint64(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the texts' offsets in it; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of some texts as flat arrays.

    at, length: first byte and bytes of each word; count, first: words of each text, and the number of its first;
    left: words from each word to its text's end, itself included.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.solid = ~SPACE[data]
        start = self.solid.copy()
        start[1:] &= ~self.solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        start[inner] = self.solid[inner]  # a text's first byte begins a word, whatever the text before ends with
        self.at = np.flatnonzero(start)
        before = np.concatenate(([0], np.cumsum(self.solid, dtype=np.int64)))
        self.length = np.diff(before[np.append(self.at, len(data))])
        edge = np.searchsorted(self.at, offsets)
        self.count, self.first = np.diff(edge), edge[:-1]
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.left = np.repeat(edge[1:], self.count) - np.arange(len(self.at))

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*column_bytes(column))

    def trimmed(self, marks: np.ndarray) -> Words:
        """The words without marks (a table over bytes) at their ends; words of marks only are left out."""
        n = len(self.data)
        plain = self.solid & ~marks[self.data]
        spots = np.flatnonzero(plain)
        before = np.concatenate(([0], np.cumsum(plain, dtype=np.int64)))
        lo, hi = before[self.at], before[self.at + self.length]
        keep = hi > lo
        out = object.__new__(Words)
        out.data, out.at, out.text = self.data, spots[lo[keep]], self.text[keep]
        out.length = spots[hi[keep] - 1] - out.at + 1
        out.solid = np.cumsum((np.bincount(out.at, minlength=n + 1) - np.bincount(out.at + out.length, minlength=n + 1))[:n]) > 0
        out.count = np.bincount(out.text, minlength=len(self.count))
        out.first = np.cumsum(out.count) - out.count
        out.left = np.repeat(out.first + out.count, out.count) - np.arange(len(out.at))
        return out

    def cut(self, most: int) -> Words:
        """The words, those of more than most bytes cut into pieces that count as words; none is dropped."""
        if not len(self.at) or self.length.max() <= most:
            return self
        parts = -(-self.length // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        out = object.__new__(Words)
        out.data, out.solid, out.text = self.data, self.solid, np.repeat(self.text, parts)
        out.at = np.repeat(self.at, parts) + most * nth
        out.length = np.minimum(most, np.repeat(self.length, parts) - most * nth)
        out.count = np.bincount(out.text, minlength=len(self.count))
        out.first = np.cumsum(out.count) - out.count
        out.left = np.repeat(out.first + out.count, out.count) - np.arange(len(out.at))
        return out

    def blocks(self) -> Iterator[tuple[int, int]]:
        """(first, end) of runs of words of bounded bytes, but for single long words."""
        ends = np.cumsum(self.length)
        w = 0
        while w < len(ends):
            end = max(w + 1, int(np.searchsorted(ends, ends[w] + HASH_BYTES)))
            yield w, end
            w = end

    def hashes(self, salt: int = 0, table: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word: a sum of its bytes (mapped by table) times factors by place, mixed."""
        out = np.empty(len(self.at), np.uint64)
        factors = place_factors(salt)
        for w, end in self.blocks():
            lo, hi = self.at[w], self.at[end - 1] + self.length[end - 1]
            body = self.data[lo:hi][self.solid[lo:hi]]
            size = self.length[w:end]
            first = np.cumsum(size) - size
            place = np.arange(len(body)) - np.repeat(first, size)
            factor = factors[place] if size.max() <= PLACES else far_factors(place, salt)
            body = (body if table is None else table[body]).astype(np.uint64) + np.uint64(1)
            out[w:end] = mix(np.add.reduceat(body * factor, first) + size.astype(np.uint64))
        return out

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number per word over each text."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.first + self.count] - total[self.first]

    def windows(self, hashes: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of width consecutive words of a text."""
        at = np.flatnonzero(self.left >= width)
        return at, window_hashes(hashes, width, salt)[at] if len(at) else np.empty(0, np.uint64)

    def repeated(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Per text: words in windows of width words that are found twice or more in it."""
        at, found = self.windows(hashes, width)
        found = found ^ mix((self.text[at].astype(np.uint64) + np.uint64(1)) * GOLDEN)
        order = np.argsort(found)
        same = np.diff(found[order]) == 0
        if not same.any():
            return np.zeros(len(self.count), np.int64)
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return self.per_text(covered(at[order[twice]], width, len(self.at)))


def word_hashes(text: bytes | None, salt: int = 0, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of one text's words."""
    return Words(np.frombuffer(text or b"", np.uint8), np.array([0, len(text or b"")])).hashes(salt, table)


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of width consecutive words; empty when there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, c in enumerate(odd_constants(width, salt)):
        total += hashes[i : i + n] * c
    return mix(total)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, value by value and without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for value in chunk.cast(kind) if chunk.type != kind else chunk:
            yield value.as_py()


def slices(column: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 1024) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive pieces of a string column, of at most so many rows and, but for single long texts, bytes."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    at = 0
    while at < len(column):
        end = min(at + most_rows, int(np.searchsorted(size, size[at] + most_bytes, side="right")) - 1, len(column))
        end = max(end, at + 1)
        yield at, end
        at = end


def in_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = len(table) - 1
    return table[at] == values


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean per position 0..n-1: inside a window of the given width that starts at one of starts."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open (start, end) of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
