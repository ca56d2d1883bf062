"""Linear scores of texts through hashed byte n-grams, computed once per distinct word.

A text's feature vector is the mean over its words of each word's mean n-gram vector. A linear score
of that vector is then the mean over words of a per-word score, so a task scores each distinct word
once and adds up the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.llm.textkernel import CACHE_BYTES, ENTRY_BYTES, Words, column_bytes, far_factors, mix, odd_constants, text_bytes

#: Everything in ASCII but letters becomes a space; bytes of other letters stay.
LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
LETTER_TABLE = np.frombuffer(LETTERS_ONLY, np.uint8)
#: Bytes of words whose n-grams are worked out at once.
GRAM_BYTES = 1 << 18


#: A longer word counts as several of this length, so that one word's n-grams take bounded memory.
MOST_BYTES = 1 << 14


def in_pieces(words: list[bytes]) -> list[bytes]:
    """The words, those of more than MOST_BYTES bytes cut into pieces; none is dropped."""
    if max(map(len, words), default=0) <= MOST_BYTES:
        return words
    return [w[at : at + MOST_BYTES] for w in words for at in range(0, len(w), MOST_BYTES)]


def letter_words(column: pa.Array) -> list[list[bytes]]:
    """Per text its lower-cased words of letters."""
    return [in_pieces((t or b"").translate(LETTERS_ONLY).split()) for t in text_bytes(pc.utf8_lower(column))]


def word_blocks(words: list[bytes], most: int = 50_000) -> Iterator[list[bytes]]:
    """The words in blocks of bounded number and total length (but for a single long word)."""
    block, size = [], 0
    for word in words:
        block.append(word)
        size += len(word) + 2
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def mean_gram_vector(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """The mean over a text's words of each word's mean n-gram vector, dense; whole texts of any length."""
    out = np.zeros(buckets)
    distinct = Counter(words)
    for block in word_blocks(list(distinct)):
        owner, bucket = ngrams(block, sizes, buckets)
        times = np.array([distinct[w] for w in block], float)
        out += np.bincount(bucket, (times / np.bincount(owner, minlength=len(block)))[owner], buckets)
    return (out / max(len(words), 1)).astype(np.float32)


def ngrams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all byte n-grams of <word>, and of the word itself, hashed."""
    return framed_ngrams(np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8), np.array([len(w) + 2 for w in words], np.int64), sizes, buckets)


def framed_ngrams(framed: np.ndarray, length: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """As ngrams, of words in one array of bytes, each with its borders, and their lengths."""
    joined = framed.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(length)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(joined))  # bytes up to the word's end
    coef = odd_constants(max(sizes) + 1, salt=2)
    owners, found = [], []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n * 0x9E3779B1, np.uint64)
        for i in range(n):
            h += joined[at + i] * coef[i]
        owners.append(owner[at])
        found.append((mix(h) % np.uint64(buckets)).astype(np.int64))
    first = np.cumsum(length) - length
    place = np.arange(len(joined)) - np.repeat(first, length)
    whole = np.add.reduceat(joined * far_factors(place, 5), first)
    owners.append(np.arange(len(length)))
    found.append((mix(whole) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def text_scores(column: pa.Array, weights: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x outputs: means over a text's words of letters of each word's mean weight over its n-grams, number of words).

    Each distinct word of the column is worked out once; weights: buckets x outputs.
    """
    data, offsets = column_bytes(pc.utf8_lower(column))
    words = Words(LETTER_TABLE[data], offsets).cut(MOST_BYTES)
    out = np.zeros((len(column), weights.shape[1]))
    if not len(words.at):
        return out, words.count
    _, one, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    at, size = words.at[one], words.length[one]
    score = np.empty((len(one), weights.shape[1]))
    ends = np.cumsum(size + 2)
    w = 0
    while w < len(one):
        end = max(w + 1, int(np.searchsorted(ends, ends[w] + GRAM_BYTES)))
        length = size[w:end] + 2
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first, length)
        source = np.repeat(at[w:end] - 1, length) + place
        framed = words.data[np.clip(source, 0, len(words.data) - 1)]
        framed[first], framed[first + length - 1] = ord("<"), ord(">")
        owner, bucket = framed_ngrams(framed, length, sizes, len(weights))
        count = np.bincount(owner, minlength=end - w)
        for k in range(weights.shape[1]):
            score[w:end, k] = np.bincount(owner, weights[bucket, k], end - w) / count
        w = end
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(words.text, score[which, k], len(column)) / np.maximum(words.count, 1)
    return out, words.count


class WordScores(dict):
    """word -> row of a growing score table; new words are scored together when a batch is summed up."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], width: int, limit: int = CACHE_BYTES):
        super().__init__()
        self.score, self.width, self.limit = score, width, limit // (ENTRY_BYTES + 16 * width)
        self.new: list[bytes] = []
        self.rows = np.empty((0, width))

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Per text the (words x width) scores of its words, in order."""
        if len(self) > self.limit:
            self.clear()
            self.rows = np.empty((0, self.width))
        ids = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts]
        if self.new:
            self.rows = np.concatenate((self.rows, self.score(self.new)))
            self.new = []
        return [self.rows[i] for i in ids]


def word_scorer(weights: np.ndarray, sizes: tuple[int, ...]) -> Callable[[list[bytes]], np.ndarray]:
    """Scores (words x outputs): the mean over a word's n-grams of the rows of weights (buckets x outputs)."""

    def score(words: list[bytes]) -> np.ndarray:
        out = []
        for block in word_blocks(words):
            owner, bucket = ngrams(block, sizes, len(weights))
            count = np.bincount(owner, minlength=len(block))
            out.append(np.stack([np.bincount(owner, weights[bucket, k], len(block)) / count for k in range(weights.shape[1])], axis=1))
        return np.concatenate(out)

    return score
