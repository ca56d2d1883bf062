"""Benchmark decontamination by spaced-seed hashing.

Tokens are words, lower-cased, without marks at their ends. A mask covers a span of tokens and ignores
some of its positions; every position of every benchmark item and of every document is hashed under each
mask. A Bloom filter of the benchmark's hashes, the only thing that is broadcast, picks the document
positions that are worth joining, and all of them are joined with the benchmark's hashes. Each diagonal
that matches is then compared in full, and every overlap that tolerates substitutions is taken.

The masks lose no overlap: an overlap of 13 tokens or more with 80 % of them equal holds a stretch of 13, 15,
20 or 25 tokens with 2, 3, 4 or 5 unequal ones at most (one of 26 or more has a half that is as good), and
each way to place those leaves one of the masks whole. Items below 13 tokens have masks of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.textkernel import Words, mix, odd_constants, slices
from palimpsest.tables import materialize, table

#: Fixed masks: 1 takes part, 0 is ignored. Together they lose no overlap of LEAST_WORDS and LEAST_PERCENT or more.
MASKS = ("1111011", "110100010011", "110101011", "1110111")
LEAST_WORDS, LEAST_PERCENT = 13, 80
#: Bits of the Bloom filter as powers of two, and bits for each seed between them; a full filter only joins more.
LEAST_BLOOM_BITS, MOST_BLOOM_BITS, BITS_PER_SEED, BLOOM_HASHES = 20, 28, 16, 3
MARKS = b" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ITEMS = "item_key binary, item_tokens array<long>, seed_hash array<long>, seed_at array<int>"
HITS = "doc_id long, text_key binary, tokens array<long>, hit_hash array<long>, hit_at array<int>"
OVERLAPS = "text_key binary, item_key binary, doc_start long, item_start long, n_tokens long, n_equal long"


MARK = np.isin(np.arange(256), list(MARKS))


def tokens_of(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The tokens of some texts, and their hashes: lower-cased words without marks at their ends."""
    words = Words.of(pc.utf8_lower(column)).trimmed(MARK)
    return words, words.hashes()


def short_masks(n: int, least_percent: int) -> list[str]:
    """Masks as long as a whole item of n tokens, one of which fits wherever least_percent percent are equal.

    The item is cut into more parts than there may be unequal tokens; each choice of so many parts is ignored.
    """
    wrong = n - -(-n * least_percent // 100)
    parts = min(n, wrong + 2) if n >= 8 else n
    edges = [n * i // parts for i in range(parts + 1)]
    return ["".join(("0" if i in gone else "1") * (edges[i + 1] - edges[i]) for i in range(parts)) for gone in combinations(range(parts), wrong)]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash under a mask at every position where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, xxhash.xxh3_64_intdigest(mask), np.uint64)
    for i, c in enumerate(odd_constants(len(mask), salt=5)):
        if mask[i] == "1":
            total += tokens[i : i + n] * c
    return mix(total)


def _slots(h: np.ndarray, which: int, bloom_bits: int) -> np.ndarray:
    return (mix(h + np.uint64(0x1234567 * which + 1)) >> np.uint64(64 - bloom_bits)).astype(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    ends = np.cumsum([0] + [len(x) for x in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _seeds_of(tokens: np.ndarray, masks) -> tuple[np.ndarray, np.ndarray]:
    found = [seed_hashes(tokens, mask) for mask in masks]
    at = [np.arange(len(h), dtype=np.int32) for h in found]
    return np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64), np.concatenate(at or [np.empty(0, np.int32)])


def _bench_items(least_words: int, least_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1), 1 << 20, 512):
                part = batch.slice(at, end - at)
                words, h = tokens_of(part.column(1))
                keys, out = [], []
                for key, w, n in zip(part.column(0).to_pylist(), words.first.tolist(), words.count.tolist(), strict=True):
                    if n:
                        masks = MASKS if n >= least_words else short_masks(n, least_percent)
                        keys.append(key)
                        out.append((h[w : w + n].view(np.int64), *_seeds_of(h[w : w + n], masks)))
                lists = [_lists([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *lists], names=["item_key", "item_tokens", "seed_hash", "seed_at"])

    return run


def _filter_words(bloom_bits: int):
    """Seed hashes -> the Bloom filter's 64-bit words and the bits to set in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            slot = np.unique(np.concatenate([_slots(h, k, bloom_bits) for k in range(BLOOM_HASHES)])) if len(h) else np.empty(0, np.int64)
            bits = (np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6, pa.int64()), pa.array(bits, pa.int64())], names=["word", "bits"])

    return run


def bloom_filter(seeds: DataFrame) -> np.ndarray:
    """The filter as a power of two of bits that fits the number of seeds; its words are put together in Spark."""
    bloom_bits = min(MOST_BLOOM_BITS, max(LEAST_BLOOM_BITS, (BITS_PER_SEED * seeds.count()).bit_length()))
    words = seeds.select("hash").mapInArrow(_filter_words(bloom_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (bloom_bits - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def _maybe_seeds(tokens: np.ndarray, left: np.ndarray, mask: str, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes under a mask that the Bloom filter lets through; left: tokens from a position to its text's end."""
    bloom_bits = (64 * len(bits)).bit_length() - 1
    h = seed_hashes(tokens, mask)
    at = np.flatnonzero(left[: len(h)] >= len(mask))
    for k in range(BLOOM_HASHES):
        slot = _slots(h[at], k, bloom_bits)
        at = at[(bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1]
    return at, h[at]


def _find_hits(shared, masks):
    """Texts with seeds that the filter lets through. The texts of a piece of a batch are hashed as one row of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            for at, end in slices(batch.column(1), 1 << 20, 512):
                part = batch.slice(at, end - at)
                words, tokens = tokens_of(part.column(1))
                found = [_maybe_seeds(tokens, words.left, mask, bits) for mask in masks]
                spot, h = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(2))
                text = words.text[spot]
                order = np.argsort(text, kind="stable")
                spot, h, text = spot[order], h[order].astype(np.uint64).view(np.int64), text[order]
                hit, start = np.unique(text, return_index=True)
                ends = np.append(start, len(text)).astype(np.int32)
                columns = [
                    part.column(0).take(pa.array(hit)),
                    part.column(2).take(pa.array(hit)),
                    _lists([tokens[words.first[i] : words.first[i] + words.count[i]].view(np.int64) for i in hit.tolist()], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(h)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((spot - words.first[text]).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "tokens", "hit_hash", "hit_at"])

    return run


def overlaps_on(same: np.ndarray, least_words: int, least_percent: int) -> list[tuple[int, int, int]]:
    """(start, length, equal tokens) of every overlap on a diagonal, given which of its tokens are equal.

    An overlap begins and ends with an equal token, has least_words tokens or more with least_percent percent
    equal, and is part of no other.
    """
    total = np.concatenate(([0], np.cumsum(np.where(same, 100, 0) - least_percent)))
    ends = np.flatnonzero(same) + 1
    starts = ends - 1
    if not len(ends):
        return []
    best = np.maximum.accumulate(total[ends][::-1])[::-1]  # falls, so the last end that still reaches a start's total is found by bisection
    last = ends[np.maximum(len(ends) - 1 - np.searchsorted(best[::-1], total[starts]), 0)]
    before = np.concatenate(([0], np.maximum.accumulate(last)[:-1]))
    told = (last - starts >= least_words) & (last > before)
    n_equal = np.concatenate(([0], np.cumsum(same)))
    return [(s, e - s, int(n_equal[e] - n_equal[s])) for s, e in zip(starts[told].tolist(), last[told].tolist(), strict=True)]


def _verify(least_words: int, least_percent: int):
    """The aligned tokens of an item and a text on a diagonal -> their overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys = (batch.column(i).to_pylist() for i in range(4))
            sides = (batch.column(i) for i in (4, 5))
            for text_key, item_key, n, shift, ours, theirs in zip(*keys, *sides, strict=True):
                lo = max(0, shift)
                same = ours.values.to_numpy(zero_copy_only=False) == theirs.values.to_numpy(zero_copy_only=False)
                if n < least_words:  # a short item is compared as a whole
                    whole = len(same) == n and 100 * int(same.sum()) >= least_percent * n
                    found = [(0, n, int(same.sum()))] if whole else []
                else:
                    found = overlaps_on(same, least_words, least_percent)
                out += [(text_key, item_key, lo + start, lo + start - shift, length, equal) for start, length, equal in found]
            names = ["text_key", "item_key", "doc_start", "item_start", "n_tokens", "n_equal"]
            kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """Overlaps of documents with benchmark items: at least least_words tokens (or a whole shorter item), of
    which least_percent percent are equal in place.

    Returns doc_id, text_key (128 bits of a hash of the text), item_id, doc_start, item_start, n_tokens, n_equal; one row
    per document row, item and place, and only for overlaps. A place is an overlap that begins and ends with an
    equal token and is part of no other on its diagonal; places may share tokens. The seeds lose nothing for
    least_words and least_percent of the default values or above.

    Defined cases: null and empty texts on either side have no overlap; a null doc_id or item_id is kept as
    it is; repeated rows are reported once; empty tables give an empty result. Only doc_id, text and item_id
    are read.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("item_key", text_key(F.col("text")))
    items = materialize(named.select("item_key", "text").dropDuplicates(["item_key"]).mapInArrow(_bench_items(least_words, least_percent), ITEMS), "benchmark-items")
    seeds = items.select("item_key", F.explode(F.arrays_zip("seed_hash", "seed_at")).alias("s")).select("item_key", F.col("s.seed_hash").alias("hash"), F.col("s.seed_at").alias("item_at"))
    shared = spark.sparkContext.broadcast(bloom_filter(seeds).tobytes())
    lengths = [r.n for r in items.select(F.least(F.size("item_tokens"), F.lit(least_words)).alias("n")).distinct().collect()]
    masks = [m for n in sorted(lengths) for m in (MASKS if n >= least_words else short_masks(n, least_percent))]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    hits = materialize(slim.withColumn("text_key", text_key(F.col("text"))).mapInArrow(_find_hits(shared, masks), HITS), "seed-hits")
    spots = hits.select("text_key", "hit_hash", "hit_at").dropDuplicates(["text_key"]).select("text_key", F.explode(F.arrays_zip("hit_hash", "hit_at")).alias("h"))
    spots = spots.select("text_key", F.col("h.hit_hash").alias("hash"), F.col("h.hit_at").alias("at"))
    met = spots.join(seeds, "hash").select("text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    sides = met.join(items.select("item_key", "item_tokens"), "item_key").join(hits.select("text_key", "tokens").dropDuplicates(["text_key"]), "text_key")
    length = F.least(F.size("tokens"), F.col("shift") + F.size("item_tokens")) - F.greatest(F.lit(0), "shift")
    ours, theirs = F.slice("tokens", F.greatest(F.lit(0), "shift") + 1, length), F.slice("item_tokens", F.greatest(F.lit(0), -F.col("shift")) + 1, length)
    sides = sides.select("text_key", "item_key", F.size("item_tokens").cast("long").alias("n"), F.col("shift").cast("long").alias("shift"), ours.alias("ours"), theirs.alias("theirs"))
    found = sides.mapInArrow(_verify(least_words, least_percent), OVERLAPS)
    told = found.join(named.select("item_id", "item_key").distinct(), "item_key").join(hits.select("doc_id", "text_key").distinct(), "text_key")
    return told.select("doc_id", "text_key", "item_id", "doc_start", "item_start", "n_tokens", "n_equal")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without any overlap; rows are matched by doc_id and text, nulls included."""
    found = materialize(find_overlaps(docs, benchmark).select("doc_id", "text_key").distinct(), "contaminated")
    bad = found.select(F.col("doc_id").alias("__bad_id"), F.col("text_key").alias("__bad_key"))
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (text_key(docs["text"].cast("string")) == bad["__bad_key"])
    return docs.join(bad, same, "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All overlaps of the whole documents table with the whole benchmark table."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
