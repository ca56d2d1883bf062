"""SimHash near-dedup: 64-bit fingerprints of word shingles, generalised pigeonhole search, grouping.

Generalised pigeonhole. The 64 bits are grouped into parts by correlation (bits that go together stand in one
part). If each part i gets a threshold t_i >= -1 with a sum of DISTANCE - parts + 1, two fingerprints within
DISTANCE differ in at most t_i bits of some part i; a part with -1 is left out. So a fingerprint probes, in each part, its own
value and all values within t_i bits, and misses none within DISTANCE, whatever thresholds it takes. Each takes those
with the fewest expected candidates, found by dynamic programming over the parts: a value that many fingerprints
share gets -1 or 0, a rare one more. The counts of frequent values are exact, other values count as
their average. All work is on distinct fingerprints, so copies meet once.

Candidates are verified in the join itself, which puts out links only. A fingerprint whose best thresholds still
cost more than BALL candidates sits in a crowd; crowds settle among themselves by meeting points instead: each puts out
itself and all values one bit away ("near") and all values two bits away within a half of the bits ("wide"). Any
two fingerprints within 3 bits meet at a value that one is near and the other near or wide to, and a value's near
ones are within 3 bits of all that it has. So linking all at a value to its least near one is exact and takes rows in
proportion to the crowd, however dense it is. A pair of one fingerprint in a crowd and one outside is found by the latter's probes.

Defined cases: null, empty and wordless texts have fingerprint 0 and are linked like any other; texts of fewer words
than a shingle are one shingle; rows that repeat a doc_id are judged each by its own text; rows without a doc_id link
others and get the least doc_id of their group, null where it has none; an empty table gives an empty result.
Only doc_id and text are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.minhash_dedup import components
from palimpsest.llm.textkernel import LOWER, Words, slices
from palimpsest.tables import discard, materialize, table

BITS, DISTANCE, SHINGLE_WORDS, SEED = 64, 3, 3, 42
#: Shingles that are counted at once; fingerprints whose thresholds are worked out at once.
BLOCK, BATCH = 1 << 15, 4096
#: A probed or indexed key costs as much as so many candidates in the join.
KEY_COST = 50
#: A value is frequent if more fingerprints than this, and more than a 65536th of all, share it: at most 65536 of each part.
FREQUENT = 32
#: Bits of a part within which a fingerprint may probe at most.
MOST_FLIPS = 2
HALF = BITS // 2
#: Keys by which a crowded fingerprint meets others.
BALL = 1 + BITS + 2 * comb(HALF, 2)


def fingerprints(column: pa.Array, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The SimHash of each text: a bit is set if more than half of its shingles' XXH64 have it."""
    w = Words.of(column)
    size = w.length + 1  # each word with a space after it
    end = np.cumsum(size)
    plain = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    spot = np.arange(int(w.length.sum())) + np.repeat(np.arange(len(w.at)), w.length)
    plain[spot] = LOWER[w.data[w.solid]]
    full = (w.left >= width) | ((w.count[w.text] < width) & (w.left == w.count[w.text]))
    first = np.flatnonzero(full)
    last = np.minimum(first + width, (w.first + w.count)[w.text[first]]) - 1
    doc, text = w.text[first], plain.tobytes()
    start, stop = (end - size)[first], end[last] - 1
    ones, n = np.zeros((len(column), BITS), np.int64), np.bincount(doc, minlength=len(column))
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        some = slice(at, at + BLOCK)
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.diff(doc[some], prepend=-1))
        ones[doc[some][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1)):
                found = fingerprints(batch.column(1).slice(at, end - at), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def signed(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_sign(width), "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together, summed over the fingerprints of a task."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        for at in range(0, len(bits), BLOCK):
            total += (bits[at : at + BLOCK].T @ bits[at : at + BLOCK]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "n"])


def correlations(distinct: DataFrame, size: int) -> np.ndarray:
    """Absolute correlation of each pair of bits over all distinct fingerprints (fp); only 64 x 64 sums reach the driver."""
    both = np.zeros(BITS * BITS)
    for r in distinct.select("fp").mapInArrow(_common, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[r.cell] = r.n
    share = both.reshape(BITS, BITS) / max(size, 1)
    alone = np.diag(share)
    spread = np.sqrt(alone * (1 - alone))
    scale = np.outer(spread, spread)
    return np.abs(np.divide(share - np.outer(alone, alone), scale, out=np.zeros_like(scale), where=scale > 1e-12))


def grouped_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in parts of (almost) equal width: each part starts with the closest pair left and takes the bit closest to it, again and again."""
    free, out = set(range(BITS)), []
    for part in range(parts):
        width = BITS // parts + (part < BITS % parts)
        own: list[int] = []
        while len(own) < width:
            if own:
                best = max(sorted(free), key=lambda b: together[b, own].sum())
            else:
                best = max(sorted(free), key=lambda b: max((together[b, o] for o in free if o != b), default=0.0))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def parts_for(size: int) -> int:
    """How many parts cost least for so many evenly spread fingerprints: keys to send against candidates to look at."""

    def cost(parts: int) -> float:
        units = DISTANCE + 1 - parts  # thresholds above 0 that must be dealt out
        probes = sum(sum(comb(BITS // parts, f) for f in range(1 + units // parts + (i < units % parts))) for i in range(parts))
        return KEY_COST * (parts + probes) + probes * size / 2 ** (BITS // parts)

    return min((4, 3, 2), key=cost)


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The number that the given bits of each fingerprint make."""
    out = np.zeros(len(fp), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def flips(width: int, most: int) -> list[np.ndarray]:
    """Masks of exactly 0, 1, .. most bits of a width."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], np.uint64) for k in range(most + 1)]


def _index(layout: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, bits in enumerate(layout):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(values(fp, bits).view(np.int64)), batch.column(0)], names=["part", "value", "fp"])

    return run


def costs(fp: np.ndarray, layout: list[list[int]], frequent: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected candidates, and keys to probe, of each fingerprint by part and threshold + 1 (0: the part is left out)."""
    candidates = np.zeros((len(fp), len(layout), MOST_FLIPS + 2))
    keys = np.zeros((len(layout), MOST_FLIPS + 2))
    for part, bits in enumerate(layout):
        known, count = frequent[part]
        usual = max(0.0, size - float(count.sum())) / 2.0 ** len(bits)
        own, so_far = values(fp, bits), np.zeros(len(fp))
        for t, masks in enumerate(flips(len(bits), MOST_FLIPS)):
            keys[part, t + 1] = keys[part, t] + len(masks)
            so_far = so_far + usual * len(masks)
            if len(known):
                for mask in masks:
                    near = own ^ mask
                    at = np.minimum(np.searchsorted(known, near), len(known) - 1)
                    so_far += np.where(known[at] == near, count[at] - usual, 0.0)
            candidates[:, part, t + 1] = so_far
    return candidates, keys


def thresholds(candidates: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest thresholds + 1 of each fingerprint and part, with the sum DISTANCE + 1, and their expected candidates.

    Dynamic programming: best[s] is the least cost of the parts so far with the sum s.
    """
    n, parts, most = candidates.shape
    price = candidates + KEY_COST * keys[None]
    best = np.full((n, DISTANCE + 2), np.inf)
    best[:, 0] = 0.0
    taken = np.zeros((parts, n, DISTANCE + 2), np.int8)
    for part in range(parts):
        fresh = np.full_like(best, np.inf)
        for total in range(DISTANCE + 2):
            for t in range(min(most - 1, total) + 1):
                cost = best[:, total - t] + price[:, part, t]
                better = cost < fresh[:, total]
                fresh[better, total] = cost[better]
                taken[part, better, total] = t
        best = fresh
    chosen, left, rows = np.zeros((n, parts), np.int64), np.full(n, DISTANCE + 1), np.arange(n)
    for part in reversed(range(parts)):
        chosen[:, part] = taken[part, rows, left]
        left = left - chosen[:, part]
    return chosen, np.take_along_axis(candidates, chosen[:, :, None], axis=2).sum(axis=(1, 2))


def _probe(layout: list[list[int]], frequent, size: int, ball: int):
    """Per fingerprint the keys (part, value) to look up; part -1 marks one that sits in a crowd."""

    def rows(part, value, fp):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64))], names=["part", "value", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(every), BATCH):
                fp = every[start : start + BATCH]
                chosen, expected = thresholds(*costs(fp, layout, known, size))
                crowded = expected > ball
                yield rows(-1, np.zeros(int(crowded.sum()), np.uint64), fp[crowded])
                for part, bits in enumerate(layout):
                    masks = flips(len(bits), MOST_FLIPS)
                    for t in range(1, MOST_FLIPS + 2):
                        some = fp[(chosen[:, part] == t) & ~crowded]
                        for piece in np.array_split(some, -(-len(some) * sum(map(len, masks[:t])) // (1 << 18)) or 1):
                            keys = values(piece, bits)[:, None] ^ np.concatenate(masks[:t])[None, :]
                            yield rows(part, keys.ravel(), np.repeat(piece, keys.shape[1]))

    return run


def _meeting_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near and wide values of crowded fingerprints."""
    one = np.concatenate(flips(BITS, 1))
    two = flips(HALF, 2)[2]
    masks = np.concatenate((one, two, two << np.uint64(HALF)))
    near = np.arange(len(masks)) < len(one)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(every), 256):
            fp = every[start : start + 256]
            columns = [(fp[:, None] ^ masks[None, :]).ravel().view(np.int64), np.repeat(fp, len(masks)).view(np.int64), np.tile(near, len(fp))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["point", "fp", "near"])


def crowd_links(crowd: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints (fp) among themselves that connect all within 3 bits of each other, and no others."""
    met = materialize(crowd.select("fp").mapInArrow(_meeting_points, "point long, fp long, near boolean"), "meeting-points")
    centers = met.where("near").groupBy("point").agg(F.min("fp").alias("center"))
    return met.join(centers, "point").where("fp <> center").select(F.col("fp").alias("a"), F.col("center").alias("b")).distinct()


def links(distinct: DataFrame, size: int, parts: int | None = None, ball: int = BALL) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp) that connect all within DISTANCE bits of each other, and no others."""
    spark = distinct.sparkSession
    layout = grouped_bits(correlations(distinct, size), parts or parts_for(size))
    index = distinct.select("fp").mapInArrow(_index(layout), "part int, value long, fp long")
    often = index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > max(FREQUENT, size >> 16)).toPandas()  # 65536 of each part at most
    frequent = []
    for part in range(len(layout)):
        own = often[often["part"] == part]
        known = own["value"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        frequent.append((known[order], own["n"].to_numpy(np.float64)[order]))
    probes = materialize(distinct.select("fp").mapInArrow(_probe(layout, spark.sparkContext.broadcast(frequent), size, ball), "part int, value long, fp long"), "probes")
    asked, there = probes.where("part >= 0").alias("p"), index.alias("x")
    apart = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("x.fp")))
    near = (F.col("p.part") == F.col("x.part")) & (F.col("p.value") == F.col("x.value")) & apart.between(1, DISTANCE)
    found = asked.join(there, near).select(F.col("p.fp").alias("a"), F.col("x.fp").alias("b"))
    return found.unionByName(crowd_links(probes.where("part < 0")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, parts: int | None = None, ball: int = BALL) -> DataFrame:
    """Every row with its fingerprint (16 hexadecimal digits) and component_id, the least doc_id reachable over links."""
    rows = materialize(signed(docs, width), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = materialize(links(distinct, distinct.count(), parts, ball), "simhash-links")
    groups = components(found).withColumnRenamed("node", "fp")
    placed = distinct.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "simhash-groups")
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    discard(found)
    return rows.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole documents table."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
