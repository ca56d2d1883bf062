"""Substring dedup with a log-structured fingerprint index.

Documents are cut into blocks by doc_id; each block is a batch that arrives after all earlier ones. A block's
distinct window fingerprints (48 bits of a hash), sorted, form immutable runs, one per fingerprint bucket. A
bucket merges its runs, those of history included, and tells each block by a bitmap which of its
fingerprints another run has too. These are only candidates: for them the block sends a second hash (64 bits,
other word hashes and other multipliers). Every bucket is then walked in block order: a block's run of second
hashes is merge-joined with the sorted levels of history, the verified hits go back as a bitmap, and what is
new becomes a level; levels of similar size are compacted into one. A window is removed only if both of its
hashes match: the first that of any other block, the second that of an earlier one. Words are not compared
letter by letter: two different windows of a bucket (about 4 million windows) pass for equal with a
probability of 4e6 / 2^64.

No row per window is ever shuffled: a run travels as one packed binary, so there is no hot key; a
passage that a third of all documents share is one fingerprint in each block's run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.textkernel import Words, covered, in_sorted, mix, runs, text_bytes
from palimpsest.tables import materialize, table

WINDOW = 13
#: Text of a block and windows of a bucket, in bytes: the least, and the most, which large inputs take so that runs stay long.
BLOCK_BYTES, MOST_BLOCK_BYTES = 2 << 20, 8 << 20
BUCKET_BYTES, MOST_BUCKET_BYTES = 32 << 20, 256 << 20
LEAST_BUCKETS = 128
#: Pieces of the id range that are planned for on the driver, besides ids whose repeated rows need blocks of their own.
MOST_PIECES = 4096
SHARED, SEEN, INDEX = 0, 1, 2
RUN_SCHEMA = "kind int, bucket int, block long, part int, fps binary, checks binary"
RESULT_SCHEMA = "doc_id long, copies long, n_words long, removed array<struct<start:int,end:int>>, kept_text string"
HISTORY = -(1 << 63)
FP_BYTES = 6


def packed(fps: np.ndarray) -> bytes:
    """Fingerprints of 48 bits as six bytes each."""
    return np.ascontiguousarray(fps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FP_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    cells = np.zeros((len(data) // FP_BYTES, 8), np.uint8)
    cells[:, :FP_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, FP_BYTES)
    return cells.view("<u8").ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "bucket", "block", "part", "fps", "checks"])


class _Block:
    """The words, window fingerprints and runs of one block's documents, in doc_id order."""

    def __init__(self, docs: pa.Table, width: int, buckets: int):
        docs = docs.take(pa.array(np.argsort(docs.column("doc_id").to_numpy(), kind="stable")))
        self.width, self.buckets = width, buckets
        self.doc_id = docs.column("doc_id").to_numpy().astype(np.int64)
        self.copies = docs.column("copies").combine_chunks() if "copies" in docs.column_names else pa.array(np.ones(len(docs), np.int64))
        self.texts = docs.column("text").combine_chunks()
        self.words = Words.of(self.texts)
        self.at, windows = self.words.windows(self.words.hashes(), width)
        self.windows = windows >> np.uint64(16)
        ordered = np.sort(self.windows)
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        self.fps = ordered[new]
        self.twice = np.diff(np.append(np.flatnonzero(new), len(ordered))) > 1
        self.runs = self._by_bucket(self.bucket(self.fps))

    def bucket(self, fps: np.ndarray) -> np.ndarray:
        return (mix(fps + np.uint64(7)) % np.uint64(self.buckets)).astype(np.int32)

    def _by_bucket(self, bucket: np.ndarray) -> dict[int, np.ndarray]:
        """Bucket -> positions of its members, in order."""
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        return dict(zip(found.tolist(), np.split(order, start[1:]), strict=True)) if len(found) else {}

    def shared(self, told: pa.Table) -> np.ndarray:
        """Which fingerprints other runs have too."""
        flags = np.zeros(len(self.fps), bool)
        for kind, bucket, data in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "fps")), strict=True):
            if kind == SHARED:
                run = self.runs[bucket]
                flags[run] = _flags(data, len(run))
        return flags

    def checks(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the windows whose fingerprint is picked, and their second hashes."""
        if not picked.any():
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(picked[np.searchsorted(self.fps, self.windows)])
        return at, self.words.windows(self.words.hashes(salt=1), self.width, salt=9)[1][at]

    def check_runs(self, at: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The sorted distinct second hashes, and per bucket the positions of its run among them."""
        distinct, first = np.unique(checks, return_index=True)
        return distinct, self._by_bucket(self.bucket(self.windows[at[first]]))


def _key(key: tuple) -> tuple[int, int]:
    return key[0].as_py(), key[1].as_py()


def _runs_of_block(width: int, buckets: int, with_checks: bool):
    """A block's runs of fingerprints; with_checks for an index: of pairs of both hashes."""

    def make(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs, width, buckets)
        rows = []
        if with_checks:
            at, checks = block.checks(np.ones(len(block.fps), bool))
            fps = block.windows[at]
            for bucket, run in block._by_bucket(block.bucket(fps)).items():
                rows.append((INDEX, bucket, HISTORY, 0, *_pairs(fps[run], checks[run])))
        else:
            rows = [(INDEX, bucket, *_key(key), packed(block.fps[run]), None) for bucket, run in block.runs.items()]
        return pa.Table.from_batches([_batch(rows)])

    return make


def _pairs(fps: np.ndarray, checks: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct pairs of both hashes."""
    order = np.lexsort((checks, fps))
    fps, checks = fps[order], checks[order]
    new = np.concatenate(([True], (fps[1:] != fps[:-1]) | (checks[1:] != checks[:-1])))
    return packed(fps[new]), checks[new].tobytes()


def _per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows that come in bucket order, bucket by bucket: (bucket, [(kind, bucket, block, part, fps, checks)])."""
    current, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if row[1] != current and rows:
                yield current, rows
                rows = []
            current = row[1]
            rows.append(row)
    if rows:
        yield current, rows


def _find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a bucket's runs -> per run a bitmap of the fingerprints that another run has; history also tells its second hashes."""
    for bucket, rows in _per_bucket(batches):
        found = [unpacked(r[4]) for r in rows]
        merged = np.concatenate([np.unique(f) if r[2] == HISTORY else f for f, r in zip(found, rows, strict=True)])
        merged.sort(kind="stable")
        twice = merged[1:][merged[1:] == merged[:-1]]
        out = []
        for (_, _, block, part, _, checks), fps in zip(rows, found, strict=True):
            flags = in_sorted(twice, fps)
            if not flags.any():
                continue
            if block == HISTORY:
                out.append((SEEN, bucket, block, part, None, np.unique(np.frombuffer(checks, np.uint64)[flags]).tobytes()))
            else:
                out.append((SHARED, bucket, block, part, _bits(flags), None))
        yield _batch(out)


def _checks_of_block(width: int, buckets: int):
    """A block's candidates -> its runs of second hashes."""

    def make(key: tuple, told: pa.Table, docs: pa.Table) -> pa.Table:
        rows = []
        if len(told) and len(docs):
            block = _Block(docs, width, buckets)
            distinct, by_bucket = block.check_runs(*block.checks(block.shared(told)))
            rows = [(SEEN, bucket, *_key(key), None, distinct[run].tobytes()) for bucket, run in by_bucket.items()]
        return pa.Table.from_batches([_batch(rows)])

    return make


def _merge_levels(levels: list[np.ndarray], factor: int = 3) -> None:
    """Compact the newest levels until each is more than factor times as long as the next."""
    while len(levels) > 1 and len(levels[-2]) <= factor * len(levels[-1]):
        last = levels.pop()
        levels[-1] = np.sort(np.concatenate((levels[-1], last)), kind="stable")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of second hashes in block order -> per run a bitmap of those that an earlier block has."""
    for bucket, rows in _per_bucket(batches):
        levels, waiting, at, out = [], [], None, []
        for _, _, block, part, _, data in rows:
            checks = np.frombuffer(data, np.uint64)
            if block != at:  # the parts of one block don't see each other
                for new in waiting:
                    levels.append(new)
                    _merge_levels(levels)
                at, waiting = block, []
            seen = np.zeros(len(checks), bool)
            for level in levels:
                seen |= in_sorted(level, checks)
            waiting.append(checks[~seen])
            if block != HISTORY and seen.any():
                out.append((SEEN, bucket, block, part, None, _bits(seen)))
        yield _batch(out)


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index runs in bucket order -> one sorted run of distinct pairs per bucket."""
    for bucket, rows in _per_bucket(batches):
        fps, checks = np.concatenate([unpacked(r[4]) for r in rows]), np.concatenate([np.frombuffer(r[5], np.uint64) for r in rows])
        yield _batch([(INDEX, bucket, HISTORY, 0, *_pairs(fps, checks))])


def _strip_block(width: int, buckets: int):
    def strip(key: tuple, told: pa.Table, docs: pa.Table) -> pa.Table:
        block = _Block(docs, width, buckets)
        shared = block.shared(told)
        at, checks = block.checks(shared | block.twice)
        among = shared[np.searchsorted(block.fps, block.windows[at])] if len(at) else np.empty(0, bool)
        distinct, by_bucket = block.check_runs(at[among], checks[among])
        seen = np.zeros(len(distinct), bool)
        for kind, bucket, data in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "checks")), strict=True):
            if kind == SEEN:
                run = by_bucket[bucket]
                seen[run] = _flags(data, len(run))
        # np.unique gives the first position; documents stand in doc_id order, so that is the smallest doc_id
        doc = block.words.text[block.at[at]]
        window_doc = block.doc_id[doc]
        _, first, inverse = np.unique(checks, return_index=True, return_inverse=True)
        gone = (window_doc[first][inverse] < window_doc) | in_sorted(distinct[seen], checks)
        flags = covered(block.at[at[gone]], width, len(block.words.at))
        n_gone = block.words.per_text(flags)
        removed, kept = [], []
        for text, lost, w, n in zip(text_bytes(block.texts), n_gone.tolist(), block.words.first.tolist(), block.words.count.tolist(), strict=True):
            words = (text or b"").split()
            own = flags[w : w + n] if lost else flags[:0]
            removed.append([{"start": s, "end": e} for s, e in runs(own)])
            kept.append(b" ".join([x for x, out in zip(words, own.tolist(), strict=True) if not out] if lost else words))
        return pa.table(
            {
                "doc_id": pa.array(block.doc_id, pa.int64()),
                "copies": block.copies,
                "n_words": pa.array(block.words.count, pa.int64()),
                "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return strip


def _by_bucket(index_runs: DataFrame, buckets: int) -> DataFrame:
    parts = min(buckets, int(index_runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index_runs.repartitionById(parts, F.expr(f"bucket % {parts}"))
    return dealt.sortWithinPartitions("bucket", "block", "part")


@dataclass(frozen=True)
class Plan:
    """How ids are dealt to blocks: pieces of the id range by lower edge, each cut into blocks of equal id ranges.

    A piece of one often repeated id is one block in several parts, dealt by text.
    """

    edges: np.ndarray
    step: np.ndarray
    n_blocks: np.ndarray
    parts: np.ndarray
    buckets: int

    def block_of(self):
        """Column function: doc_id -> (block, parts); blocks are numbered in the order of ids."""
        edges, step, n_blocks, parts = self.edges, self.step, self.n_blocks, self.parts
        base = np.cumsum(n_blocks) - n_blocks

        def place(ids: pa.Array) -> pa.Array:
            ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
            piece = np.maximum(np.searchsorted(edges, ids, side="right") - 1, 0)
            block = base[piece] + np.clip((ids - edges[piece]) // step[piece], 0, n_blocks[piece] - 1)
            return pa.StructArray.from_arrays([pa.array(block, pa.int64()), pa.array(parts[piece], pa.int32())], names=["block", "parts"])

        return F.arrow_udf("block long, parts int")(place)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def plan_blocks(docs: DataFrame, block_bytes: int | None = None, buckets: int | None = None) -> Plan:
    """Plan blocks of about block_bytes of text from the ids and bytes of all documents.

    Pieces of the id range hold about equal numbers of documents (quantiles), their bytes are counted, and a piece
    is cut into as many equal id ranges as its bytes need. An id whose repeated rows have more than two
    blocks' bytes is a piece of its own, in parts. There are no more of these ids than half as many as
    block_bytes go into all texts, and the driver holds some 60 bytes for each.
    """
    sized = _sizes(docs)
    whole = sized.agg(F.sum("bytes").alias("bytes"), F.min("doc_id").alias("lo")).first()
    total = whole["bytes"] or 0
    if whole.lo is None:
        one = np.ones(1, np.int64)
        return Plan(np.zeros(1, np.int64), one, one, one.astype(np.int32), buckets or LEAST_BUCKETS)
    block_bytes = block_bytes or min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, total >> 16))
    if buckets is None:
        bucket_bytes, buckets = min(MOST_BUCKET_BYTES, max(BUCKET_BYTES, total >> 16)), LEAST_BUCKETS
        while buckets * bucket_bytes < total * 8 // 6:
            buckets *= 2
    pieces = int(min(MOST_PIECES, max(1, total // block_bytes)))
    quantiles = sized.agg(F.percentile_approx("doc_id", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("q")).first().q if pieces > 1 else []
    repeated = sized.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > 2 * block_bytes))
    heavy = repeated.select("doc_id").toPandas()["doc_id"].to_numpy(np.int64)
    edges = np.unique(np.concatenate((np.array([whole.lo, *quantiles], np.int64), heavy, heavy + 1)))

    def piece(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.to_numpy(zero_copy_only=False).astype(np.int64), side="right") - 1, pa.int64())

    found = sized.groupBy(F.arrow_udf("long")(piece)("doc_id").alias("piece")).agg(F.sum("bytes").alias("bytes"), F.max("doc_id").alias("hi")).collect()
    size, high = np.zeros(len(edges), np.int64), edges.copy()
    for r in found:
        size[r.piece], high[r.piece] = r["bytes"], r.hi
    wanted = np.maximum(1, -(-size // block_bytes))
    alone = np.isin(edges, heavy)
    n_blocks = np.where(alone, 1, np.minimum(wanted, high - edges + 1))
    return Plan(edges, np.maximum(1, -(-(high - edges + 1) // n_blocks)), n_blocks, np.where(alone, wanted, 1).astype(np.int32), buckets)


def _blocks(docs: DataFrame, plan: Plan) -> DataFrame:
    """Rows (block, part, doc_id, text, copies). Equal rows of an id in parts are one row, as many as they are: they would all be dealt to one part.

    Without such an id there is no column copies, and every use of the rows has the same exchange.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    placed = ids.withColumn("at", plan.block_of()("doc_id"))
    part = F.pmod(F.xxhash64("text"), F.col("at.parts")).cast("int").alias("part")
    if (plan.parts == 1).all():
        return placed.select(F.col("at.block").alias("block"), part, "doc_id", "text")
    one = placed.where("at.parts = 1").select(F.col("at.block").alias("block"), part, "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    several = placed.where("at.parts > 1").groupBy("at", "doc_id", "text").agg(F.count("*").alias("copies"))
    return one.unionByName(several.select(F.col("at.block").alias("block"), part, "doc_id", "text", "copies"))


def index_runs(docs: DataFrame, plan: Plan, width: int = WINDOW) -> DataFrame:
    """The immutable sorted runs of all windows of docs, to be compacted into the history of later batches."""
    return _blocks(docs, plan).groupBy("block", "part").applyInArrow(_runs_of_block(width, plan.buckets, True), RUN_SCHEMA)


def compact_runs(runs_: DataFrame, buckets: int) -> DataFrame:
    """Merge all index runs of each bucket into one; the result is the history of later batches."""
    return _by_bucket(runs_, buckets).mapInArrow(_compact, RUN_SCHEMA)


def dedup_substrings(docs: DataFrame, width: int = WINDOW, history: DataFrame | None = None, plan: Plan | None = None) -> DataFrame:
    """Remove every word covered by a width-word window whose words also start in an earlier document.

    Earlier means a smaller doc_id, or any document behind `history`, the compacted runs of former
    batches (made with the same width and number of buckets). Windows are judged on the input. Returns one row
    per input row: doc_id, n_words, removed (word ranges, end exclusive) and kept_text (the kept words
    joined by one space).

    Defined cases: a null or empty text has no words; fewer words than width means no window; rows that
    repeat a doc_id don't count as earlier than each other, whatever their texts; a row without doc_id is
    never earlier than another and nothing is removed from it; an empty table gives an empty result. Only
    doc_id and text are read, so further columns may have any names.
    """
    plan = plan or plan_blocks(docs)
    buckets = plan.buckets
    key = ["block", "part"]
    blocks = _blocks(docs, plan)
    first = blocks.groupBy(*key).applyInArrow(_runs_of_block(width, buckets, False), RUN_SCHEMA)
    if history is not None:
        first = history.unionByName(first)
    told = materialize(_by_bucket(first, buckets).mapInArrow(_find_shared, RUN_SCHEMA), "shared-fingerprints")
    shared = told.where(F.col("kind") == SHARED)
    second = shared.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(_checks_of_block(width, buckets), RUN_SCHEMA)
    if history is not None:
        second = told.where(F.col("kind") == SEEN).unionByName(second)
    seen = _by_bucket(second, buckets).mapInArrow(_probe, RUN_SCHEMA)
    hits = shared.unionByName(seen)
    stripped = hits.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(_strip_block(width, buckets), RESULT_SCHEMA)
    if not (plan.parts == 1).all():
        stripped = stripped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy")
    stripped = stripped.drop("copies")
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    orphans = docs.where("doc_id is null").select(
        F.lit(None).cast("long").alias("doc_id"),
        F.coalesce(words, F.array().cast("array<string>")).alias("w"),
    ).select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("removed"),
        F.array_join("w", " ").alias("kept_text"),
    )
    return stripped.unionByName(orphans)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for the whole documents table."""
    result = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    return result.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 12)) AS p, ws FROM w WHERE len(ws) >= 13
), wins AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM starts
), firsts AS (SELECT win, min(doc_id) AS d FROM wins GROUP BY win),
bad AS (SELECT wins.doc_id, p FROM wins JOIN firsts USING (win) WHERE firsts.d < wins.doc_id),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(generate_series(p, p + 12)) AS q FROM bad) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE
    list_transform(list_filter(generate_series(1, len(ws)), lambda i: NOT list_contains(qs, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
