"""Ranked lexical search: MaxScore over blocks of documents, its bounds tightened by term-pair intersection lists.

Index. A task turns its documents into blocks of bounded size; a block has a row for each of its terms with the postings
(place of the document in the block, occurrences) and one row with the documents' ids and lengths. Nothing is
shuffled and texts are read once. Document frequencies, the number of documents and their length are sums over blocks.

Pairs. An item's terms, by falling weight, stand two and two in units. For every unit whose terms share documents of
a block the intersection list is worked out once and its size and joint maximum impact are kept as a table.

Search. In a block no document gets more from a unit than the greater of its terms' own maxima and the joint maximum,
which is mostly far less than the sum of both maxima. Units are read in the order of these bounds. Once the bounds of what is left
stay below the threshold, no new document can come in; the rest is looked up for candidates only, and these drop
out as soon as their score and what is left can't reach it. The threshold is the k-th best score so far: that
of a few blocks that are searched first, later the block's own. Dropped is only what stays strictly below, so the result is exact.

A block's answer to an item is k rows at most; they meet in two rounds, salted first, so no task gets the answers
of all blocks. Items come in blocks, too: a task holds one block of documents, and one of items.

Defined cases: null and empty texts have no terms, are not counted and never found; rows that repeat a doc_id are found each;
a row without a doc_id is found with a null one and comes last among equal scores; rows that repeat an item_id are one
item with the terms of all; items without an id are not searched for; items without terms, or whose terms no document has, have
no rows; an empty table on either side gives an empty result. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.llm.textkernel import text_bytes
from palimpsest.tables import materialize, table

TOP = 50
#: Texts and documents of a block; items of a block of items.
BLOCK_BYTES, BLOCK_DOCS, BLOCK_ITEMS = 8 << 20, 1 << 15, 256
#: Blocks searched first for thresholds: this many, and no more than an eighth of all.
FIRST_BLOCKS = 32
#: Units after which a block's own threshold is worked out anew.
STEP = 4
PIECE = 4 << 20
LAST_ID = np.iinfo(np.int64).max
INDEX_SCHEMA = "block long, term string, df long, docs binary, tfs binary, ids array<long>"

#: Bytes of terms: letters and digits, A-Z as a-z, and all beyond ASCII; others separate.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a text; long texts go piece by piece, cut between terms."""
    found: Counter = Counter()
    at, text = 0, text or b""
    while at < len(text):
        end = at + PIECE
        while end < len(text) and TERM_BYTES[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(TERM_BYTES).split())
        at = end
    return found


def _postings(block: int, ids: list, lengths: list[int], codes: list[np.ndarray], tfs: list[np.ndarray], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """A block's rows: its documents first (term null; tfs has the lengths), then each term's postings."""

    def rows(terms, df, docs, counts, ids):
        n = len(df)
        columns = [pa.array(np.full(n, block)), terms, pa.array(df, pa.int64()), docs, counts, ids]
        return pa.RecordBatch.from_arrays(columns, names=["block", "term", "df", "docs", "tfs", "ids"])

    length = pa.array([np.array(lengths, np.int32).tobytes()], pa.binary())
    yield rows(pa.nulls(1, pa.string()), [len(ids)], pa.nulls(1, pa.binary()), length, pa.array([ids], pa.list_(pa.int64())))
    if not vocabulary:
        return
    code = np.concatenate(codes)
    doc = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
    order = np.argsort(code, kind="stable")
    doc, tf = doc[order], np.concatenate(tfs)[order]
    df = np.bincount(code, minlength=len(vocabulary))
    edge = np.concatenate(([0], np.cumsum(df)))
    terms = list(vocabulary)
    for at in range(0, len(terms), 1 << 14):
        end = min(at + (1 << 14), len(terms))
        offsets = pa.py_buffer(((edge[at : end + 1] - edge[at]) * 4).astype(np.int32))
        docs, counts = (pa.Array.from_buffers(pa.binary(), end - at, [None, offsets, pa.py_buffer(np.ascontiguousarray(v[edge[at] : edge[end]]))]) for v in (doc, tf))
        yield rows(pa.array(terms[at:end], pa.binary()).cast(pa.string()), df[at:end], docs, counts, pa.nulls(end - at, pa.list_(pa.int64())))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task -> blocks. A block's number is that of its task and its own in it."""
    number = TaskContext.get().partitionId() << 32
    ids, lengths, codes, tfs, size, vocabulary = [], [], [], [], 0, {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            counts = term_counts(text)
            if not counts:
                continue
            ids.append(doc_id)
            lengths.append(counts.total())
            codes.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
            tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
            size += len(text)
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                yield from _postings(number, ids, lengths, codes, tfs, vocabulary)
                number += 1
                ids, lengths, codes, tfs, size, vocabulary = [], [], [], [], 0, {}
    if ids:
        yield from _postings(number, ids, lengths, codes, tfs, vocabulary)


@dataclass
class SearchIndex:
    """postings: block, term, df (documents of the block with it), docs, tfs; blocks: block, ids, lengths."""

    postings: DataFrame
    blocks: DataFrame
    n_docs: int
    n_terms: int
    n_blocks: int


def build_index(docs: DataFrame) -> SearchIndex:
    """The index of all rows of a table (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_index, INDEX_SCHEMA), "search-index")
    blocks = rows.where("term is null").select("block", "ids", F.col("tfs").alias("lengths"))
    counted = blocks.mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs"), F.sum("terms"), F.count("*")).first()
    return SearchIndex(rows.where("term is not null").select("block", "term", "df", "docs", "tfs"), blocks, counted[0] or 0, counted[1] or 0, counted[2])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.frombuffer(b, np.int32).astype(np.int64) for b in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in each], pa.int64()), pa.array([int(x.sum()) for x in each], pa.int64())], names=["docs", "terms"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for t in term_counts(text)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()).cast(pa.string())], names=["item_id", "term"])


def planned(index: SearchIndex, items: DataFrame) -> tuple[DataFrame, int]:
    """Per block of items and term: its weight w and the items that hold it with their unit there; and the number of blocks of items."""
    slim = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = materialize(slim.mapInArrow(_item_terms, "item_id long, term string").distinct(), "item-terms")
    blocks = -(-asked.select("item_id").distinct().count() // BLOCK_ITEMS) or 1
    df = index.postings.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df.select("term", weight.alias("w")), "term")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("w"), "term"))
    units = weighed.withColumn("place", place).withColumn("unit", F.expr("int((place - 1) div 2)"))
    units = units.withColumn("q", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    return units.groupBy("q", "term").agg(F.first("w").alias("w"), F.collect_list(F.struct("item_id", "unit")).alias("held")), blocks


class Block:
    """The asked terms of a block of documents: documents and weighted impacts of each, and each item's terms by unit."""

    def __init__(self, lists: pa.Table, lengths: bytes, n_docs: int, n_terms: int):
        length = np.frombuffer(lengths, np.int32).astype(np.int64)
        norm = 50 + (50 * length * n_docs) // n_terms
        self.size = len(length)
        self.docs, self.gain, self.items = {}, {}, {}
        for term, w, held, docs, tfs in zip(*(lists.column(c).to_pylist() for c in ("term", "w", "held", "docs", "tfs")), strict=True):
            doc, tf = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
            self.docs[term], self.gain[term] = doc, w * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
            for h in held:
                self.items.setdefault(h["item_id"], {}).setdefault(h["unit"], []).append(term)
        self.most = {t: int(g.max()) for t, g in self.gain.items()}

    def joint(self, a: str, b: str) -> tuple[int, int]:
        """Size and joint maximum impact of the intersection of two terms' documents."""
        _, x, y = np.intersect1d(self.docs[a], self.docs[b], assume_unique=True, return_indices=True)
        return len(x), int((self.gain[a][x] + self.gain[b][y]).max()) if len(x) else 0

    def best(self, item: int, k: int, threshold: int, joint: dict[tuple[str, str], int]) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores that may be among the k best and reach the threshold, ties included; postings that were read."""
        units = list(self.items[item].values())
        bound = np.array([max(*(self.most[t] for t in u), joint.get(tuple(sorted(u)), 0)) if len(u) > 1 else self.most[u[0]] for u in units], np.int64)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        score, candidates, read = np.zeros(self.size, np.int64), None, 0
        threshold = max(threshold, 1)
        for step, number in enumerate(order):
            if candidates is None and rest[step] < threshold:
                candidates = np.flatnonzero(score)
            if candidates is not None:
                if len(candidates) > k:
                    threshold = max(threshold, int(np.partition(score[candidates], -k)[-k]))
                candidates = candidates[score[candidates] + rest[step] >= threshold]
                if not len(candidates):
                    break
                for term in units[number]:
                    docs = self.docs[term]
                    at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                    hit = docs[at] == candidates
                    score[candidates[hit]] += self.gain[term][at[hit]]
                    read += int(hit.sum())
            else:
                for term in units[number]:
                    score[self.docs[term]] += self.gain[term]
                    read += len(self.docs[term])
                if step % STEP == STEP - 1 and self.size > k:
                    threshold = max(threshold, int(np.partition(score, -k)[-k]))
        if candidates is None:
            candidates = np.flatnonzero(score)
        if len(candidates) > k:
            threshold = max(threshold, int(np.partition(score[candidates], -k)[-k]))
        candidates = candidates[score[candidates] >= threshold]
        return candidates, score[candidates], read


def _pairs(n_docs: int, n_terms: int):
    """A block's lists and documents -> term, other, n_both, most_both of every unit of two terms that share documents."""

    def run(key: tuple, lists: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if len(lists) and len(block):
            b = Block(lists, block.column("lengths")[0].as_py(), n_docs, n_terms)
            units = {tuple(sorted(u)) for of in b.items.values() for u in of.values() if len(u) > 1}
            found = [(x, y, *shared) for x, y in sorted(units) if (shared := b.joint(x, y))[0]]
        columns = {"term": ([f[0] for f in found], pa.string()), "other": ([f[1] for f in found], pa.string()), "n_both": ([f[2] for f in found], pa.int64()), "most_both": ([f[3] for f in found], pa.int64())}
        out = {"q": pa.array([key[0].as_py()] * len(found), pa.int32()), "block": pa.array([key[1].as_py()] * len(found), pa.int64())}
        return pa.table(out | {c: pa.array(v, t) for c, (v, t) in columns.items()})

    return run


def _search(k: int, n_docs: int, n_terms: int):
    """A block's lists, documents, pairs and thresholds -> item_id, doc_id, score of the k best of each item."""

    def run(lists: pa.Table, block: pa.Table) -> pa.Table:
        items, ids, scores = [], [], []
        if len(lists) and len(block):
            row = {c: block.column(c)[0].as_py() for c in ("ids", "lengths", "pairs", "thresholds")}
            b = Block(lists, row["lengths"], n_docs, n_terms)
            joint = {(p["term"], p["other"]): p["most_both"] for p in row["pairs"] or ()}
            least = {t["item_id"]: t["score"] for t in row["thresholds"] or ()}
            order = np.array([LAST_ID if i is None else i for i in row["ids"]], np.int64)
            for item in b.items:
                docs, score, _ = b.best(item, k, least.get(item, 1), joint)
                first = np.lexsort((order[docs], -score))[:k]
                items += [item] * len(first)
                ids += [row["ids"][d] for d in docs[first]]
                scores.append(score[first])
        score = np.concatenate(scores) if scores else np.empty(0, np.int64)
        return pa.table({"item_id": pa.array(items, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _merged(answers: DataFrame, k: int, salts: int) -> DataFrame:
    """item_id, rank, doc_id, score of the k best answers of each item, in two rounds."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(salts))
    some = answers.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*best))).where(F.col("rank") <= k)
    ranked = some.select("item_id", "doc_id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(index: SearchIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank (from 1), doc_id, score; equal scores by doc_id."""
    plan, q = planned(index, items)
    lists = materialize(index.postings.drop("df").join(plan, "term"), "asked-lists")
    blocks = index.blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    asked = lists.groupBy("q", "block")
    schema = "q int, block long, term string, other string, n_both long, most_both long"
    pairs = materialize(asked.cogroup(blocks.groupBy("q", "block")).applyInArrow(_pairs(index.n_docs, index.n_terms), schema), "pair-lists")
    bounds = pairs.groupBy("q", "block").agg(F.collect_list(F.struct("term", "other", "most_both")).alias("pairs"))
    ready = materialize(blocks.join(bounds, ["q", "block"], "left"), "blocks-with-pairs")
    salts = int(index.n_blocks**0.5) + 1

    def answers(blocks: DataFrame, lists: DataFrame, thresholds: DataFrame) -> DataFrame:
        told = blocks.join(thresholds, "q", "left")
        found = lists.groupBy("q", "block").cogroup(told.groupBy("q", "block")).applyInArrow(_search(k, index.n_docs, index.n_terms), "item_id long, doc_id long, score long")
        return _merged(found, k, salts)

    thresholds = "array<struct<item_id: bigint, score: bigint>>"
    none = ready.select("q", F.lit(None).cast(thresholds).alias("thresholds")).limit(0)
    first = ready.select("block").distinct().orderBy(F.xxhash64("block"), "block").limit(max(1, min(FIRST_BLOCKS, index.n_blocks // 8)))
    first = materialize(first, "first-blocks")
    seen = materialize(answers(ready.join(first, "block", "left_semi"), lists.join(first, "block", "left_semi"), none), "first-answers")
    reached = seen.where(F.col("rank") == k).select("item_id", "score", F.pmod(F.xxhash64("item_id"), F.lit(q)).cast("int").alias("q"))
    return answers(ready, lists, reached.groupBy("q").agg(F.collect_list(F.struct("item_id", "score")).cast(thresholds).alias("thresholds")))


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: the 50 best of all documents for each benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
n AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total WHERE t IN (SELECT t FROM q) GROUP BY t, nd),
s AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN n USING (doc_id) CROSS JOIN total GROUP BY item_id, tf.doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
