"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed byte n-grams (with its borders) and of itself, a
text the mean of its words; a two-class softmax sits on top, and embeddings and softmax are trained
together. Misspellings share most n-grams, and so most of the vector, of the word they are made from.
Before training, the n-gram vocabulary is pruned to those whose share of documents differs most between the
classes, so that a few thousand labelled texts can't be learned by heart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.textkernel import slices
from palimpsest.llm.wordscores import letter_words, ngrams, text_scores, word_blocks
from palimpsest.tables import materialize, table

SIZES = (3, 4, 5, 6)
BUCKETS, DIM = 1 << 18, 8
#: The bounded training sample: at most so many labelled documents of each class, read whole.
MAX_LABELLED = 2000
#: Standard errors by which an n-gram's document shares must differ between the classes; n-grams that are kept whatever these are, and at most.
LEAST_Z, LEAST_KEPT, MOST_KEPT = 5.0, 256, 1 << 13
FOLDS = 5


def held_out(doc_id="doc_id"):
    """True for the fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def document_ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight), sparse: the mean over a document's words of each word's mean n-gram vector."""
    total = np.zeros(BUCKETS)
    times = Counter(words)
    for block in word_blocks(list(times)):
        owner, bucket = ngrams(block, SIZES, BUCKETS)
        share = np.array([times[w] for w in block], float) / np.bincount(owner, minlength=len(block)) / len(words)
        np.add.at(total, bucket, share[owner])
    found = np.flatnonzero(total)
    return found, total[found]


def informative(has: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Buckets whose share of documents differs most between the classes; has: documents by class and bucket, n: by class.

    All that differ beyond chance, but the LEAST_KEPT best in any case, as few labels can't tell chance, and no more than the
    MOST_KEPT best; of equals the lower bucket. Buckets that no document has, or all have, are never kept.
    """
    pooled = has.sum(axis=0) / n.sum()
    z = np.abs((has[1] / n[1] - has[0] / n[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n).sum() + 1e-9))
    best = np.argsort(-z, kind="stable")[:MOST_KEPT]
    best = best[z[best] > 0]
    return np.sort(best[: max(LEAST_KEPT, int((z[best] > LEAST_Z).sum()))])


def train(grams: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """Prune the vocabulary and learn from (bucket, weight) of each document -> (score of each bucket, bias)."""
    has = np.stack([np.bincount(np.concatenate([b for (b, _), y in zip(grams, labels, strict=True) if y == c]), minlength=BUCKETS) for c in (0, 1)])
    keep = informative(has, np.array([(labels == 0).sum(), (labels == 1).sum()], float))
    x = np.zeros((len(grams), len(keep)), np.float32)
    for row, (bucket, weight) in zip(x, grams, strict=True):
        place = np.searchsorted(bucket, keep)
        there = np.flatnonzero(bucket[np.minimum(place, len(bucket) - 1)] == keep)
        row[there] = weight[place[there]]
    return learn(x, keep, labels, shares)


def learn(x: np.ndarray, keep: np.ndarray, labels: np.ndarray, shares: np.ndarray, steps: int = 120, rate: float = 0.02, decay: float = 1e-2, seed: int = 0) -> tuple[np.ndarray, float]:
    """Train embeddings and softmax together with Adam on full batches -> (score of each bucket, bias).

    x: documents by kept buckets. shares: the classes' shares in the whole labelled table, to which the sample
    is weighted. The softmax of two classes needs the difference of its logits only, so the model folds into one
    weight per bucket.
    """
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    scale = 0.1 / (x.std(axis=0) + 1e-5)
    x *= scale
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((len(keep), DIM)) * 0.01).astype(np.float32)
    out = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.log(np.maximum(shares, 1e-4)).astype(np.float32)
    target = np.stack((labels == 0, labels == 1), axis=1).astype(np.float32)
    share = (shares / n)[labels.astype(int)].astype(np.float32)[:, None]
    params = [emb, out, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        hidden = x @ emb
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * share
        grads = [x.T @ (g @ out.T) + decay * emb / max(len(keep), 1), hidden.T @ g + 1e-4 * out, g.sum(axis=0)]
        for w, dw, mw, vw in zip(params, grads, m, v, strict=True):
            mw += 0.1 * (dw - mw)
            vw += 0.01 * (dw * dw - vw)
            w -= rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[keep] = (emb @ (out[:, 1] - out[:, 0])) * scale
    return weights, float(bias[1] - bias[0])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) -> (doc_id, toxic, buckets, weights) of the whole text, for texts with a word."""
    for batch in batches:
        for at, end in slices(batch.column(2), most_rows=64):
            part = batch.slice(at, end - at)
            rows = []
            for doc_id, toxic, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), letter_words(part.column(2)), strict=True):
                if words:
                    bucket, weight = document_ngrams(words)
                    rows.append((doc_id, toxic, bucket.astype(np.int32).tobytes(), weight.astype(np.float32).tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "toxic", "bucket", "weight"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by class and bucket, as one row."""
    has = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for toxic, bucket in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            has[toxic, np.frombuffer(bucket.as_py(), np.int32)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([has.tobytes()], pa.binary())], names=["has"])


def _kept(keep: np.ndarray):
    """Of each document the weights of the kept buckets, as a dense row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, weight in zip(batch.column(2), batch.column(3), strict=True):
                own, value, row = np.frombuffer(bucket.as_py(), np.int32), np.frombuffer(weight.as_py(), np.float32), np.zeros(len(keep), np.float32)
                _, a, b = np.intersect1d(own, keep, assume_unique=True, return_indices=True)
                row[b] = value[a]
                rows.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of labelled documents outside the held-out fold, each read whole.

    The sample is the first max_labelled documents of each class in the order of a hash of doc_id; of rows that
    repeat a doc_id the text with the least hash. Their n-grams stay in the shared folder: the driver gets the
    counts of documents by bucket (at most eight rows of 2 MB), then the kept buckets' weights (MOST_KEPT of each document at most). Class shares are
    counted over all labels. Without both classes every text scores near the label there is, or near 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(shares) < 2:
        return np.zeros(BUCKETS), 10.0 if 1 in shares else -10.0
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * max_labelled rows
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = slim.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = materialize(texts.mapInArrow(_grams, "doc_id long, toxic int, bucket binary, weight binary"), "toxicity-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return np.zeros(BUCKETS), -10.0
    has = sum(np.frombuffer(r.has, np.int32).reshape(2, BUCKETS) for r in sample.coalesce(8).mapInArrow(_counts, "has binary").collect())
    keep = informative(has, np.array([n[0], n[1]], float))
    rows = sorted(sample.mapInArrow(_kept(keep), "doc_id long, toxic int, x binary").collect(), key=lambda r: (r.doc_id, r.toxic))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), len(keep))
    total = shares[0] + shares[1]
    return learn(x, keep, np.array([r.toxic for r in rows]), np.array([shares[0] / total, shares[1] / total]))


def score_udf(weights: np.ndarray, bias: float):
    """Column function: text -> probability of label 1."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [text_scores(texts.slice(at, end - at), weights[:, None], SIZES)[0][:, 0] for at, end in slices(texts, 1 << 20)]
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(np.concatenate([*out, np.empty(0)]) + bias, -30, 30))))

    return F.arrow_udf("double")(score)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row of docs.

    Defined cases: null and empty texts score by the bias alone; null labels and
    doc_ids are not learned from, a null doc_id counts as not held out; repeated rows score alike; without
    labels of both classes every text gets the same score; an empty table gives an empty result.
    """
    weights, bias = fit(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_udf(weights, bias)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score the whole documents table, learning from labels.toxic outside the held-out fold."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
