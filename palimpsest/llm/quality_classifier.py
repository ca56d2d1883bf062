"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. The counts of all vote
patterns over the whole corpus (at most 3^labellers rows) go through expectation-maximisation, which
estimates each labeller's accuracy and the share of good documents without any gold label. The
posteriors then train a linear scorer on hashed features (n-grams of word shapes, and each measure's bin
as a token of its own), and the scorer decides. Every text is read whole, in training as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.textkernel import GOLDEN, Words, column_bytes, mix, slices, text_bytes
from palimpsest.llm.wordscores import WordScores, in_pieces, mean_gram_vector, word_scorer
from palimpsest.tables import table

#: The bounded training sample of the scorer: so many documents, those of the least hashes of id and text.
MAX_TRAIN = 3000
SIZES, BUCKETS = (1, 2, 3), 1 << 10
#: Buckets of the measures' bins, hashed like all else, and bins of a measure.
TAIL_BUCKETS, STAT_BINS = 1 << 9, 8
SYMBOLS = b"#*$%&|<>"
SHAPE = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256)
)
LABELLERS = ("symbols", "capitals", "repeats", "bare_marks", "exclamations", "top_word", "phrase_ends", "short_words", "long_repeats")


#: What a byte says of its word: lower case 1, upper case 2, letter or digit or beyond ASCII 4.
TELLS = np.array([(97 <= c <= 122) | (65 <= c <= 90) << 1 | (c >= 128 or chr(c).isalnum()) << 2 for c in range(256)], np.uint8)
SYMBOL, PHRASE_END, SHOUT = (np.isin(np.arange(256), list(marks)) for marks in (SYMBOLS, b".,;:?", b"!"))


def measures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts x nine measures that the labellers look at, words of each text); texts without words have zeros."""
    data, offsets = column_bytes(column)
    words = Words(data, offsets)
    n = np.maximum(words.count, 1)
    h = words.hashes()
    tells = np.bitwise_or.reduceat(TELLS[data] * words.solid, words.at) if len(words.at) else np.empty(0, np.uint8)
    short = words.length <= 3
    capitals = ((tells & 3) == 2) & (words.length > 1)
    phrase = PHRASE_END[data[words.at + words.length - 1]] if len(words.at) else short
    long_enough = words.count >= 20
    of_text = h ^ mix((words.text.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    order = np.argsort(of_text)
    ordered = of_text[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, words.text[order[new]], np.diff(np.append(new, len(ordered))))

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offsets[1:]] - total[offsets[:-1]]

    m = np.stack(
        [
            per_text(SYMBOL[data]) / n,
            words.per_text(capitals) / n,
            words.repeated(h, 5) / n,
            words.per_text(short & (words.length < 4) & (tells & 4 == 0)) / n,
            per_text(SHOUT[data]) / n,
            np.where(long_enough, top / n, 0.0),
            words.per_text(phrase) / n,
            np.where(long_enough, words.per_text(short) / n, 0.12),
            words.repeated(h, 10) / n,
        ],
        axis=1,
    )
    return m * (words.count > 0)[:, None], words.count


#: Per labeller: bad at or above, good at or below; too few short words are bad as well.
BAD_FROM = np.array([0.15, 0.4, 0.35, 0.15, 0.3, 0.15, 0.6, 0.9, 0.25])
GOOD_TO = np.array([0.04, 0.15, 0.1, 0.04, 0.1, 0.1, 0.4, 0.75, 0.05])


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 abstain, of the nine labellers (columns) on each text."""
    v = np.where(m >= BAD_FROM, 0, np.where(m <= GOOD_TO, 1, 2))
    v[:, 7] = np.where(m[:, 7] < 0.05, 0, np.where(m[:, 7] < 0.15, 2, v[:, 7]))
    return v


def _patterns(m: np.ndarray) -> list[str]:
    """Votes as text, one digit per labeller."""
    return (votes(m).astype(np.uint8) + 48).view(f"S{m.shape[1]}").ravel().astype(str).tolist() if len(m) else []


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Naive-Bayes EM over vote patterns -> (share of good, table P(vote | class) [class, labeller, vote], posterior of good)."""
    post = np.where((patterns == 0).any(axis=1), 0.1, 0.9)  # start: one bad vote makes a document doubtful
    onehot = patterns[:, :, None] == np.arange(3)
    share, tab = 0.5, None
    for _ in range(steps):
        w = np.stack((counts * (1 - post), counts * post))
        tab = (np.einsum("cp,pkv->ckv", w, onehot) + 1.0) / (w.sum(axis=1)[:, None, None] + 3.0)
        share = float(np.clip(w[1].sum() / counts.sum(), 1e-4, 1 - 1e-4))
        z = np.log(np.array([1 - share, share]))[:, None] + np.einsum("pkv,ckv->cp", onehot, np.log(tab))
        post = 1 / (1 + np.exp(np.clip(z[0] - z[1], -60, 60)))
    return share, tab, post


def _votes_udf():
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for at, end in slices(texts, 1 << 20):
                m, n = measures(texts.slice(at, end - at))
                out += [v if k else None for v, k in zip(_patterns(m), n.tolist(), strict=True)]
            yield pa.array(out, pa.string())

    return F.arrow_udf("string")(vote)


def _bins(m: np.ndarray) -> np.ndarray:
    """Which of STAT_BINS bins each measure falls in."""
    return np.minimum((np.sqrt(np.clip(m, 0.0, 1.0)) * STAT_BINS).astype(int), STAT_BINS - 1)


#: The bucket of each measure's bins.
TAIL = np.array([[xxhash.xxh3_64_intdigest(f"{name}:{b}") % TAIL_BUCKETS for b in range(STAT_BINS)] for name in LABELLERS])


def _tail(m: np.ndarray) -> np.ndarray:
    """The buckets of each text's measures (texts x measures)."""
    return TAIL[np.arange(len(LABELLERS)), _bins(m)]


def _shapes(text: bytes) -> list[bytes]:
    """The words with letters as A or a and digits as 0."""
    return in_pieces(text.translate(SHAPE).split())


def features(m: np.ndarray, text: bytes) -> np.ndarray:
    """A text's hashed feature vector: the mean n-gram vector of its word shapes, then the bins of its measures."""
    tail = np.bincount(_tail(m[None])[0], minlength=TAIL_BUCKETS).astype(np.float32)
    return np.concatenate((mean_gram_vector(_shapes(text), SIZES, BUCKETS), tail))


class Scorer:
    """A logistic scorer on hashed features."""

    def __init__(self, weights: np.ndarray, tail: np.ndarray, bias: float):
        self.weights, self.tail, self.bias = weights, tail, bias

    def score(self, column: pa.Array, known: WordScores) -> list[float]:
        """Probability of a good document, per text."""
        m, n = measures(column)
        bags = known.of([_shapes(t or b"") for t in text_bytes(column)])
        shape = np.array([s[:, 0].mean() if len(s) else 0.0 for s in bags])
        z = np.where(n > 0, shape + self.tail[_tail(m)].sum(axis=1) + self.bias, -30.0)
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def train(x: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels y, both classes weighted alike, by Adam."""
    x = x.astype(np.float64)  # once, not at every step
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).mean(), 0.02), 0.5 / max((y <= 0.5).mean(), 0.02))
    w, b, mw, mb, v = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        gw, gb = x.T @ g + 1e-4 * w, g.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        v = 0.99 * v + 0.01 * np.append(gw, gb) ** 2
        rate = 0.05 / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / (1 - 0.9**t)
        w, b = w - rate[:-1] * mw, b - rate[-1] * mb
    return w, float(b)


def _sample(texts: DataFrame, rate: float, max_train: int) -> tuple[list[str], np.ndarray]:
    """Vote patterns and features of the max_train documents with the least hash; rate leaves a few more to choose from."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in slices(batch.column(1), 1 << 20):
                part = batch.slice(at, end - at)
                m, n = measures(part.column(1))
                found = zip(part.column(0).to_pylist(), _patterns(m), m, text_bytes(part.column(1)), n.tolist(), strict=True)
                rows = [(d, v, features(x, t).tobytes()) for d, v, x, t, k in found if k]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["draw", "v", "x"])

    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    drawn = texts.where("text is not null").select(draw.alias("draw"), "text").where(F.col("draw") < int(rate * (1 << 40)))
    rows = drawn.mapInArrow(picked, "draw long, v string, x binary").distinct().orderBy("draw", "v", "x").limit(max_train).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]) if rows else np.zeros((0, BUCKETS + TAIL_BUCKETS), np.float32)
    return [r.v for r in rows], x


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Scorer, dict]:
    """Vote on all documents, run EM on all votes, train the scorer on a bounded sample with its posteriors.

    Returns the scorer and a report: share of good, accuracy of each labeller where it votes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.select(_votes_udf()("text").alias("v")).groupBy("v").count().collect()
    rows = sorted((r.v, r["count"]) for r in rows if r.v is not None)  # not filtered in Spark: that would vote twice
    if not rows:
        return Scorer(np.zeros((BUCKETS, 1)), np.zeros(TAIL_BUCKETS), 0.0), {"good": None, "accuracy": {}}
    patterns, counts = np.array([[int(c) for c in v] for v, _ in rows]), np.array([n for _, n in rows], float)
    share, tab, post = expectation_maximisation(patterns, counts)
    right = share * tab[1, :, 1] + (1 - share) * tab[0, :, 0]
    cast = right + share * tab[1, :, 0] + (1 - share) * tab[0, :, 1]
    posterior = dict(zip((v for v, _ in rows), post, strict=True))
    shown, x = _sample(texts, min(1.0, 1.2 * max_train / counts.sum()), max_train)
    weights, bias = np.zeros(BUCKETS + TAIL_BUCKETS), 0.0
    if shown:
        scale = 1.0 / (x[:, :BUCKETS].std(axis=0) + 1e-2) / 32
        x[:, :BUCKETS] *= scale
        weights, bias = train(x, np.array([posterior.get(v, share) for v in shown]))
        weights[:BUCKETS] *= scale
    scorer = Scorer(weights[:BUCKETS, None], weights[BUCKETS:], bias)
    return scorer, {"good": share, "accuracy": dict(zip(LABELLERS, (right / cast).tolist(), strict=True))}


def score_udf(scorer: Scorer):
    """Column function: text -> probability of a good document; 0 without words."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordScores(word_scorer(scorer.weights, SIZES), 1)
        for texts in batches:
            out = []
            for at, end in slices(texts, 1 << 20):
                out += scorer.score(texts.slice(at, end - at), known)
            yield pa.array(out, pa.float64())

    return F.arrow_udf("double")(score)


def classify_quality(docs: DataFrame) -> DataFrame:
    """doc_id, quality (0 to 1), kept of every row of docs.

    Defined cases: null texts and texts without words score (almost) 0 and are rejected; no label, lang or
    source is read; repeated rows and equal texts score alike; null doc_ids are scored like others; extra
    columns of any name are not read; an empty table, or one without any words, gives the neutral scorer.
    """
    scorer, _ = fit(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", score_udf(scorer)("text").alias("quality")).withColumn("kept", F.col("quality") >= 0.5)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps; cases as in classify_quality."""
    scorer, _ = fit(docs)
    return docs.where(score_udf(scorer)(F.col("text").cast("string")) >= 0.5)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score the whole documents table."""
    return classify_quality(table(spark, sf_dir, "documents"))
