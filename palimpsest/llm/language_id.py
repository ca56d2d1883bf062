"""Language identification by hierarchical discrimination.

First a linear support vector machine per language family picks the family; then one-versus-one
machines between the languages of that family vote. All work on mean hashed byte n-grams, so a
document's margins are sums of per-word margins. Every language with a labelled text is learned; a text is scored by
the machines of all families, and then only by those between the languages of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.llm.textkernel import slices, text_bytes
from palimpsest.llm.toxicity import held_out
from palimpsest.llm.wordscores import letter_words, mean_gram_vector, text_scores
from palimpsest.tables import materialize, table

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 12
#: The training sample: documents in all and of each language, read whole; two of each language in any case.
MAX_DOCS, MAX_DOCS_PER_LANG, LEAST_DOCS = 6000, 600, 2
#: Families by language code; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"),
}
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def has_letter(text: bytes | None) -> bool:
    """Whether a UTF-8 text has a letter; signs like ½ or ² are none."""
    if not text:
        return False
    return text.translate(None, NO_LETTERS) != b"" if text.isascii() else any(map(str.isalpha, text.decode("utf-8", "replace")))


def linear_svms(x: np.ndarray, y: np.ndarray, steps: int = 200, c: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns) and biases of squared-hinge linear SVMs, one per column of y in {-1, 1}, by accelerated gradient descent."""
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).mean(axis=0), 1e-6), 0.5 / np.maximum((y < 0).mean(axis=0), 1e-6)) / len(y)
    y, share = y.astype(x.dtype), share.astype(x.dtype)
    w, b = np.zeros((x.shape[1], y.shape[1]), x.dtype), np.zeros(y.shape[1], x.dtype)
    w0, b0 = w, b
    step = (1.0 / (1.0 + 2 * c * max(float((np.einsum("ij,ij->i", x, x) + 1).max()), 1e-9) * share.sum(axis=0))).astype(x.dtype)
    for t in range(steps):
        k = x.dtype.type(t / (t + 3))
        wv, bv = w + k * (w - w0), b + k * (b - b0)
        slack = np.maximum(0, 1 - y * (x @ wv + bv)) * share * y
        w0, b0 = w, b
        w, b = wv - step * (wv - x.dtype.type(2 * c) * (x.T @ slack)), bv + step * x.dtype.type(2 * c) * slack.sum(axis=0)
    return w, b


def linear_svm(x: np.ndarray, y: np.ndarray, steps: int = 200, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of one machine."""
    w, b = linear_svms(x, y[:, None], steps, c)
    return w[:, 0], float(b[0])


class Model:
    """Machines for families, and for the pairs of languages within each family.

    family, pairs[f]: weights (buckets x machines) and biases.
    """

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        name = {code: f for f, codes in FAMILIES.items() for code in codes}
        self.families = sorted({name.get(g, g) for g in langs})
        at = {f: k for k, f in enumerate(self.families)}
        own = np.array([at[name.get(g, g)] for g in langs], int)
        self.members = [np.flatnonzero(own == f).tolist() for f in range(len(self.families))]
        self.between = [list(combinations(m, 2)) for m in self.members]
        scale = (1.0 / (x.std(axis=0) + 1e-3) if len(x) else np.ones(BUCKETS)).astype(np.float32)
        mean = (x.mean(axis=0) if len(x) else np.zeros(BUCKETS)).astype(np.float32)
        z = (x - mean) * (scale / np.float32(np.sqrt(BUCKETS)))

        def folded(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            w = w.astype(np.float64) * scale[:, None] / np.sqrt(BUCKETS)
            return w, b - mean @ w

        n = len(self.families)
        if n > 1:
            side = np.full((len(y), n), -1, np.int8)
            side[np.arange(len(y)), own[y]] = 1
            self.family = folded(*linear_svms(z, side))
        else:
            self.family = folded(np.zeros((BUCKETS, n)), np.ones(n))
        self.pairs = []
        for pairs in self.between:
            found = [linear_svm(z[pick], np.where(y[pick] == i, 1, -1)) for i, j in pairs for pick in (np.isin(y, (i, j)),)]
            self.pairs.append(folded(np.array([w for w, _ in found]).T.reshape(BUCKETS, -1), np.array([b for _, b in found])))

    def vote(self, f: int, margins: np.ndarray) -> tuple[int, float]:
        """The language of a family that wins most of its duels, and its narrowest win; of equals the one whose worst duel went better, then the first."""
        votes, least = dict.fromkeys(self.members[f], 0), dict.fromkeys(self.members[f], np.inf)
        for m, (i, j) in zip(margins.tolist(), self.between[f], strict=True):
            votes[i if m >= 0 else j] += 1
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(votes, key=lambda i: (votes[i], least[i], -i))
        return best, least[best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; `und` and 0 without a letter or without any language."""
        names, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
        lettered = np.flatnonzero([bool(self.langs) and has_letter(t) for t in text_bytes(texts)])
        if not len(lettered):
            return names.tolist(), sure
        some = texts.take(pa.array(lettered))
        margins = text_scores(some, self.family[0], SIZES)[0] + self.family[1]
        family = margins.argmax(axis=1)
        trust = np.ones(len(lettered))
        if margins.shape[1] > 1:
            ranked = np.sort(margins, axis=1)
            trust = 1 / (1 + np.exp(-np.clip(4 * (ranked[:, -1] - ranked[:, -2]), -30, 30)))
        for f in np.unique(family).tolist():
            rows = np.flatnonzero(family == f)
            if len(self.members[f]) == 1:
                names[lettered[rows]] = self.langs[self.members[f][0]]
                continue
            duels = text_scores(some.take(pa.array(rows)), self.pairs[f][0], SIZES)[0] + self.pairs[f][1]
            for row, m in zip(rows.tolist(), duels, strict=True):
                best, least = self.vote(f, m)
                names[lettered[row]] = self.langs[best]
                trust[row] *= 1 / (1 + np.exp(-np.clip(8 * least, -30, 30)))
        sure[lettered] = trust
        return names.tolist(), sure


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lang, text) -> (doc_id, lang, x) with the mean n-gram vector of the whole text, for texts with a word."""
    for batch in batches:
        for at, end in slices(batch.column(2), most_rows=256):
            part = batch.slice(at, end - at)
            rows = []
            for doc_id, lang, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), letter_words(part.column(2)), strict=True):
                if words:
                    rows.append((doc_id, lang, mean_gram_vector(words, SIZES, BUCKETS).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "x"])


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_per_lang: int = MAX_DOCS_PER_LANG) -> Model:
    """Fit on a bounded sample of the documents outside the held-out fold with a language, each read whole.

    Every language is learned, from the documents with the least hash: max_per_lang of them, or an equal share of max_docs, LEAST_DOCS at
    least; so the sample is larger than max_docs only where there are more than max_docs / LEAST_DOCS languages. Equal rows count
    once. Counts of languages are over all such documents.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null and doc_id is not null").where(~held_out()).withColumn("draw", F.xxhash64("doc_id", "text"))
    langs = materialize(known.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")), "languages")
    quota = max(LEAST_DOCS, min(max_per_lang, max_docs // max(1, langs.count())))
    # a threshold on the hash leaves some more than quota of a language, and practically never fewer; equal rows are made one before they meet
    share = F.least(F.lit(1.0), (2.0 * quota + 30) / F.col("n"))
    near = known.join(langs, "lang").where(F.pmod("draw", F.lit(1 << 40)) < share * float(1 << 40))
    near = near.groupBy("lang", "doc_id", "text").agg(F.first("draw").alias("draw"))
    order = [F.pmod("draw", F.lit(1 << 40)), "doc_id", "text"]
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= quota)
    rows = first.select("doc_id", "lang", "text").mapInArrow(_vectors, "doc_id long, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.x))
    found = sorted({r.lang for r in rows})
    at = {g: i for i, g in enumerate(found)}
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]) if rows else np.empty((0, BUCKETS), np.float32)
    return Model(found, x, np.array([at[r.lang] for r in rows], int))


def predict_udf(model: Model):
    """Column function: text -> struct<lang_pred, score>."""

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for at, end in slices(texts, 1 << 20):
                name, sure = model.predict(texts.slice(at, end - at))
                names += name
                scores += sure.tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf("lang_pred string, score double")(predict)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Defined cases: null texts, texts without a letter, and any text when no language could be learned are
    `und` with score 0; a null lang is not learned from; a null doc_id counts as not held out and is not
    learned from; ties between languages go to the first by name; repeated rows get the same answer; an
    empty table gives an empty result.
    """
    model = fit(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), predict_udf(model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document of the table."""
    return identify_languages(table(spark, sf_dir, "documents"))
