"""Quality rules: cross-document line frequency.

Every line is normalised (words lower-cased A-Z, digits as 0, one space between words) and hashed with
its host. Over the whole corpus the distinct documents of a host that hold a line are counted; distinct
means different texts, so exact copies count once. Lines in more of a host's documents than a limit are
removed, and a document that is left depleted is rejected. The host of `documents` is its source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.textkernel import Words, slices, text_bytes
from palimpsest.tables import materialize, table

#: A line is above the limits in more distinct documents of its host than LIMIT_DOCS and LIMIT_PERCENT percent of them,
#: or in more than MOST_DOCS of them, however large the host.
LIMIT_DOCS, LIMIT_PERCENT, MOST_DOCS = 8, 5, 1000
#: A document that lost lines is depleted with fewer words left, or a smaller percentage of its words.
LEAST_WORDS, LEAST_PERCENT = 10, 30
SYMBOLS = b"#*$%&|<>"
NORMAL = bytes(ord("0") if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))
FACTS = (
    "doc_id long, row_key binary, content binary, host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,words:int>>"
)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _line_key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def _keys(doc_id, body: bytes, host: bytes | None) -> tuple[bytes, bytes, int]:
    """128 bits that stand for the row and for its text, and a hash of its host."""
    content = xxhash.xxh3_128_digest(body)
    host_key = _signed(xxhash.xxh3_64_intdigest(b"-" if host is None else b"+" + host))
    return xxhash.xxh3_128_digest(f"{doc_id}/{host_key}/".encode() + content), content, host_key


def _row(doc_id, text: bytes | None, host: bytes | None, repeats: int) -> tuple:
    body = text or b""
    words = body.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    seen, dups, lines = set(), 0, {}
    for raw in body.split(b"\n"):
        line = raw.translate(NORMAL).split()
        if line:
            dups += raw in seen
            seen.add(raw)
            key = _line_key(line)
            lines[key] = lines.get(key, 0) + len(line)
    row_key, content, host_key = _keys(doc_id, body, host)
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    return doc_id, row_key, content, host_key, n, chars, symbols, dups, repeats, [{"line": k, "words": w} for k, w in lines.items()]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        for at, end in slices(batch.column(1), 1 << 20):
            part = batch.slice(at, end - at)
            words = Words.of(part.column(1))
            repeats = words.repeated(words.hashes(), 5).tolist()
            rows = [_row(*x) for x in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), text_bytes(part.column(2)), repeats, strict=True)]
            names = [c.split()[0] for c in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], line_type if i == 9 else pa.binary() if i in (1, 2) else pa.int64()) for i in range(10)], names=names)


def _slim(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))


def _lost_lines(facts: DataFrame, limit_docs: int, limit_percent: int, most_docs: int) -> DataFrame:
    """(row_key, line, words) of the lines above the limits in each row."""
    size = facts.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    lines = facts.select("row_key", "content", "host", F.explode("lines").alias("l")).select("row_key", "content", "host", "l.line", "l.words")
    counts = lines.select("host", "line", "content").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > limit_docs)
    over = (100 * F.col("n") > limit_percent * F.col("host_docs")) | (F.col("n") > most_docs)
    above = counts.join(materialize(size, "host-sizes"), "host").where(over).select("host", "line")
    return lines.join(materialize(above, "lines-above-limit"), ["host", "line"]).groupBy("row_key", "line").agg(F.max("words").alias("words"))


def _judged(facts: DataFrame, hit: DataFrame) -> DataFrame:
    """facts with n_removed_words, base_failed, kept."""
    lost = hit.groupBy("row_key").agg(F.sum("words").cast("long").alias("n_removed_words"))
    out = facts.drop("lines", "content", "host").join(lost, "row_key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < LEAST_WORDS) | (100 * left < LEAST_PERCENT * F.col("n_words")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def line_frequency(docs: DataFrame, host: str = "source", limit_docs: int = LIMIT_DOCS, limit_percent: int = LIMIT_PERCENT, most_docs: int = MOST_DOCS) -> DataFrame:
    """Apply the rule to docs (doc_id, text and the host column); one row per input row.

    Returns doc_id, the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then
    base_failed, kept, n_removed_words (words in removed lines).

    Defined cases: a null or empty text has no words or lines and fails the base rule; a null host is a host
    of its own; rows that repeat an input row get the same verdict and count as one document; a null doc_id
    is allowed; a line just at a limit stays; an empty table gives an empty result. Other columns are not read.
    """
    facts = materialize(_slim(docs, host).mapInArrow(_facts, FACTS), "line-facts")
    out = _judged(facts, _lost_lines(facts, limit_docs, limit_percent, most_docs))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*base, "base_failed", "kept", "n_removed_words")


def _row_keys(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for ids, texts, hosts in batches:
        rows = zip(ids.to_pylist(), text_bytes(texts), text_bytes(hosts), strict=True)
        yield pa.array([_keys(doc_id, text or b"", host)[0] for doc_id, text, host in rows], pa.binary())


def _without_lines(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for texts, gone in batches:
        out = []
        for text, lines in zip(text_bytes(texts), gone.to_pylist(), strict=True):
            if lines:
                lines = set(lines)
                text = b"\n".join(raw for raw in text.split(b"\n") if not (raw.split() and _line_key(raw.translate(NORMAL).split()) in lines))
            out.append(text)
        yield pa.array(out, pa.binary()).cast(pa.string())


def clean_lines(docs: DataFrame, host: str = "source", limit_docs: int = LIMIT_DOCS, limit_percent: int = LIMIT_PERCENT, most_docs: int = MOST_DOCS) -> DataFrame:
    """The rows of docs that line_frequency keeps, all columns, with the lines above the limits taken out of text.

    n_chars, where there is one, is counted anew for a changed text. Cases as in line_frequency; helper columns
    are named __line_*, and docs may have no columns of such names.
    """
    facts = materialize(_slim(docs, host).mapInArrow(_facts, FACTS), "line-facts")
    hit = materialize(_lost_lines(facts, limit_docs, limit_percent, most_docs), "lost-lines")
    kept = _judged(facts, hit).where("kept").select(F.col("row_key").alias("__line_row")).distinct()
    gone = hit.groupBy(F.col("row_key").alias("__line_row")).agg(F.collect_set("line").alias("__line_gone"))
    keys = F.arrow_udf("binary")(_row_keys)(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(host).cast("string"))
    told = docs.withColumn("__line_row", keys).join(kept, "__line_row", "left_semi").join(gone, "__line_row", "left")
    told = told.withColumn("text", F.arrow_udf("string")(_without_lines)(F.col("text").cast("string"), F.col("__line_gone")))
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.when(F.col("__line_gone").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return told.select(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The whole documents table, its source being the host."""
    return line_frequency(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), wins AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS p FROM w WHERE len(ws) >= 5)
), twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(p, p + 4)) AS q FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM w),
lines AS (
  SELECT doc_id, source, t, line, array_to_string(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS norm FROM raw
), real AS (SELECT * FROM lines WHERE norm <> ''),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM real GROUP BY doc_id),
sizes AS (SELECT source, count(DISTINCT t) AS host_docs FROM w GROUP BY source),
above AS (
  SELECT source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM real GROUP BY source, norm) c JOIN sizes USING (source)
  WHERE n > 8 AND (100 * n > 5 * host_docs OR n > 1000)
), lost AS (SELECT doc_id, sum(len(string_split(norm, ' '))) AS gone FROM real JOIN above USING (source, norm) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR 100 * (n_words - n_removed_words) < 30 * n_words)) AS kept,
  n_removed_words
FROM f
"""
