"""Evaluation of readings against truth: edit scripts, confusions, error rates, grouped reports, sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import text
from palimpsest.operators.pixels import dealt

NOTHING = "∅"
SCRIPT = "key string, no int, op string, want string, got string"


def grouped_stats(results: DataFrame, a: str, b: str, value: str = "cer") -> DataFrame:
    """n, mean and perfect by a, by b and in total, in one pass over grouping sets."""
    view = results.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("v"))
    spark = results.sparkSession
    return spark.sql(
        """SELECT CASE WHEN grouping(a) = 0 THEN 'a' WHEN grouping(b) = 0 THEN 'b' ELSE 'all' END AS by_what, coalesce(a, b) AS grp,
             count(*) AS n, round(avg(v), 6) AS mean_v, sum(CAST(v = 0 AS INT)) AS perfect FROM {view} GROUP BY GROUPING SETS ((a), (b), ())""",
        view=view,
    )


#: Bits of distance tables that are kept at once, and pairs of texts that are worked on together.
TABLE_BITS, TOGETHER = 1 << 28, 512
PAIR, INSERTION, LOSS = 0, 1, 2


def _letters(texts: list[str]) -> np.ndarray:
    """Letters of some texts as numbers, in order."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _padded(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of some texts as one row each, filled up with -1, and the texts' lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.full((len(texts), width), -1, np.int32)
    out[np.arange(width) < size[:, None]] = _letters(texts)
    return out, size


def _shifted(bits: np.ndarray, first: int) -> np.ndarray:
    """Rows of 64-bit words moved on by one bit."""
    out = bits << 1
    out[:, 1:] |= bits[:, :-1] >> 63
    out[:, 0] |= first
    return out


def _next_rows(more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distance tables' next rows of many pairs, one letter further in each reading.

    A row is bits for each letter of the truth: where a cell is one more, or one less, than its left neighbour. Two more results tell where a cell
    comes from: not from a pair, and one more than the cell above.
    """
    both = equal & more
    total = both + more
    carry = total < both
    while carry[:, :-1].any():
        on = np.zeros_like(total)
        on[:, 1:] = carry[:, :-1]
        total += on
        carry = total < on
    level = (total ^ more) | equal | less  # as far as the cell before both letters
    down, up = less | ~(level | more), more & level
    below, above = _shifted(down, 1), _shifted(up, 0)
    return above | ~(level | below), below & level, level & ~equal, down


def _steps_together(wants: list[str], gots: list[str]) -> list[np.ndarray]:
    """How each truth turns into its reading, a PAIR, INSERTION or LOSS each, in order; ties go to a pair, then to an insertion.

    Readings come by falling length. All pairs go through their tables together, a row of each at a time. Where each cell comes from is kept for so
    many rows as fit TABLE_BITS; the rows before are worked out again from rows kept between, so long texts need no whole table.
    """
    words = max(len(w) for w in wants) // 64 + 1
    want, n_want = _padded(wants, words * 64)
    got, n_got = _padded(gots, height := len(gots[0]))
    going = np.searchsorted(-n_got, -np.arange(height), side="left")  # pairs whose reading is longer
    every = max(1, TABLE_BITS // (len(wants) * words * 64))
    starts = [(np.full((len(wants), words), ~np.uint64(0)), np.zeros((len(wants), words), np.uint64))]

    def rows(low: int, high: int, keep: bool) -> np.ndarray | None:
        more, less = (x.copy() for x in starts[-1])
        came = np.empty((2, high - low, len(wants), words), np.uint64) if keep else None
        for i in range(low, high):
            n = going[i]
            equal = np.packbits(want[:n] == got[:n, i, None], axis=1, bitorder="little").view(np.uint64)
            more[:n], less[:n], unpaired, down = _next_rows(more[:n], less[:n], equal)
            if keep:
                came[0, i - low, :n], came[1, i - low, :n] = unpaired, down
        if not keep:
            starts.append((more, less))
        return came

    for low in range(0, height - every, every):
        rows(low, low + every, False)
    i, j, size = n_got.copy(), n_want.copy(), np.zeros(len(wants), np.int64)
    out = np.empty((len(wants), int((n_got + n_want).max(initial=0))), np.uint8)
    for low in range((len(starts) - 1) * every, -1, -every):
        came = rows(low, min(low + every, height), True)
        starts.pop()
        while len(at := np.flatnonzero((i > low) & (j > 0))):
            row, place = i[at] - 1 - low, j[at] - 1
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            unpaired, down = ((came[x, row, at, word] >> bit & 1).astype(np.int64) for x in (0, 1))
            step = unpaired * (LOSS - down)
            out[at, size[at]] = step
            size[at] += 1
            i[at] -= step != LOSS
            j[at] -= step != INSERTION
    rest = np.arange(out.shape[1]) - size[:, None]  # before the first letters of one there is only the other
    out[(rest >= 0) & (rest < i[:, None])] = INSERTION
    out[(rest >= 0) & (rest < j[:, None])] = LOSS
    size += i + j
    return [o[:n][::-1] for o, n in zip(out, size, strict=True)]


class _Edits:
    """Edits of pairs (key, want, got), pair by pair: the steps, each one's letters (0 is none) and number."""

    def __init__(self, pairs: list[tuple[str, str, str]]) -> None:
        self.pairs = sorted(pairs, key=lambda p: -len(p[2]))
        found = _steps_together([p[1] for p in self.pairs], [p[2] for p in self.pairs])
        self.steps = np.concatenate(found)
        self.size = np.array([len(f) for f in found], np.int64)
        # in order the letters of all texts are those of the steps that use one
        self.want, self.got = (np.zeros(len(self.steps), np.uint32) for _ in range(2))
        self.want[self.steps != INSERTION] = _letters([p[1] for p in self.pairs])
        self.got[self.steps != LOSS] = _letters([p[2] for p in self.pairs])
        self.no = np.arange(1, len(self.steps) + 1) - np.repeat(np.cumsum(self.size) - self.size, self.size)

    def named(self, at: np.ndarray | slice = slice(None)) -> list[pa.Array]:
        """op, want and got of the edits at some places."""
        steps, want, got = self.steps[at], self.want[at], self.got[at]
        op = np.where(steps == PAIR, (want != got).astype(np.uint8), steps + 1)

        def letters(codes: np.ndarray, none: np.ndarray) -> pa.Array:
            known, number = np.unique(codes, return_inverse=True)
            return pa.DictionaryArray.from_arrays(np.where(none, len(known), number), pa.array([*map(chr, known.tolist()), ""], pa.string())).dictionary_decode()

        return [pa.DictionaryArray.from_arrays(op, ["eq", "sub", "ins", "del"]).dictionary_decode(), letters(want, steps == INSERTION), letters(got, steps == LOSS)]

    def rows(self) -> pa.RecordBatch:
        key = pa.array([p[0] for p in self.pairs], pa.string()).take(pa.array(np.repeat(np.arange(len(self.pairs)), self.size)))
        return pa.RecordBatch.from_arrays([key, pa.array(self.no, pa.int32()), *self.named()], names=["key", "no", "op", "want", "got"])

    def tally(self) -> pa.RecordBatch:
        lead = self.no == 1
        code = (self.want.astype(np.uint64) << np.uint64(24) | self.got) << np.uint64(3) | self.steps.astype(np.uint64) << np.uint64(1) | lead
        _, first, k = np.unique(code, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([*self.named(first), pa.array(lead[first]), pa.array(k, pa.int64())], names=["op", "want", "got", "lead", "k"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[_Edits]:
    """Pairs with truths of much the same length together, as many as are worked on at once."""
    for batch in batches:
        pairs = [(key, want or "", got or "") for key, want, got in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        pairs.sort(key=lambda p: (len(p[1]), len(p[2])))
        some, height = [], 0
        for pair in pairs:
            height = max(height, len(pair[2]))
            if some and (len(some) == TOGETHER or (len(some) + 1) * height * (len(pair[1]) + 64) > TABLE_BITS):
                yield _Edits(some)
                some, height = [], len(pair[2])
            some.append(pair)
        if some:
            yield _Edits(some)


def script(want: str, got: str) -> list[tuple[str, str, str]]:
    """The edits (op, want, got) that turn want into got, in order; ties go to a pair, then to an insertion."""
    return [(r["op"], r["want"], r["got"]) for r in _Edits([("", want, got)]).rows().to_pylist()]


def _dealt_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out to a told number of tasks: their work is in their letters' product, by their bytes adaptive execution would put all into a few."""
    return dealt(pairs.select(F.col("key").cast("string").alias("key"), "want_text", "got_text"), "key")


def edit_scripts(pairs: DataFrame) -> DataFrame:
    """(key, want_text, got_text) -> one row per edit: key, no (from 1), op (eq, sub, ins, del), want, got."""
    return _dealt_pairs(pairs).mapInArrow(lambda batches: (e.rows() for e in _together(batches)), SCRIPT)


def tallied_edits(pairs: DataFrame) -> DataFrame:
    """(key, want_text, got_text) -> op, want, got, lead, k: equal edits of all pairs counted, those that begin a script (lead) apart.

    Edits are counted where they are made, so few of them move, and no more come out than there are pairs of letters, a few times over.
    """
    told = _dealt_pairs(pairs).mapInArrow(lambda batches: (e.tally() for e in _together(batches)), "op string, want string, got string, lead boolean, k long")
    return told.groupBy("op", "want", "got", "lead").agg(F.sum("k").alias("k"))


def at_word_start(edits: DataFrame) -> DataFrame:
    """Add first: whether the letter that an edit expects starts a word. Insertions don't change what comes next."""
    before = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("op") != "ins", (F.col("want") == " ") | (F.col("got") == " "))
    return edits.withColumn("first", F.coalesce(F.last(opens, ignorenulls=True).over(before), F.lit(True)))


def letters_of(edits: DataFrame) -> DataFrame:
    """The edits that expect a letter, spaces on either side left out, with err."""
    return edits.where("op <> 'ins' and want <> ' ' and got <> ' '").withColumn("err", (F.col("op") != "eq").cast("long"))


def word_start_rates(edits: DataFrame) -> DataFrame:
    """(first, n, err) over letters that start a word and the rest."""
    return letters_of(at_word_start(edits)).groupBy("first").agg(F.count("*").alias("n"), F.sum("err").alias("err"))


def confusions(edits: DataFrame, twins: DataFrame) -> DataFrame:
    """(want, got, n, net, seen): every substitution, loss and insertion of a letter, with its count and first place.

    net leaves out pairs of one group of twins (ch, grp), letters that look the same.
    """
    wrong = edits.where("op <> 'eq' and want <> ' ' and got <> ' '")
    named = wrong.select("key", "no", *[F.when(F.col(c) == "", NOTHING).otherwise(F.col(c)).alias(c) for c in ("want", "got")])
    counted = named.groupBy("want", "got").agg(F.count("*").alias("n"), F.min(F.struct("key", "no")).alias("seen"))
    for c in ("want", "got"):
        counted = counted.join(twins.select(F.col("ch").alias(c), F.col("grp").alias(f"{c}_grp")), c, "left")
    alike = F.coalesce(F.col("want_grp") == F.col("got_grp"), F.lit(False))
    return counted.select("want", "got", "n", F.when(alike, 0).otherwise(F.col("n")).alias("net"), "seen")


def top_confusions(found: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent net confusions, those seen first before others of the same count."""
    return found.where("net > 0").orderBy(F.desc("net"), "seen").limit(limit).select("want", "got", F.col("net").alias("n"))


def letter_error_rates(edits: DataFrame, least: int = 3, limit: int = 25) -> DataFrame:
    """Worst letters by error rate among those expected at least `least` times; those without errors go after the limit."""
    rated = letters_of(edits).groupBy("want").agg(F.count("*").alias("n"), F.sum("err").alias("err"), F.min(F.struct("key", "no")).alias("seen"))
    rated = rated.where(F.col("n") >= least).withColumn("rate", F.round(F.col("err") / F.col("n"), 6))
    return rated.orderBy(F.desc("rate"), "seen").limit(limit).where("err > 0").select("want", "n", "err", "rate")


def context_only_errors(edits: DataFrame, isolated_right: DataFrame, least: int = 3, rate: float = 0.2) -> DataFrame:
    """Letters often wrong in words (want, n, err) that are read right when they stand alone (want). Edits may be tallied ones."""
    k = F.col("k") if "k" in edits.columns else F.lit(1).cast("long")
    rated = letters_of(edits).groupBy("want").agg(F.sum(k).alias("n"), F.sum(F.col("err") * k).alias("err"))
    return rated.where((F.col("n") >= least) & (F.col("err") / F.col("n") >= rate)).join(isolated_right.select("want").distinct(), "want", "left_semi")


def isolated_accuracy(readings: DataFrame, twins: DataFrame) -> DataFrame:
    """Per font of single-letter readings (font, want, got): n, right, and the failures in order with their counts; twins count as right.

    Equal readings are counted first, so a font's failures are at most as many as pairs of letters.
    """
    alike = twins.select("font", F.col("ch").alias("want"), F.col("grp").alias("g"))
    told = readings.groupBy("font", "want", "got").agg(F.count("*").alias("k")).join(alike, ["font", "want"], "left")
    ok = (F.col("want") == F.col("got")) | F.coalesce((F.length("got") == 1) & F.contains("g", "got"), F.lit(False))
    failure = F.when(~ok, F.concat("want", F.lit(">"), F.when(F.col("got") == "", NOTHING).otherwise(F.col("got")), F.lit(" x"), F.col("k").cast("string")))
    right = F.sum(F.when(ok, F.col("k")).otherwise(0)).alias("right")
    return told.groupBy("font").agg(F.sum("k").alias("n"), right, F.array_join(F.array_sort(F.collect_list(failure)), ", ").alias("failures"))


def line_similarity(pairs: DataFrame) -> DataFrame:
    """(key, want_text, got_text) -> (key, lines, similarity): the mean over the reading's lines of each one's likeness to the truth's line of that number.

    A line beyond the truth's last is compared with nothing; a reading without lines has similarity 0. Spaces around lines don't count.
    """
    lines = F.split(F.coalesce("got_text", F.lit("")), "\n")
    truth = F.split(F.coalesce("want_text", F.lit("")), "\n")
    each = pairs.select("key", truth.alias("truth"), F.posexplode(lines).alias("i", "got"))
    each = each.select("key", F.trim("got").alias("got"), F.trim(F.coalesce(F.get("truth", F.col("i")), F.lit(""))).alias("want"))
    held = F.col("got") != ""
    means = each.groupBy("key").agg(F.sum(held.cast("long")).alias("lines"), F.avg(F.when(held, text.similarity(F.col("want"), F.col("got")))).alias("similarity"))
    return means.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def means(results: DataFrame, keys: list[str], where: Column | None = None, sums: tuple[str, ...] = (), **of: str) -> DataFrame:
    """n by keys, and per name the mean of its column, over rows that hold; sums are added up as they are."""
    held = F.lit(True) if where is None else where
    count = F.sum(held.cast("long")).alias("n")
    return results.groupBy(*keys).agg(count, *[F.round(F.avg(F.when(held, F.col(c))), 6).alias(name) for name, c in of.items()], *[F.sum(F.when(held, F.col(c).cast("long")).otherwise(0)).alias(c) for c in sums])


def speed_up(results: DataFrame, start: str, end: str) -> DataFrame:
    """Seconds of all rows, seconds from the first start to the last end, and the quotient."""
    whole = results.agg(F.sum(F.col(end) - F.col(start)).alias("cpu"), (F.max(end) - F.min(start)).alias("wall"))
    return whole.withColumn("speed_up", F.col("cpu") / F.col("wall"))


def first_best(candidates: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Per key the candidate with the highest score; of equals the first in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), order)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_of_sweep(results: DataFrame, item: str, setting: str, value: str) -> DataFrame:
    """Per item the setting with the least value (first of equals) and the change against the first setting."""
    w = Window.partitionBy(item)
    ranked = results.withColumn("r", F.row_number().over(w.orderBy(value, setting))).withColumn("base", F.first(value).over(w.orderBy(setting)))
    return ranked.where("r = 1").select(item, setting, value, F.round(F.col(value) - F.col("base"), 6).alias("delta"))


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of rows of small tables, such as settings and items to try them on.

    Its size is the product of theirs, as is meant.
    """
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(axis)
    return out


def examples(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first in order."""
    return examples(rows, keys, [order], 1)


def size_step(candidates: DataFrame, key: str, size: str, share: float = 0.08) -> DataFrame:
    """Per key the gap between its two least distinct sizes; a share of the size where there is only one."""
    sizes = candidates.groupBy(key).agg(F.array_sort(F.collect_set(size)).alias("s"))
    return sizes.select(key, F.when(F.size("s") > 1, F.get("s", F.lit(1)) - F.get("s", F.lit(0))).otherwise(F.get("s", F.lit(0)) * share).alias("step"))


def padded(items: DataFrame, width: str, order: str, batch: int, multiple: int = 4) -> DataFrame:
    """Add batch, padded (the batch's greatest width up to a multiple) and steps (a width in eighths, at least 1)."""
    numbered = items.withColumn("batch", F.floor((F.col(order)) / batch).cast("long"))
    most = F.max(width).over(Window.partitionBy("batch"))
    return numbered.withColumn("padded", (F.ceil(most / multiple) * multiple).cast("long")).withColumn("steps", F.greatest(F.lit(1), F.floor(F.col(width) / 8)).cast("long"))


def report(rows: DataFrame, **widths: int) -> DataFrame:
    """One line of text per row: each column cut or padded to its width, numbers to the right."""
    kinds = dict(rows.dtypes)
    cells = [F.lpad(F.col(c).cast("string"), n, " ") if kinds[c] in ("int", "bigint", "double") else F.rpad(F.col(c).cast("string"), n, " ") for c, n in widths.items()]
    return rows.select(F.concat_ws("  ", *cells).alias("line"))
