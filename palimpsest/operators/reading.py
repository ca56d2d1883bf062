"""Reading lines of ink with a glyph alphabet: candidates of size and baseline, a reading of each, the best one.

Candidates are made, compared and put together by expressions, windows and joins; one small kernel reads one line at
one size and baseline. There, every letter's Dice overlap at every pen position is a matrix, and a recurrence
over pen positions finds the row of letters and gaps that explains the ink best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.operators import evaluate
from palimpsest.tables import materialize

#: Fixed values of the search for a line's size: spans, step counts, least size, step of a finer search, price of extra letters.
LOWER, UPPER, BASELINES_APART, LEAST_EM, FINE_SPREAD, EXTRA_COST, EXTRA_FROM = 0.9, 1.25, 3, 6, 1.1, 0.02, 1.3


@dataclass(frozen=True)
class ReadOptions:
    """Fixed values of the reader: price of a letter, play of advances and baseline, gaps between words; steps of sizes."""

    insertion: float = 0.45
    jitter: int = 1
    jitter_cost: float = 0.02
    gap_em: float = 0.16
    gap_bonus: float = 0.05
    vertical: int = 2
    steps: int = 5
    fine_steps: int = 5


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def resampled(src: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling with half-pixel centres, to 0..1."""

    def weights(n: int, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        low = np.clip(np.floor(at), 0, n - 1).astype(int)
        part = np.clip(at - low, 0, 1)
        out = np.zeros((m, n))
        np.add.at(out, (np.arange(m), low), 1 - part)
        np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), part)
        return out

    return weights(src.shape[0], h) @ (src / 255.0) @ weights(src.shape[1], w).T


class Scaled:
    """An alphabet at one size: its masks side by side on a common canvas, their places against the pen, the advances."""

    def __init__(self, glyphs: tuple, em_px: int, em: float):
        shapes = [resampled(np.frombuffer(g[6], np.uint8).reshape(g[5], g[4]).astype(float), max(1, half_up(g[5] * em / em_px)), max(1, half_up(g[4] * em / em_px))) for g in glyphs]
        self.names = [g[0] for g in glyphs]
        self.dx, self.dy = np.array([half_up(g[2] * em) for g in glyphs]), np.array([half_up(g[3] * em) for g in glyphs])
        self.h, self.w = np.array([m.shape[0] for m in shapes]), np.array([m.shape[1] for m in shapes])
        adv = np.array([g[1] * em for g in glyphs])
        self.base, self.mean = np.array([half_up(a) for a in adv]), float(adv.mean())
        self.mass = np.array([m.sum() for m in shapes])
        self.top, self.left = int(self.dy.min()), int(min(0, self.dx.min()))
        self.height, self.width = int((self.dy + self.h).max()) - self.top, int((self.dx + self.w).max()) - self.left
        self.canvas = np.zeros((len(shapes), self.height, self.width))
        for c, m, x, y in zip(self.canvas, shapes, self.dx - self.left, self.dy - self.top, strict=True):
            c[y : y + m.shape[0], x : x + m.shape[1]] = m
        self.kernel = self.canvas.reshape(len(shapes), -1).T


@lru_cache(maxsize=64)
def scaled(glyphs: tuple, em_px: int, em: float) -> Scaled:
    """Sizes that are equal to two decimals share their glyphs."""
    return Scaled(glyphs, em_px, em)


def overlaps(ink: np.ndarray, shapes: Scaled, baseline: int, vertical: int) -> np.ndarray:
    """Best Dice overlap of every letter with the ink at every pen position, over some vertical play.

    A matrix product of all windows of the ink with all masks; ink counts over a mask's rows, and the columns of
    mask and advance.
    """
    h, width = ink.shape
    lead, trail = -shapes.left, int(max((shapes.dx + shapes.w).max(), shapes.base.max()))
    above = shapes.height + vertical + abs(baseline + shapes.top) + 1
    tall = np.zeros((above + h + above, lead + width + trail + 1))
    tall[above : above + h, lead : lead + width] = ink
    total = np.zeros((tall.shape[0] + 1, tall.shape[1] + 1))
    np.cumsum(np.cumsum(tall, axis=0), axis=1, out=total[1:, 1:])
    pen = np.arange(width + 1) + lead
    left, right = pen[None] + np.minimum(shapes.dx, 0)[:, None], pen[None] + np.maximum(shapes.dx + shapes.w, shapes.base)[:, None]
    best = np.zeros((len(shapes.names), width + 1))
    for play in range(-vertical, vertical + 1):
        first = min(max(above + baseline + shapes.top + play, 0), tall.shape[0] - shapes.height)
        windows = np.lib.stride_tricks.sliding_window_view(tall[first : first + shapes.height], shapes.width, axis=1)[:, : width + 1]
        both = (windows.transpose(1, 0, 2).reshape(width + 1, -1) @ shapes.kernel).T
        up = (first - shapes.top + shapes.dy)[:, None]
        down = up + shapes.h[:, None]
        marks = total[down, right] - total[up, right] - total[down, left] + total[up, left]
        best = np.maximum(best, np.where(marks > 0, 2 * both / (shapes.mass[:, None] + marks), 0.0))
    return best


def gap_targets(columns: np.ndarray, gap: int) -> dict[int, list[int]]:
    """Where a gap may end -> where it starts: runs of at least gap columns that are almost without ink, taken to their end."""
    width = len(columns)
    total = np.concatenate(([0], np.cumsum(columns)))
    most = np.maximum(1, np.floor(np.arange(width + 1) * 0.05 + 0.5))
    out: dict[int, list[int]] = {}
    for p in range(width - gap + 1):
        empty = total[p + gap :] - total[p] <= most[gap : width - p + 1]
        if empty[0]:
            end = p + gap + (int(np.argmin(empty)) if not empty.all() else len(empty)) - 1
            for q in range(end - min(2, end - p - gap), end + 1):
                out.setdefault(q, []).append(p)
    return out


def read_line(ink: np.ndarray, shapes: Scaled, baseline: float, em: float, options: ReadOptions = ReadOptions()) -> tuple[str, float, int]:
    """(text, score, letters) of one line of ink at one size and baseline."""
    columns = ink.sum(axis=0)
    width = len(columns)
    if not columns.any():
        return "", 0.0, 0
    use = np.flatnonzero(shapes.base >= 1)
    fit = overlaps(ink.astype(float), shapes, half_up(baseline), options.vertical)[use]
    gain = (fit - options.insertion) * (shapes.base[use] / shapes.mean)[:, None]
    # every way to reach a pen position, the one from furthest left first, then by letter, then by play
    ways = sorted((-(int(shapes.base[k]) + d), row, d) for row, k in enumerate(use) for d in range(-options.jitter, options.jitter + 1) if shapes.base[k] + d > 0)
    back, letter, play = (np.array(c) for c in zip(*ways, strict=True))
    cost = np.abs(play) * options.jitter_cost
    gaps = gap_targets(columns, max(3, half_up(em * options.gap_em)))
    first = int(np.flatnonzero(columns)[0])
    best = np.full(width + 1, -np.inf)
    best[max(0, first - 2) : first + 1] = 0.0
    came, via = np.full(width + 1, -1), np.full(width + 1, -1)
    for q in range(1, width + 1):
        start = q + back
        ok = start >= 0
        value = np.where(ok, best[start * ok] + gain[letter, start * ok] - cost, -np.inf)
        top = int(np.argmax(value))
        found, at, what = value[top], int(start[top]), int(letter[top])
        for p in gaps.get(q, ()):
            v = best[p] + options.gap_bonus
            if v > found or (v == found and p < at):
                found, at, what = v, p, -1
        if found > best[q]:
            best[q], came[q], via[q] = found, at, what
    low = max(0, width - max(2, half_up(shapes.mean * 0.6)))
    end = low + int(np.argmax(best[low:]))
    if best[end] == -np.inf:
        return "", 0.0, 0
    chars, p = [], end
    while p > 0 and came[p] >= 0:
        chars.append(" " if via[p] < 0 else shapes.names[use[via[p]]])
        p = came[p]
    n = sum(c != " " for c in chars)
    return " ".join("".join(reversed(chars)).split()), float(best[end] / max(n, 1) + options.insertion), n


CANDIDATES = "array<struct<em:double,baseline:double>>"
READING = "key string, line int, font string, cand int, em double, baseline double, text string, score double, letters int"


def _sizes(low: str, high: str, steps: int) -> str:
    return f"transform(sequence(0, {steps - 1}), i -> {low} + ({high} - {low}) * i / {max(steps - 1, 1)})" if steps > 1 else f"array(({low} + {high}) / 2)"


def coarse_candidates(lines: DataFrame, steps: int) -> DataFrame:
    """Lines with their font's extent (top, bottom, height, median_h) -> cands: sizes by the ink's height, baselines by its ends."""
    tall = "greatest(1, ink_bottom - ink_top)"
    low = f"least({tall} / greatest(height, 1e-6D), {tall} / greatest(median_h, 1e-6D)) * {LOWER}D"
    high = f"greatest({tall} / greatest(height, 1e-6D), {tall} / greatest(median_h, 1e-6D)) * {UPPER}D"
    from_bottom, from_top = "(ink_bottom - bottom * e)", "(ink_top - top * e)"
    ways = f"if(abs({from_top} - {from_bottom}) > {BASELINES_APART}, array({from_bottom}, {from_top}, ({from_top} + {from_bottom}) / 2), array({from_bottom}))"
    cands = f"filter(flatten(transform({_sizes(low, high, steps)}, e -> transform({ways}, b -> named_struct('em', cast(e as double), 'baseline', cast(b as double))))), c -> c.em >= {LEAST_EM})"
    return lines.withColumn("cands", F.expr(cands))


def fine_candidates(best: DataFrame, steps: int) -> DataFrame:
    """Best readings with the step between sizes -> cands: sizes around the best one at its baseline."""
    spread = f"(step / em * {FINE_SPREAD}D)"
    sizes = _sizes(f"em * (1 - {spread})", f"em * (1 + {spread})", steps)
    return best.withColumn("cands", F.expr(f"filter(transform({sizes}, e -> named_struct('em', cast(e as double), 'baseline', baseline)), c -> c.em >= {LEAST_EM})"))


def _read(atlas: dict[str, tuple], em_px: int, options: ReadOptions):
    """Rows of a line, its font and candidates -> one reading per candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 16):
                out = []
                for r in batch.slice(at, 16).to_pylist():
                    ink = np.zeros(r["w"] * r["h"], np.uint8)
                    ink[r["pixels"]] = 1
                    for i, c in enumerate(r["cands"]):
                        shapes = scaled(atlas[r["font"]], em_px, round(c["em"], 2))
                        out.append((r["key"], r["line"], r["font"], i, c["em"], c["baseline"], *read_line(ink.reshape(r["h"], r["w"]), shapes, c["baseline"], c["em"], options)))
                names = [x.split()[0] for x in READING.split(", ")]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return run


def read_lines(lines: DataFrame, fonts: DataFrame, atlas: dict[str, list[dict]], em_px: int, options: ReadOptions = ReadOptions()) -> DataFrame:
    """Cropped lines with a font each -> key, line, font, text, score, em, baseline of the best reading.

    fonts: (font, top, bottom, height, median_h, adv_em). A reading's score is lowered for letters beyond what the
    line's width lets expect; of equals the first candidate wins, and a finer search only what is better.
    """
    packed = {font: tuple((g["ch"], g["adv"], g["x0"], g["y0"], g["w"], g["h"], g["bitmap"]) for g in rows) for font, rows in atlas.items()}
    asked = lines.join(F.broadcast(fonts), "font")  # one row per alphabet
    where = ["key", "line", "font"]

    def tried(cands: DataFrame) -> DataFrame:
        read = cands.select("key", "line", "font", "w", "h", "pixels", "cands").mapInArrow(_read(packed, em_px, options), READING)
        sized = read.join(asked.select(*where, "w", "adv_em"), where)
        extra = F.greatest(F.lit(0.0), F.col("letters") - F.col("w") / F.greatest(F.col("em") * F.col("adv_em"), F.lit(1.0)) * EXTRA_FROM)
        return sized.withColumn("adj", F.col("score") - EXTRA_COST * extra).drop("w", "adv_em")

    coarse = materialize(tried(coarse_candidates(asked, options.steps)), "coarse-readings")
    best = evaluate.first_best(coarse, where, "adj", "cand")
    named = coarse.withColumn("_k", F.concat_ws("|", *where))
    steps = evaluate.size_step(named, "_k", "em")
    around = best.withColumn("_k", F.concat_ws("|", *where)).join(steps, "_k").select(*where, "em", "baseline", "step")
    fine = tried(fine_candidates(asked.select(*where, "w", "h", "pixels").join(around, where), options.fine_steps)).withColumn("cand", F.col("cand") + 1_000)
    both = best.unionByName(fine)
    return evaluate.first_best(both, where, "adj", "cand").where("text <> ''")


def page_readings(lines: DataFrame) -> DataFrame:
    """Readings of lines put together: key, font, text (lines in order), confidence (mean score), n_lines."""
    told = lines.groupBy("key", "font").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"))
    return told.select("key", "font", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "confidence", F.size("ls").alias("n_lines"))


def best_font(pages: DataFrame) -> DataFrame:
    """Per page the font that is read with the highest confidence; of equals the first by name."""
    return evaluate.first_best(pages, ["key"], "confidence", "font")
