"""Reading straightened lines with the glyphs of an alphabet: correlation maps, a row of letters by recurrence, a page in two passes.

Lines are found by growth around their densest rows, straightened, brought to one size by area, and become rows with
their pixels. A kernel reads one such line; which size, baseline and stretch it is read at, and the choice among
readings, are expressions, joins and windows. The stretch of a page is told from its line with the most ink and joined back to all its lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators import evaluate, geometry, profiles
from palimpsest.tables import materialize

#: Fixed values of matching: pixels an em, least Dice of a letter, play of advances in em, ease and price of a space, room for baselines in em.
WORK_EM, LEAST_SCORE, PLAY, SPACE_GAIN, SPACE_INK, BASELINES = 64, 0.30, 0.06, 0.55, 6.0, 0.18
#: Sizes tried for a line, sizes and stretches tried for a page's probe line.
SIZES = (0.95, 1.02, 1.10, 1.18, 1.27, 1.36)
PROBE_SIZES, STRETCHES = (1.0, 1.12), (0.80, 0.90, 1.00, 1.12, 1.25, 1.40, 1.55, 1.72, 1.90)
#: Fixed values of finding lines: least height, share of the peak from which rows belong to a band, and to a line within its band.
LEAST_ROWS, BAND_SHARE, CORE_SHARE = 12, 0.04, 0.05
BAND = "struct<y0: int, y1: int>"


# lines by growth


def grown_bands(profiles: DataFrame, least: int = LEAST_ROWS, share: float = BAND_SHARE, core: float = CORE_SHARE) -> DataFrame:
    """Row profiles (key, h, p: ink of each row in order) -> key, y0, y1 of lines, half open.

    Bands are runs of rows whose smoothed ink is above a share of the greatest, of at least so many rows. In a band the line grows from the row with
    the most ink (the first of equals) to both sides, as long as rows have more than a share of that; loose marks beside it stay out.
    """
    steps = {
        "k": "greatest(3, h div 400)",
        # the mean of k rows around each, rows outside counting as empty
        "sm": "transform(sequence(0, h - 1), y -> round(aggregate(slice(p, greatest(y - k div 2, 0) + 1, least(y + (k - 1) div 2, h - 1) - greatest(y - k div 2, 0) + 1), 0D, (s, v) -> s + v) / k, 9))",
        "thr": f"array_max(sm) * {share}D",
        "starts": "filter(sequence(0, h - 1), y -> sm[y] > thr and (y = 0 or sm[greatest(y - 1, 0)] <= thr))",
        "ends": "filter(sequence(1, h), y -> sm[y - 1] > thr and (y = h or sm[least(y, h - 1)] <= thr))",
        "bands": f"filter(zip_with(starts, ends, (a, b) -> named_struct('y0', a, 'y1', b)), b -> b.y1 - b.y0 >= {least})",
        "peaks": "transform(bands, b -> named_struct('b', b, 'most', array_max(slice(p, b.y0 + 1, b.y1 - b.y0))))",
        "cores": "transform(filter(peaks, c -> c.most > 0), c -> named_struct('b', c.b, 'most', c.most, 'at', c.b.y0 + array_position(slice(p, c.b.y0 + 1, c.b.y1 - c.b.y0), c.most) - 1))",
        "lines": f"""transform(cores, c -> named_struct(
          'y0', coalesce(array_max(filter(sequence(c.b.y0, cast(c.at as int)), y -> p[y] <= c.most * {core}D)) + 1, c.b.y0),
          'y1', coalesce(array_min(filter(sequence(cast(c.at as int), c.b.y1 - 1), y -> p[y] <= c.most * {core}D)), c.b.y1)))""",
    }
    out = profiles.where("h > 0 and array_max(p) > 0")
    for name, expr in steps.items():
        out = out.withColumn(name, F.expr(expr))
    found = materialize(out.select("key", "lines"), "grown-bands")  # so many steps on one row take the optimizer too long under joins
    return found.select("key", F.explode("lines").alias("l")).select("key", "l.y0", "l.y1")


def grown_lines(bands: DataFrame, ink: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Bands with the bounds of their ink (key, line, y0, y1, x0, x1): lines not wide enough go, then those much lower than usual."""
    rows = bands.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)")))
    bounds = rows.join(ink.select("key", F.col("y").cast("int").alias("y"), "x"), ["key", "y"]).groupBy("key", "y0", "y1").agg(F.min("x").cast("int").alias("x0"), (F.max("x") + 1).cast("int").alias("x1"))
    kept = profiles.drop_low(bounds.where(F.col("x1") - F.col("x0") >= least))
    return kept.withColumn("line", F.row_number().over(Window.partitionBy("key").orderBy("y0")) - 1)


# glyphs at a size


@dataclass(frozen=True)
class Bank:
    """An alphabet: letters with advance and offsets in em, bitmaps (0 to 1) at em_px pixels an em, the advance of a space."""

    names: tuple[str, ...]
    adv: tuple[float, ...]
    x0: tuple[float, ...]
    y0: tuple[float, ...]
    shapes: tuple[tuple[int, int, bytes], ...]
    em_px: int
    space: float

    @classmethod
    def of(cls, glyphs: list[dict], em_px: int, space: float) -> Bank:
        rows = [g for g in glyphs if g["w"] and g["h"]]
        return cls(*(tuple(g[c] for g in rows) for c in ("ch", "adv", "x0", "y0")), tuple((g["h"], g["w"], bytes(g["bitmap"])) for g in rows), em_px, space)

    @property
    def extent(self) -> float:
        """Height of a full line, from the highest letter's top to the lowest one's bottom, in em."""
        return max(y + s[0] / self.em_px for y, s in zip(self.y0, self.shapes, strict=True)) - min(self.y0)


@dataclass(frozen=True)
class Masks:
    """Letters at a size in pixels."""

    names: tuple[str, ...]
    shapes: tuple[np.ndarray, ...]
    adv: tuple[int, ...]
    dx: tuple[int, ...]
    dy: tuple[int, ...]


def area_means(src: np.ndarray, h: int, w: int) -> np.ndarray:
    """Another size, each pixel the mean of the area that it covers."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None) * m / n

    return weights(src.shape[0], h) @ src @ weights(src.shape[1], w).T


@lru_cache(maxsize=64)
def at_size(bank: Bank, em: float) -> Masks:
    """The letters at em pixels an em."""
    px = lambda v: int(round(v))
    shapes = []
    for h, w, data in bank.shapes:
        src = np.frombuffer(data, np.uint8).reshape(h, w) / 255.0
        shapes.append(area_means(src, max(px(h * em / bank.em_px), 1), max(px(w * em / bank.em_px), 1)))
    return Masks(bank.names, tuple(shapes), tuple(max(px(a * em), 1) for a in bank.adv), tuple(px(v * em) for v in bank.x0), tuple(px(v * em) for v in bank.y0))


# one line


def dice_maps(strip: np.ndarray, shapes: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Each letter's Dice overlap at every place of a strip where it fits, to nine digits: twice the common ink by the ink of both.

    Overlaps are products of spectra, the strip's being worked out once; ink under a letter comes from sums over rectangles.
    """
    h, w = strip.shape
    spectrum = np.fft.rfft2(strip)
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(strip, axis=0), axis=1, out=total[1:, 1:])
    out = []
    for mask in shapes:
        th, tw = mask.shape
        if th > h or tw > w:
            out.append(np.zeros((1, 1)))
            continue
        both = np.fft.irfft2(spectrum * np.conj(np.fft.rfft2(mask, s=(h, w))), s=(h, w))[: h - th + 1, : w - tw + 1]
        under = total[th:, tw:] - total[:-th, tw:] - total[th:, :-tw] + total[:-th, :-tw]
        out.append(np.round(2 * both / np.maximum(under + mask.sum(), 1e-6), 9))
    return out


def baseline_scores(maps: list[np.ndarray], masks: Masks, baseline: int, width: int) -> np.ndarray:
    """Each letter's overlap by pen position, all standing on one baseline; 0 where it doesn't fit."""
    out = np.zeros((len(maps), width))
    for k, m in enumerate(maps):
        row = baseline + masks.dy[k]
        if 0 <= row < m.shape[0]:
            first, last = max(0, -masks.dx[k]), min(width, m.shape[1] - masks.dx[k])
            if last > first:
                out[k, first:last] = m[row, first + masks.dx[k] : last + masks.dx[k]]
    return out


@dataclass(frozen=True)
class Reading:
    text: str
    score: float
    gain: float
    trace: tuple[tuple[int, str, float], ...]


def decoded(strip: np.ndarray, scores: np.ndarray, masks: Masks, em: float, space: float) -> Reading:
    """The row of letters and spaces that explains a strip best, for one size and baseline.

    A letter gives its advance times what its overlap has above LEAST_SCORE, and may advance a little less or more; a space gives the more,
    the less ink it covers. best[p] is the most that a row ending at p gives; of equals the row that was longer before its last
    piece counts, then spaces before letters. The row may end before the strip does, by two spaces at most.
    """
    height, width = max(strip.shape[0], 1), strip.shape[1]
    wide, play = max(int(round(space * em)), 1), max(int(round(PLAY * em)), 1)
    ink = np.concatenate(([0.0], np.cumsum(strip.sum(axis=0))))
    pieces = [(wide, -1, 0), (wide + play, -1, 1)]
    pieces += [(a + d, k, 2 + 3 * k + n) for k, a in enumerate(masks.adv) for n, d in enumerate((-play, 0, play)) if a + d > 0]
    pieces.sort(key=lambda p: (-p[0], p[2]))
    adv, letter = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    gains = np.full((len(pieces), width), -np.inf)
    for i, (a, k, _) in enumerate(pieces):
        if k >= 0:
            gains[i] = np.where(scores[k] >= LEAST_SCORE, a * (scores[k] - LEAST_SCORE), -np.inf)
        elif a <= width:
            covered = (ink[a:] - ink[:-a]) / (a * height)
            gains[i, : width - a + 1] = (a * (SPACE_GAIN - SPACE_INK * covered - LEAST_SCORE))[: width]
    best, came = np.full(width + 1, -np.inf), np.full(width + 1, -1)
    best[0] = 0.0
    rows = np.arange(len(pieces))
    for end in range(1, width + 1):
        start = end - adv
        value = np.where(start >= 0, best[start * (start >= 0)] + gains[rows, np.minimum(start * (start >= 0), width - 1)], -np.inf)
        top = int(np.argmax(value))
        if value[top] > -np.inf:
            best[end], came[end] = value[top], top
    low = max(width - 2 * wide, 0)
    at = low + int(np.argmax(best[low:]))
    gain, trace = float(best[at]), []
    while at > 0 and came[at] >= 0:
        k = int(letter[came[at]])
        at -= int(adv[came[at]])
        trace.append((at, " ", 0.0) if k < 0 else (at, masks.names[k], float(scores[k, at])))
    trace.reverse()
    letters = [s for _, c, s in trace if c != " "]
    return Reading("".join(c for _, c, _ in trace), float(np.mean(letters)) if letters else 0.0, gain, tuple(trace))


READING = "img string, cand int, em double, baseline int, text string, score double"


def _read(banks: dict[str, Bank]):
    """Rows of a line, its font and sizes -> one reading per size and baseline, numbered in the order in which they are tried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 8):
                out = []
                for r in batch.slice(at, 8).to_pylist():
                    bank = banks[r["font"]]
                    strip = np.zeros(r["w"] * r["h"])
                    strip[r["pixels"]] = 1
                    strip = strip.reshape(r["h"], r["w"])
                    cand = 0
                    for size in r["sizes"]:
                        em = WORK_EM * size
                        masks = at_size(bank, em)
                        maps = dice_maps(strip, masks.shapes)
                        middle, span = r["room"] - min(masks.dy), max(int(round(BASELINES * em)), 3)
                        for baseline in range(middle - span, middle + span + 1, 2):
                            read = decoded(strip, baseline_scores(maps, masks, baseline, r["w"]), masks, em, bank.space)
                            out.append((r["img"], cand, em, baseline, read.text, read.score))
                            cand += 1
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in READING.split(", ")])

    return run


def _maps(shapes: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                strip = np.zeros(r["w"] * r["h"])
                strip[r["pixels"]] = 1
                for name, m in zip(shapes, dice_maps(strip.reshape(r["h"], r["w"]), tuple(shapes.values())), strict=True):
                    y, x = (v.ravel().astype(np.int32) for v in np.indices(m.shape))
                    same = lambda v, t, n=m.size: pa.array([v] * n, t)
                    yield pa.RecordBatch.from_arrays([same(str(r["img"]), pa.string()), same(name, pa.string()), pa.array(y), pa.array(x), pa.array(m.ravel())], names=["img", "name", "y", "x", "dice"])

    return run


def correlation_maps(lines: DataFrame, shapes: dict[str, np.ndarray]) -> DataFrame:
    """Packed lines -> img, name, y, x, dice of every letter at every place where it fits (one row of 0 where it nowhere does).

    shapes: the masks of an alphabet at one size. A task has one line at a time.
    """
    return lines.select("img", "w", "h", "pixels").mapInArrow(_maps(shapes), "img string, name string, y int, x int, dice double")


def _decoded(masks: Masks, em: float, space: float, baseline: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                strip = np.zeros(r["w"] * r["h"])
                strip[r["pixels"]] = 1
                strip = strip.reshape(r["h"], r["w"])
                read = decoded(strip, baseline_scores(dice_maps(strip, masks.shapes), masks, baseline, r["w"]), masks, em, space)
                out.append((str(r["img"]), read.text, read.score, read.gain))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["img", "text", "score", "gain"])

    return run


def decoded_lines(lines: DataFrame, masks: Masks, em: float, space: float, baseline: int) -> DataFrame:
    """Packed lines read at one size and baseline: img, text, score (mean overlap of the letters), gain (what the recurrence makes most of)."""
    return lines.select("img", "w", "h", "pixels").mapInArrow(_decoded(masks, em, space, baseline), "img string, text string, score double, gain double")


# pages


def packed(ink: DataFrame, room: int = 0) -> DataFrame:
    """Pixel tables of lines -> one row a line: img, w, h, pixels (y * w + x of its ink), with so many empty rows above and below.

    A line is bounded by its page's width and its height. Lines without ink have no row.
    """
    at = ((F.col("y") + room) * F.col("w") + F.col("x")).cast("int")
    out = ink.where("ink = 1").groupBy("img", "w", "h").agg(F.array_sort(F.collect_list(at)).alias("pixels"))
    return out.select(F.col("img").cast("string").alias("img"), F.col("w").cast("int").alias("w"), (F.col("h") + 2 * room).cast("int").alias("h"), "pixels")


def prepared(lines: DataFrame, stretch: Column) -> DataFrame:
    """Straight lines of ink (img, w, h, y, x, extent) at WORK_EM pixels an em, packed with room above and below.

    extent is the height of a full line of their alphabet in em, stretch by how much their width has to grow.
    """
    scale = F.lit(float(WORK_EM)) * F.greatest(F.col("extent"), F.lit(0.1)) / F.col("h")
    size = lambda v: F.greatest(F.lit(1), F.rint(v))
    resized = geometry.area_resized(lines.withColumn("ink", F.lit(1)), size(F.col("w") * scale * stretch), size(F.col("h") * scale), "ink")
    dark = resized.where(F.col("ink") > geometry.DARK_SHARE).withColumn("ink", F.lit(1))
    return packed(dark, WORK_EM // geometry.ROOM)


def best_readings(lines: DataFrame, banks: dict[str, Bank], sizes: tuple[float, ...]) -> DataFrame:
    """Packed lines with their font -> img, text, score, em, baseline of the best reading over sizes and baselines; the first of equals."""
    asked = lines.select("img", "w", "h", "pixels", "font", F.array(*[F.lit(s) for s in sizes]).alias("sizes"), F.lit(WORK_EM // geometry.ROOM).alias("room"))
    tried = asked.mapInArrow(_read(banks), READING)
    return evaluate.first_best(tried, ["img"], "score", "cand").select("img", "text", "score", "em", "baseline")


def page_stretches(lines: DataFrame, banks: dict[str, Bank]) -> DataFrame:
    """Straight lines (key, line, img, w, h, y, x, font, extent) -> per page (key) the stretch at which its line with the most ink reads best.

    Of equal lines the first counts, of equal stretches the first tried.
    """
    amount = lines.groupBy("key", "line").agg(F.count("*").alias("ink"))
    probe = amount.groupBy("key").agg(F.max_by("line", F.struct("ink", -F.col("line"))).alias("line"))
    ways = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.lit(s).alias("stretch")) for i, s in enumerate(STRETCHES)]))
    tried = lines.join(probe, ["key", "line"]).withColumn("s", ways).select(F.concat_ws("|", "img", "s.way").alias("img"), "key", "font", "s.way", "s.stretch", "w", "h", "y", "x", "extent")
    tried = materialize(tried, "probe-lines")
    named = tried.groupBy("img", "key", "font", "way", "stretch").agg(F.count("*").alias("n")).drop("n")
    strips = prepared(tried, F.col("stretch")).join(named.select("img", "font"), "img")
    scores = best_readings(strips, banks, PROBE_SIZES).join(named, "img")
    return evaluate.first_best(scores, ["key"], "score", "way").select("key", "stretch")


def read_pages(ink: DataFrame, profiles: DataFrame, fonts: DataFrame, banks: dict[str, Bank]) -> DataFrame:
    """Sparse ink of pages (key, y, x), their profiles (key, w, h, p) and alphabets (key, font) -> key, font, text, confidence, n_lines, stretch.

    Pages without lines have no row; a line that reads as nothing counts with its score of 0.
    """
    lines = materialize(grown_lines(grown_bands(profiles), ink), "grown-lines")
    rows = lines.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)")))
    inside = rows.join(ink.select("key", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), ["key", "y"]).where("x >= x0 and x < x1")
    name = F.concat_ws("|", "key", "line")
    cut = inside.select(name.alias("img"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.lit(1).alias("ink"))
    straight = geometry.straightened(materialize(cut, "cut-lines"))
    extents = ink.sparkSession.createDataFrame([(f, b.extent) for f, b in banks.items()], "font string, extent double")
    of = lines.select(name.alias("img"), "key", "line").join(fonts, "key").join(F.broadcast(extents), "font")  # one row per alphabet
    straight = materialize(straight.join(of, "img"), "straight-lines")
    stretches = materialize(page_stretches(straight, banks), "stretches")
    strips = prepared(straight.join(stretches, "key"), F.col("stretch")).join(of, "img")
    read = best_readings(strips, banks, SIZES).join(of.select("img", "key", "line", "font"), "img")
    told = read.groupBy("key", "font").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls"), F.avg("score").alias("confidence"))
    text = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    return told.join(stretches, "key").select("key", "font", text.alias("text"), "confidence", F.size("ls").alias("n_lines"), "stretch")
