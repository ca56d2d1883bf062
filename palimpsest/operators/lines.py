"""Finding the lines of pages: one row per page with its row profile as an array, all steps as expressions on it.

A profile has one number per pixel row of a page and so is bounded by the page's height; no page's pixels are
gathered. Only the bounds of lines need pixels again, by an equality join on pixel rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.tables import materialize

#: Fixed values of line finding; lengths in pixels are for pages of 1100 px.
BASE_SIDE, LARGER = 1100, 1.02
LEAST_INK, LEAST_HEIGHT, LARGE_HEIGHT, LEAST_PITCH = 0.02, 8, 10, 7
SMOOTH, SPAN, SPLIT_GAP, MERGE_GAP = 3, 40, 2, 3
VALLEY_RATIO, VALLEY_PEAK, NEIGHBOUR_PEAK, LEAST_BAND_INK = 0.8, 0.55, 0.18, 0.5
MERGED_HEIGHT, TOO_TALL, TALL, SPLIT_SLACK, ONE_LINE_SHARE = 1.65, 2.4, 1.55, 0.15, 0.18
LAGS, LARGE_LAG, LEAST_ROWS, STRONG_LAG = (9, 80), 12, 30, 0.5
PAD = 4
BAND = "struct<y0:int,y1:int>"


def page_profiles(ink: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sparse ink (key, y, x) and sizes (key, w, h) -> key, w, h, p: ink per pixel row, rows without ink included."""
    rows = ink.groupBy("key", "y").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int"), "n"))).alias("rows"))
    told = sizes.join(rows, "key", "left")
    return told.select("key", "w", "h", F.expr("transform(sequence(0, h - 1), y -> coalesce(try_element_at(rows, y), 0D))").alias("p"))


def _px(n: float, scale: str = "scale") -> str:
    """A length in pixels at a page's scale; at least 1."""
    return f"greatest(1, cast(floor({n} * {scale} + 0.5) as int))"


def _upper_median(bands: str) -> str:
    return f"sort_array(transform({bands}, b -> b.y1 - b.y0))[size({bands}) div 2]"


def _split_tall(bands: str) -> str:
    """Bands much taller than the pitch cut into equal slices that touch."""
    parts = f"if(b.y1 - b.y0 <= pitch * {TALL}D, 1, greatest(2, cast(floor((b.y1 - b.y0 + pitch * {SPLIT_SLACK}D) / pitch + 0.5D) as int)))"
    cut = f"transform(sequence(0, {parts} - 1), i -> named_struct('y0', cast(floor(b.y0 + i * ((b.y1 - b.y0) / {parts})) as int), 'y1', cast(ceil(b.y0 + (i + 1) * ((b.y1 - b.y0) / {parts})) as int)))"
    return f"flatten(transform({bands}, b -> if(pitch <= 0, array(b), {cut})))"


def line_bands(profiles: DataFrame, split_connected: bool = True) -> DataFrame:
    """key, w, h, p -> the same with scale, pitch, found (bands of pixel rows, y1 exclusive) and way.

    Ways: `empty` (no ink), `bands` (runs of inked rows), `slices` (those cut by the pitch) and `valleys` (a page
    where no gaps are seen, split at minima of the smoothed profile, thin bands merged).
    """
    lo, hi = LAGS
    may_split = "size({0}) between 3 and 12" if split_connected else "size({0}) = 1"
    steps = {
        "scale": f"greatest(1D, greatest(w, h) / {BASE_SIDE}D)",
        "peak": "array_max(p)",
        "least": f"if(scale > {LARGER}D, {_px(LARGE_HEIGHT)}, {LEAST_HEIGHT})",
        "thr": f"greatest(1D, peak * {LEAST_INK}D)",
        # runs of rows at or above the threshold: where they start and where they end
        "starts": "filter(sequence(0, h - 1), y -> p[y] >= thr and (y = 0 or p[greatest(y - 1, 0)] < thr))",
        "ends": "filter(sequence(1, h), y -> p[y - 1] >= thr and (y = h or p[least(y, h - 1)] < thr))",
        "bands": "filter(zip_with(starts, ends, (a, b) -> named_struct('y0', cast(a as int), 'y1', cast(b as int))), b -> b.y1 - b.y0 >= least)",
        # the pitch: autocorrelation of the profile's differences
        "lo": f"if(scale > {LARGER}D, {_px(LARGE_LAG)}, {_px(lo)})",
        "hi": f"least({_px(hi)}, h div 3)",
        "d": "transform(sequence(0, h - 1), y -> if(y = 0, 0D, p[y] - p[greatest(y - 1, 0)]))",
        "scores": "if(hi > lo + 1, transform(sequence(lo, hi), lag -> aggregate(zip_with(slice(d, 2, h - lag - 1), slice(d, lag + 2, h - lag - 1), (a, b) -> a * b), 0D, (s, v) -> s + v) / greatest(h - lag - 1, 1)), cast(array() as array<double>))",
        "peaks": "if(size(scores) > 2, filter(sequence(1, size(scores) - 2), i -> scores[i] >= scores[i - 1] and scores[i] >= scores[i + 1] and scores[i] > 0), cast(array() as array<int>))",
        "top": "array_max(transform(peaks, i -> scores[i]))",
        "pitch": f"if(h < {LEAST_ROWS} or size(peaks) = 0, 0, lo + filter(peaks, i -> scores[i] >= top * {STRONG_LAG}D)[0])",
        # valleys of the smoothed profile
        "r": _px(SMOOTH),
        "span": _px(SPAN),
        "sm": "transform(sequence(0, h - 1), y -> aggregate(slice(p, greatest(0, y - r) + 1, least(h - 1, y + r) - greatest(0, y - r) + 1), 0D, (s, v) -> s + v) / (least(h - 1, y + r) - greatest(0, y - r) + 1))",
        "minima": "if(h > 2 * r, filter(sequence(r, h - r - 1), y -> sm[y] <= sm[y - 1] and sm[y] <= sm[y + 1]), cast(array() as array<int>))",
        "sides": "transform(minima, y -> named_struct('y', y, 's', least(array_max(slice(sm, greatest(0, y - span) + 1, least(span, y))), array_max(slice(sm, y + 2, least(span, h - 1 - y))))))",
        "splits": f"transform(filter(sides, v -> v.s >= peak * {NEIGHBOUR_PEAK}D and try_divide(sm[v.y], v.s) <= {VALLEY_RATIO}D and try_divide(sm[v.y], peak) < {VALLEY_PEAK}D), v -> v.y)",
        "apart": f"aggregate(concat(array(-1), splits, array(h)), cast(array() as array<int>), (acc, s) -> if(size(acc) = 0 or s - acc[size(acc) - 1] > {_px(SPLIT_GAP)}, concat(acc, array(s)), acc))",
        "between": "if(size(apart) > 1, transform(sequence(0, size(apart) - 2), i -> named_struct('y0', apart[i] + 1, 'y1', apart[i + 1])), cast(array() as array<" + BAND + ">))",
        "inked": f"filter(between, b -> b.y1 - b.y0 >= least and aggregate(slice(p, b.y0 + 1, greatest(b.y1 - b.y0, 0)), 0D, (s, v) -> s + v) >= peak * {LEAST_BAND_INK}D)",
        "target": _upper_median("inked"),
        "merged": f"aggregate(inked, cast(array() as array<{BAND}>), (acc, b) -> if(size(acc) > 0 and b.y0 - acc[size(acc) - 1].y1 <= {_px(MERGE_GAP)} and b.y1 - acc[size(acc) - 1].y0 <= target * {MERGED_HEIGHT}D, concat(slice(acc, 1, size(acc) - 1), array(named_struct('y0', acc[size(acc) - 1].y0, 'y1', b.y1))), concat(acc, array(b))))",
        "middle": _upper_median("merged"),
        "usual": f"filter(merged, b -> size(merged) < 3 or b.y1 - b.y0 <= middle * {TOO_TALL}D)",
        # which way
        "tallest": "coalesce(array_max(transform(bands, b -> b.y1 - b.y0)), 0)",
        "clear": f"size(bands) > 0 and {'tallest <= h * ' + str(ONE_LINE_SHARE) + 'D' if split_connected else 'true'}",
        "slice_bands": f"clear and {may_split.format('bands')} and pitch >= {_px(LEAST_PITCH)} and tallest > pitch * {TALL}D" if split_connected else "false",
        "slice_valleys": f"{may_split.format('usual')} and pitch >= {_px(LEAST_PITCH)}",
        "way": "case when coalesce(peak, 0) = 0 then 'empty' when slice_bands then 'slices' when clear then 'bands' else 'valleys' end",
        "found": f"case way when 'empty' then cast(array() as array<{BAND}>) when 'slices' then {_split_tall('bands')} when 'bands' then bands else if(slice_valleys, {_split_tall('usual')}, usual) end",
    }
    out = profiles
    for name, expr in steps.items():
        out = out.withColumn(name, F.expr(expr))
    # written, as a plan with so many steps on one row takes the optimizer too long under joins and filters
    return materialize(out.select("key", "w", "h", "p", "scale", "pitch", "way", "found"), "line-bands")


def bounded_lines(bands: DataFrame, ink: DataFrame) -> DataFrame:
    """The bands of pages with the bounds of their ink: (key, line, y0, y1, x0, x1); bands without ink go."""
    lines = bands.select("key", F.posexplode("found").alias("line", "b")).select("key", "line", "b.y0", "b.y1").where("y1 > y0")
    rows = lines.withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)")))
    return rows.join(ink.select("key", F.col("y").cast("int").alias("y"), "x"), ["key", "y"]).groupBy("key", "line", "y0", "y1").agg(F.min("x").cast("int").alias("x0"), (F.max("x") + 1).cast("int").alias("x1"))


def cropped_lines(lines: DataFrame, ink: DataFrame, sizes: DataFrame, pad: int = PAD) -> DataFrame:
    """Each line as an image of its own with some room: key, line, w, h, ink_top, ink_bottom, pixels (y * w + x, in order).

    The pixels of one line are one row; a line is bounded by its page's width and its height.
    """
    named = lines.join(sizes.select("key", F.col("w").alias("pw"), F.col("h").alias("ph")), "key")
    top, left = F.greatest(F.lit(0), F.col("y0") - pad), F.greatest(F.lit(0), F.col("x0") - pad)
    boxes = named.select("key", "line", top.alias("oy"), left.alias("ox"), F.least("ph", F.col("y1") + pad).alias("ey"), F.least("pw", F.col("x1") + pad).alias("ex"), (F.col("y0") - top).alias("ink_top"), (F.col("y1") - top).alias("ink_bottom"))
    boxes = boxes.withColumn("w", F.col("ex") - F.col("ox")).withColumn("h", F.col("ey") - F.col("oy"))
    rows = boxes.withColumn("y", F.explode(F.expr("sequence(oy, ey - 1)")))
    inside = rows.join(ink.select("key", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), ["key", "y"]).where("x >= ox and x < ex")
    return inside.groupBy("key", "line", "w", "h", "ink_top", "ink_bottom").agg(F.array_sort(F.collect_list(F.expr("(y - oy) * w + x - ox"))).alias("pixels"))
