"""Page images as pixel tables (img, w, h, y, x, v): one row per pixel, dense grids.

Binarised images carry `ink` (0 or 1) instead of the gray value v. Everything is grouped by img, so images
are spread over the cluster and no image is held as a whole; rows of one image share its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of local thresholding and polarity.
SAUVOLA_K, SAUVOLA_R, RADIUS_DIVISOR, LEAST_RADIUS = 0.25, 128.0, 24, 4
FLIP_ABOVE, ACCEPT_FROM, ACCEPT_TO = 0.35, 0.03, 0.30
SCORE_FROM, SCORE_TO, TYPICAL, WORST, USABLE = 0.008, 0.42, 0.10, -100.0, -50.0


#: Tasks that images are dealt out to at least: with rows of pixels a task's share stays small beside its memory.
LEAST_TASKS = 96


def dealt(df: DataFrame, key: str = "img") -> DataFrame:
    """Images dealt out once, whole: windows and groups within an image then need no further exchange.

    The number of tasks is told, as pixels are packed so well when they move that adaptive execution would put far too many into one task.
    """
    return df.repartition(max(LEAST_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def image_rows(px: DataFrame, *values: str) -> DataFrame:
    """One row per row of pixels, dealt out by image: (img, w, h, y, o), o an array of (x, values) from left to right."""
    o = F.array_sort(F.collect_list(F.struct("x", *values)))
    return dealt(px.select("img", "w", "h", "y", "x", *values)).groupBy("img", "w", "h", "y").agg(o.alias("o"))


def half_up(x: Column) -> Column:
    """Round to the nearest integer, halves up, also below zero."""
    return F.floor(x + 0.5)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance of 8-bit channels with integer weights."""
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def tiles(embeddings: DataFrame) -> DataFrame:
    """Each 64-value embedding as an 8x8 gray tile: (img, label, w, h, y, x, v)."""
    px = embeddings.select(F.col("vec_id").alias("img"), "label", F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int")
    return px.select("img", "label", F.lit(8).alias("w"), F.lit(8).alias("h"), F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


def invert(px: DataFrame) -> DataFrame:
    """Dark and light swapped."""
    return px.withColumn("v", 255 - F.col("v"))


def integral(px: DataFrame, value: str = "v") -> DataFrame:
    """Inclusive 2-D prefix sums of the value and its square: columns s, s2."""
    along = Window.partitionBy("img", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("long")
    rows = px.withColumn("_a", F.sum(v).over(along)).withColumn("_b", F.sum(v * v).over(along))
    return rows.withColumn("s", F.sum("_a").over(down)).withColumn("s2", F.sum("_b").over(down)).drop("_a", "_b")


def box_sum(px: DataFrame, radius: int, value: Column, out: str) -> DataFrame:
    """Sum of value over the (2 radius + 1)^2 box clipped at the borders."""
    along = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(-radius, radius)
    return px.withColumn("_r", F.sum(value).over(along)).withColumn(out, F.sum("_r").over(down)).drop("_r")


def sauvola(px: DataFrame, radius: int, k: float = SAUVOLA_K, r: float = SAUVOLA_R) -> DataFrame:
    """Add ink: 1 where v is below mean * (1 + k * (deviation / r - 1)) of its clipped box.

    The three sums of a box go along rows together and then down columns together, over images dealt out once.
    """
    along = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("img", "x").orderBy("y").rowsBetween(-radius, radius)
    v = F.col("v").cast("long")
    px = dealt(px).withColumns({"_n": F.count(F.lit(1)).over(along), "_s": F.sum(v).over(along), "_q": F.sum(v * v).over(along)})
    px = px.withColumns({c: F.sum(c).over(down) for c in ("_n", "_s", "_q")})
    mean = F.col("_s") / F.col("_n")
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean)
    return px.withColumn("ink", (F.col("v") < mean * (1 + k * (F.sqrt(var) / r - 1))).cast("int")).drop("_n", "_s", "_q")


def sauvola_radius(w: int, h: int) -> int:
    """Box radius for an image size."""
    return max(LEAST_RADIUS, int(max(w, h) / RADIUS_DIVISOR / 2 + 0.5))


def coverage(ink: DataFrame, *keys: str) -> DataFrame:
    """Share of ink per image."""
    return ink.groupBy("img", *keys).agg((F.sum("ink") / F.count("*")).alias("coverage"))


def coverage_score(c: Column) -> Column:
    """How typical a share of ink is for a letter; WORST outside the plausible range."""
    return F.when((c < SCORE_FROM) | (c > SCORE_TO), F.lit(WORST)).otherwise(-F.abs(F.log(c / TYPICAL)))


def flip_if_heavy(per_image: DataFrame) -> DataFrame:
    """Add inverted, final_coverage: images with too much ink are flipped."""
    return per_image.withColumn("inverted", F.col("coverage") > FLIP_ABOVE).withColumn("final_coverage", F.when(F.col("inverted"), 1 - F.col("coverage")).otherwise(F.col("coverage")))


def auto_polarity(px: DataFrame, radius: int) -> DataFrame:
    """Per image: dark and light coverage, the reading chosen (dark, flipped, light) and its coverage."""
    dark = coverage(sauvola(px, radius)).withColumnRenamed("coverage", "dark")
    light = coverage(sauvola(invert(px), radius)).withColumnRenamed("coverage", "light")
    both = dark.join(light, "img")
    flipped = F.when(F.col("dark") > FLIP_ABOVE, 1 - F.col("dark")).otherwise(F.col("dark"))
    light_score = coverage_score(F.col("light"))
    choice = (
        F.when(F.col("dark").between(ACCEPT_FROM, ACCEPT_TO), "dark")
        .when((light_score >= coverage_score(flipped)) & (light_score > USABLE), "light")
        .when(F.col("dark") > FLIP_ABOVE, "flipped")
        .otherwise("dark")
    )
    return both.withColumn("choice", choice).withColumn("coverage", F.when(F.col("choice") == "light", F.col("light")).when(F.col("choice") == "flipped", flipped).otherwise(F.col("dark")))


def despeckle(ink: DataFrame, least_neighbours: int = 2) -> DataFrame:
    """Clear ink with fewer ink neighbours (of eight) than least_neighbours."""
    boxed = box_sum(ink, 1, F.col("ink"), "_near")
    return boxed.withColumn("ink", F.when(F.col("_near") - F.col("ink") < least_neighbours, 0).otherwise(F.col("ink"))).drop("_near")


def row_profile(ink: DataFrame) -> DataFrame:
    """Ink per row, rows without ink included: (img, y, n)."""
    return ink.groupBy("img", "y").agg(F.sum("ink").cast("long").alias("n"))


def column_profile(ink: DataFrame) -> DataFrame:
    """Ink per column with its prefix sum: (img, x, n, before)."""
    cols = ink.groupBy("img", "x").agg(F.sum("ink").cast("long").alias("n"))
    return cols.withColumn("before", F.sum("n").over(Window.partitionBy("img").orderBy("x")) - F.col("n"))


def skew_scores(ink: DataFrame, angles: list[float]) -> DataFrame:
    """Squared deviation of the sheared row profile per angle: (img, i, deg, score)."""
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("deg"), F.tan(F.lit(a) * F.lit(3.141592653589793) / 180).alias("tan")) for i, a in enumerate(angles)])
    marks = ink.where("ink = 1").withColumn("a", F.explode(listed))
    yy = F.col("y") + half_up((F.col("x") - F.col("w") / 2) * F.col("a.tan"))
    rows = marks.select("img", "h", "a.i", "a.deg", yy.alias("yy")).where("yy >= 0 and yy < h").groupBy("img", "h", "i", "deg", "yy").agg(F.count("*").alias("n"))
    return rows.groupBy("img", "h", "i", "deg").agg((F.sum(F.col("n") * F.col("n")) - F.sum("n") * F.sum("n") / F.col("h")).alias("score")).drop("h")


def first_best(scores: DataFrame, *keys: str) -> DataFrame:
    """The first row with the highest score (to nine decimals) per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "i")
    return scores.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def rotate(ink: DataFrame, deg: float) -> DataFrame:
    """Nearest-pixel rotation about the centre: each target pixel looks up its source, 0 outside."""
    turn = F.lit(deg) * F.lit(3.141592653589793) / 180
    cx, cy = (F.col("w") - 1) / 2, (F.col("h") - 1) / 2
    sx = half_up((F.col("x") - cx) * F.cos(turn) + (F.col("y") - cy) * F.sin(turn) + cx)
    sy = half_up(-(F.col("x") - cx) * F.sin(turn) + (F.col("y") - cy) * F.cos(turn) + cy)
    target = ink.select("img", "w", "h", "y", "x", sx.alias("sx"), sy.alias("sy"))
    source = ink.select("img", F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy"), "ink")
    return target.join(source, ["img", "sx", "sy"], "left").select("img", "w", "h", "y", "x", F.coalesce("ink", F.lit(0)).alias("ink"))


def orient(px: DataFrame, orientation: int) -> DataFrame:
    """One of the eight photo orientations as an index remap; 5 to 8 swap width and height."""
    x, y, w, h = (F.col(c) for c in "xywh")
    to = {1: (x, y), 2: (w - 1 - x, y), 3: (w - 1 - x, h - 1 - y), 4: (x, h - 1 - y), 5: (y, x), 6: (h - 1 - y, x), 7: (h - 1 - y, w - 1 - x), 8: (y, w - 1 - x)}[orientation]
    swap = orientation >= 5
    rest = [c for c in px.columns if c not in "xywh"]
    return px.select(*rest, (h if swap else w).alias("w"), (w if swap else h).alias("h"), to[1].alias("y"), to[0].alias("x"))


def oriented(px: DataFrame) -> DataFrame:
    """Images with their own orientation each (img, w, h, y, x, v, orientation), upright; the column goes."""
    x, y, right, down, o = F.col("x"), F.col("y"), F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y"), F.col("orientation")
    across = F.when(o.isin(2, 3), right).when(o.isin(5, 8), y).when(o.isin(6, 7), down).otherwise(x)
    along = F.when(o.isin(3, 4), down).when(o.isin(5, 6), x).when(o.isin(7, 8), right).otherwise(y)
    swap = o >= 5
    rest = [c for c in px.columns if c not in ("w", "h", "y", "x", "orientation")]
    return px.select(*[c for c in rest if c == "img"], F.when(swap, F.col("h")).otherwise(F.col("w")).alias("w"), F.when(swap, F.col("w")).otherwise(F.col("h")).alias("h"), along.alias("y"), across.alias("x"), *[c for c in rest if c != "img"])


def downscale(px: DataFrame, scale: float) -> DataFrame:
    """Nearest-neighbour reduction by scale <= 1: each pixel goes to the places that take it, without a join."""
    nw, nh = (F.greatest(F.lit(1), half_up(F.col(c) * scale)).cast("int") for c in "wh")
    sized = px.select("img", "w", "h", "y", "x", "v", nw.alias("nw"), nh.alias("nh"))

    def takers(at: str, n: str, m: str) -> Column:
        # those at (t + 0.5) / scale, the last pixel also of what lies beyond
        first, last = F.greatest(F.lit(0), F.floor(F.col(at) * scale) - 1), F.when(F.col(at) < F.col(n) - 1, F.ceil((F.col(at) + 1) * scale)).otherwise(F.col(m) - 1)
        near = F.sequence(first.cast("int"), F.greatest(first, F.least(F.col(m) - 1, last)).cast("int"))
        return F.explode(F.filter(near, lambda t: (t < F.col(m)) & (F.least(F.col(n) - 1, F.floor((t + 0.5) / scale).cast("int")) == F.col(at))))

    rows = sized.withColumn("ny", takers("y", "h", "nh"))
    return rows.withColumn("nx", takers("x", "w", "nw")).select("img", F.col("nw").alias("w"), F.col("nh").alias("h"), F.col("ny").alias("y"), F.col("nx").alias("x"), "v")


def crop(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The half-open rectangle, shifted to the origin."""
    inside = px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))
    return inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0).withColumn("w", F.lit(x1 - x0)).withColumn("h", F.lit(y1 - y0))


def ink_runs(ink: DataFrame) -> DataFrame:
    """Maximal runs of ink in each row: (img, y, start, end), end exclusive."""
    w = Window.partitionBy("img", "y").orderBy("x")
    marked = ink.where("ink = 1").withColumn("_g", F.col("x") - F.row_number().over(w))
    return marked.groupBy("img", "y", "_g").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end")).drop("_g")


def ink_bounds(ink: DataFrame) -> DataFrame:
    """Half-open box of the ink of each image that has any."""
    return ink.where("ink = 1").groupBy("img").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))


def dice(ink: DataFrame, template: DataFrame, *keys: str) -> DataFrame:
    """2 * overlap / (template mass + ink) of each image with the template of its keys (y, x, mask in 0..1)."""
    met = ink.join(template, [*keys, "y", "x"])
    sums = met.groupBy("img", *keys).agg(F.sum(F.col("ink") * F.col("mask")).alias("both"), F.sum("mask").alias("mass"), F.sum("ink").alias("marks"))
    return sums.withColumn("dice", F.when(F.col("marks") == 0, F.lit(0.0)).otherwise(2 * F.col("both") / (F.col("mass") + F.col("marks"))))


def otsu(px: DataFrame) -> DataFrame:
    """Threshold of each image that maximises the between-class variance; the lowest of equals."""
    hist = px.groupBy("img", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("img").orderBy("v")
    whole = Window.partitionBy("img")
    cum = hist.select("img", F.col("v").alias("i"), F.sum("n").over(up).alias("n0"), F.sum(F.col("n") * F.col("v")).over(up).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1
    # variances of a tile reach 1e8, where doubles tell no more than eight decimals; equal ones that were added up differently agree in six
    scored = cum.where("n > n0").withColumn("score", F.round((F.col("n0") * n1) * (gap * gap) * 1e6) / 1e6)
    return first_best(scored.select("img", "i", "score"), "img").select("img", F.col("i").alias("threshold"))


def dilated(ink: DataFrame, radius: int) -> DataFrame:
    """Ink wherever the square of the radius around a pixel has any."""
    return box_sum(ink, radius, F.col("ink"), "_b").withColumn("ink", (F.col("_b") > 0).cast("int")).drop("_b")


def eroded(ink: DataFrame, radius: int) -> DataFrame:
    """Ink only where all of the square around a pixel (within the image) has it."""
    return box_sum(ink, radius, 1 - F.col("ink"), "_b").withColumn("ink", (F.col("_b") == 0).cast("int")).drop("_b")


def closed(ink: DataFrame, radius: int) -> DataFrame:
    """Small holes filled: dilated, then eroded."""
    return eroded(dilated(ink, radius), radius)


def opened(ink: DataFrame, radius: int) -> DataFrame:
    """Small marks removed: eroded, then dilated."""
    return dilated(eroded(ink, radius), radius)


def area_reduced(px: DataFrame, factor: int) -> DataFrame:
    """Means of squares of factor pixels; sides that don't fit are cut off by the mean of what is there."""
    cell = px.groupBy("img", F.expr(f"y div {factor}").cast("int").alias("y"), F.expr(f"x div {factor}").cast("int").alias("x"))
    return cell.agg(F.max(F.ceil(F.col("w") / factor)).cast("int").alias("w"), F.max(F.ceil(F.col("h") / factor)).cast("int").alias("h"), F.avg("v").alias("v"))


def crop_shares(px: DataFrame, top: float, side: float) -> DataFrame:
    """Images without a share of their height at the top and of their width at each side."""
    x0, y0 = half_up(F.col("w") * side).cast("int"), half_up(F.col("h") * top).cast("int")
    inside = px.withColumn("_x", x0).withColumn("_y", y0).where("x >= _x and x < w - _x and y >= _y")
    rest = [c for c in px.columns if c not in "xywh"]
    return inside.select(*rest, (F.col("w") - 2 * F.col("_x")).alias("w"), (F.col("h") - F.col("_y")).alias("h"), (F.col("y") - F.col("_y")).alias("y"), (F.col("x") - F.col("_x")).alias("x"))


def estimated_skew(ink: DataFrame, most: float = 12.0, coarse: int = 25, fine: int = 17) -> DataFrame:
    """(img, deg, score): the best angle of a coarse grid, then of a fine one of a coarse step to both sides; the first of equals.

    Images without ink have no row.
    """
    step = 2 * most / (coarse - 1)
    first = first_best(skew_scores(ink, [-most + i * step for i in range(coarse)]), "img").select("img", F.col("deg").alias("base"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(-step + 2 * step * i / (fine - 1)).alias("off")) for i in range(fine)])
    marks = ink.where("ink = 1").select("img", "w", "h", "y", "x").join(first, "img").withColumn("a", F.explode(near)).withColumn("deg", F.round(F.col("base") + F.col("a.off"), 9))
    yy = F.col("y") + half_up((F.col("x") - F.col("w") / 2) * F.tan(F.col("deg") * F.lit(3.141592653589793) / 180))
    rows = marks.select("img", "h", F.col("a.i").alias("i"), "deg", yy.alias("yy")).where("yy >= 0 and yy < h").groupBy("img", "h", "i", "deg", "yy").agg(F.count("*").alias("n"))
    scores = rows.groupBy("img", "h", "i", "deg").agg((F.sum(F.col("n") * F.col("n")) - F.sum("n") * F.sum("n") / F.col("h")).alias("score"))
    return first_best(scores, "img").select("img", "deg", "score")
