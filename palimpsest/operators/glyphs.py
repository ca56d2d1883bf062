"""Glyph tables (font, ch, adv, x0, y0, w, h, bitmap): extents, spacing, look-alikes; one row per letter of a font."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def extents(glyphs: DataFrame, em_px: int) -> DataFrame:
    """Per font, in em, over glyphs with a height: top, bottom, height, median_h (the upper median)."""
    tall = glyphs.where("h > 0").withColumn("bottom", F.col("y0") + F.col("h") / em_px)
    found = tall.groupBy("font").agg(F.min("y0").alias("top"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(F.col("h") / em_px)).alias("hs"))
    median = F.element_at("hs", (F.floor(F.size("hs") / 2) + 1).cast("int"))
    return found.select("font", "top", "bottom", (F.col("bottom") - F.col("top")).alias("height"), median.alias("median_h"))


def mean_advances(glyphs: DataFrame) -> DataFrame:
    """Per font the mean advance of the letters that have one; 0 without any."""
    return glyphs.groupBy("font").agg(F.coalesce(F.avg(F.when(F.col("adv") != 0, F.col("adv"))), F.lit(0.0)).alias("adv_em"))


def spacing(glyphs: DataFrame) -> DataFrame:
    """Per font: least and greatest advance and height, their spreads, and whether all advances are equal."""
    found = glyphs.groupBy("font").agg(*[f(c).alias(f"{n}_{c}") for c in ("adv", "h") for n, f in (("least", F.min), ("most", F.max))])
    return found.withColumn("adv_spread", F.col("most_adv") - F.col("least_adv")).withColumn("h_spread", F.col("most_h") - F.col("least_h")).withColumn("monospaced", F.col("adv_spread") == 0)


def look_alikes(glyphs: DataFrame) -> DataFrame:
    """Groups of letters of a font with the same bitmap: (font, grp, n), letters in order."""
    found = glyphs.groupBy("font", "bitmap").agg(F.array_sort(F.collect_list("ch")).alias("chs")).where(F.size("chs") > 1)
    return found.select("font", F.array_join("chs", "").alias("grp"), F.size("chs").alias("n"))


def signatures(glyphs: DataFrame, places: tuple[int, int, int]) -> DataFrame:
    """Per font: letters, and distinct signatures of size, three bytes of the bitmap and advance."""
    look = F.concat_ws("/", "w", "h", *[F.substring("bitmap", p + 1, 1) for p in places], "adv")
    return glyphs.withColumn("look", look).groupBy("font").agg(F.count("*").alias("letters"), F.countDistinct("look").alias("looks"))


def usable(glyphs: DataFrame, space_adv: DataFrame, default: float = 0.25) -> DataFrame:
    """Glyphs that have ink, with the advance of their font's space (default where the font has none)."""
    return glyphs.where("w > 0 and h > 0").join(space_adv.select("font", "space_adv"), "font", "left").withColumn("space_adv", F.coalesce("space_adv", F.lit(default)))


def ambiguity(groups: DataFrame) -> DataFrame:
    """(font, ch, alternatives) of groups (font, grp): LV gives L and V the alternatives L/V."""
    cells = F.filter(F.split("grp", ""), lambda c: c != "")
    return groups.select("font", F.explode(cells).alias("ch"), F.array_join(cells, "/").alias("alternatives"))


def shape_sums(glyphs: DataFrame) -> DataFrame:
    """Templates of letters by many drawn glyphs (letter, y, x, v): (letter, y, x, dark, n), the darkness of all in sum and how many they are."""
    return glyphs.groupBy("letter", "y", "x").agg(F.sum(255 - F.col("v")).alias("dark"), F.count("*").alias("n"))


def read_alone(ink: DataFrame, templates: DataFrame) -> DataFrame:
    """Single glyphs of ink (img, y, x, ink) read by their best template (letter, y, x, dark, n): (img, got, dice).

    The likeness is twice the shared ink over the template's and the glyph's; sums are whole numbers, so equals are equal, and the first letter
    of them is read. A glyph without ink reads as nothing. An alphabet's templates are few and go to every pixel.
    """
    met = ink.join(templates, ["y", "x"])
    sums = met.groupBy("img", "letter").agg(F.sum(F.col("ink") * F.col("dark")).alias("both"), F.sum("dark").alias("mass"), F.sum(F.col("ink") * F.col("n") * 255).alias("marks"))
    scored = sums.withColumn("dice", F.when(F.col("marks") == 0, F.lit(0.0)).otherwise(2 * F.col("both") / (F.col("mass") + F.col("marks"))))
    best = scored.groupBy("img").agg(F.min(F.struct((-F.col("dice")).alias("d"), "letter")).alias("b"))
    return best.select("img", F.when(F.col("b.d") == 0, "").otherwise(F.col("b.letter")).alias("got"), (-F.col("b.d")).alias("dice"))
