"""Drawing pages of text in a glyph alphabet, as joins of letters with glyph pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators.alphabet import EM
from palimpsest.operators.reading import half_up, resampled

#: Layout in em: line height, margin, baseline below a line's top, advance of a space.
LINE_EM, MARGIN_EM, BASELINE_EM, SPACE_EM = 1.9, 0.9, 1.1, 0.5


def wrapped(texts: DataFrame, width: int) -> DataFrame:
    """(key, text) of words parted by single spaces -> (key, line, text): lines of at most width letters, longer words alone."""
    cut = F.expr(
        f"""aggregate(filter(split(text, ' '), t -> t <> ''), cast(array() as array<string>), (acc, t) ->
          if(size(acc) > 0 and length(acc[size(acc) - 1]) + 1 + length(t) <= {width}, concat(slice(acc, 1, size(acc) - 1), array(concat(acc[size(acc) - 1], ' ', t))), concat(acc, array(t))))"""
    )
    return texts.select("key", F.posexplode(cut).alias("line", "text"))


def glyph_pixels(spark: SparkSession, glyphs: list[dict], em: int) -> DataFrame:
    """(ch, gx, gy) of each inked pixel of an alphabet at a size; some hundred rows a letter."""
    rows = []
    for g in glyphs:
        shape = np.frombuffer(g["bitmap"], np.uint8).reshape(g["h"], g["w"]).astype(float)
        dark = resampled(shape, max(1, half_up(g["h"] * em / EM)), max(1, half_up(g["w"] * em / EM))) > 0.5
        rows += [(g["ch"], int(x), int(y)) for y, x in zip(*np.nonzero(dark), strict=True)]
    return spark.createDataFrame(rows, "ch string, gx int, gy int")


def pens(lines: DataFrame, glyphs: list[dict], em: int) -> DataFrame:
    """(key, line, pos, ch, pen): pen position in pixels of each letter, by the advances before it."""
    spark = lines.sparkSession
    adv = spark.createDataFrame([(g["ch"], g["adv"] * em, g["x0"] * em, g["y0"] * em) for g in glyphs], "ch string, adv double, dx double, dy double")
    chars = lines.select("key", "line", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''").join(F.broadcast(adv), "ch", "left")  # one row per letter of an alphabet
    chars = chars.withColumn("adv", F.coalesce("adv", F.lit(SPACE_EM * em)))
    before = F.sum("adv").over(Window.partitionBy("key", "line").orderBy("pos")) - F.col("adv")
    return chars.withColumn("pen", MARGIN_EM * em + before)


def drawn(lines: DataFrame, glyphs: list[dict], em: int) -> tuple[DataFrame, DataFrame]:
    """Lines (key, line, text) drawn as pages: sparse ink (key, y, x) and sizes (key, w, h)."""
    placed = pens(lines, glyphs, em)
    ends = placed.groupBy("key").agg(F.max(F.col("pen") + F.col("adv")).alias("x"), F.max("line").alias("last"))
    size = ends.select("key", F.floor(F.col("x") + MARGIN_EM * em + 0.5).cast("int").alias("w"), F.floor((F.col("last") + 1) * LINE_EM * em + 2 * MARGIN_EM * em + 0.5).cast("int").alias("h"))
    top = F.floor(MARGIN_EM * em + F.col("line") * LINE_EM * em + BASELINE_EM * em + F.col("dy") + 0.5)
    dots = placed.where("dx is not null").join(F.broadcast(glyph_pixels(lines.sparkSession, glyphs, em)), "ch")
    ink = dots.select("key", (top + F.col("gy")).cast("int").alias("y"), (F.floor(F.col("pen") + F.col("dx") + 0.5) + F.col("gx")).cast("int").alias("x")).distinct()
    return ink, size


#: Per level of damage, the light's ramp from the left to the right edge and the noise's deviation.
LEVELS = {"clean": (1.0, 1.0, 0.0), "light": (1.0, 1.0, 4.0), "phone": (0.45, 1.2, 9.0), "bad": (0.45, 1.2, 15.0)}


def damaged(px: DataFrame, levels: dict[str, tuple[float, float, float]] = LEVELS) -> DataFrame:
    """Gray pixels (img, w, h, y, x, v) at every level: uneven light, then noise.

    Noise is the sum of four hashes of the pixel's place, so the same pixel is damaged alike each time.
    """
    rows = px.sparkSession.createDataFrame([(k, *v) for k, v in levels.items()], "level string, dark double, bright double, sigma double")
    at = px.crossJoin(F.broadcast(rows))  # as many copies as there are levels
    light = F.col("dark") + (F.col("bright") - F.col("dark")) * F.col("x") / F.greatest(F.lit(1), F.col("w") - 1)
    noise = sum((F.pmod(F.crc32(F.concat_ws("/", "level", "img", "y", "x", F.lit(i)).cast("binary")), F.lit(1000)) / 999.0 for i in range(4)), F.lit(0.0)) - 2.0
    value = F.col("v") * light + noise * F.sqrt(F.lit(3.0)) * F.col("sigma")
    return at.select("img", "level", "w", "h", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(value, 6) + 0.5))).cast("int").alias("v"))
