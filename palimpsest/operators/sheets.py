"""Images for looking at: crops, sheets of many images, lines below each other, boxes drawn in, images packed to bytes.

All are pixel tables (img, w, h, y, x, v), dense grids of gray values, as everywhere; layers are laid over each other by one
aggregation over images that are dealt out to tasks. Only `packed` makes one row of an image, as a file needs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators import geometry
from palimpsest.operators.pixels import dealt, half_up

#: Paper, background between lines, frames and boxes; room between lines of a montage and between two strips.
PAPER, BETWEEN, FRAME, BOX = 255, 205, 180, 128
LINE_GAP, STRIP_GAP = 6, 16


def gray_ink(ink: DataFrame, dark: int = 0, light: int = PAPER) -> DataFrame:
    """Ink as gray values."""
    return ink.select("img", "w", "h", "y", "x", F.when(F.col("ink") == 1, dark).otherwise(light).alias("v"))


def image_sizes(px: DataFrame) -> DataFrame:
    """(img, w, h) of dense images, by their first pixels."""
    return px.where("y = 0 and x = 0").select("img", "w", "h")


def canvas(sizes: DataFrame, v: int = PAPER) -> DataFrame:
    """Images (img, w, h) of one value."""
    rows = sizes.select("img", "w", "h", F.explode(F.expr("sequence(0, h - 1)")).alias("y"))
    return rows.select("img", "w", "h", "y", F.explode(F.expr("sequence(0, w - 1)")).alias("x"), F.lit(v).alias("v"))


def painted(ground: DataFrame, *layers: DataFrame) -> DataFrame:
    """Layers (img, y, x, v) over dense images, later ones over earlier; what lies outside of the image goes.

    Of several pixels of one layer at one place the lightest shows.
    """

    def named(px: DataFrame, no: int, w: Column, h: Column) -> DataFrame:
        return px.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), w.cast("int").alias("w"), h.cast("int").alias("h"), F.struct(F.lit(no).alias("layer"), F.col("v").cast("int").alias("v")).alias("top"))

    every = named(ground, 0, F.col("w"), F.col("h"))
    for no, layer in enumerate(layers, 1):
        every = every.unionByName(named(layer, no, F.lit(None), F.lit(None)))
    seen = dealt(every).groupBy("img", "y", "x").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.max("top").alias("top"))
    return seen.where("w is not null").select("img", "w", "h", "y", "x", F.col("top.v").alias("v"))


def box_edges(boxes: DataFrame, v: int = BOX, thick: int = 1) -> DataFrame:
    """Edges of half-open boxes (img, x0, x1, y0, y1), drawn inwards: (img, y, x, v); boxes without area have none."""
    rows = boxes.where("x1 > x0 and y1 > y0").withColumn("y", F.explode(F.expr("sequence(y0, y1 - 1)")))
    whole, sides = "sequence(x0, x1 - 1)", f"filter(sequence(x0, x1 - 1), x -> x < x0 + {thick} or x >= x1 - {thick})"
    edge = F.expr(f"if(y < y0 + {thick} or y >= y1 - {thick}, {whole}, {sides})")
    return rows.select("img", "y", F.explode(edge).alias("x"), F.lit(v).alias("v"))


def overlaid(ink: DataFrame, boxes: DataFrame, thick: int = 3) -> DataFrame:
    """Pages of ink with boxes (img, x0, x1, y0, y1) around what was found."""
    return painted(gray_ink(ink), box_edges(boxes, thick=thick))


def cropped(px: DataFrame, boxes: DataFrame, value: str = "v") -> DataFrame:
    """The part of each image within its half-open box (img, x0, x1, y0, y1), cut at the image's borders; images without such a part go."""
    low = {c: F.greatest(F.lit(0), F.col(f"{c}0")) for c in "xy"}
    high = {"x": F.least("w", "x1"), "y": F.least("h", "y1")}
    met = px.join(boxes.select("img", "x0", "x1", "y0", "y1"), "img").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    size = {"w": high["x"] - low["x"], "h": high["y"] - low["y"]}
    return met.select("img", *[size[c].cast("int").alias(c) for c in "wh"], *[(F.col(c) - low[c]).cast("int").alias(c) for c in "yx"], value)


def enlarged(px: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a square of so many a side."""
    many = F.array(*[F.lit(i) for i in range(factor)])
    rows = px.withColumn("_y", F.explode(many))
    cells = rows.withColumn("_x", F.explode(many))
    return cells.select("img", (F.col("w") * factor).alias("w"), (F.col("h") * factor).alias("h"), (F.col("y") * factor + F.col("_y")).alias("y"), (F.col("x") * factor + F.col("_x")).alias("x"), "v")


def stacked(px: DataFrame, places: DataFrame, gap: int = LINE_GAP, ground: int = BETWEEN, around: bool = True) -> DataFrame:
    """Images below each other, one sheet (as img) for all images of it: places (img, sheet, no), no telling the order.

    A sheet is as wide as its widest image, with a gap between images, and above and below them if around. A sheet's list of images
    is one group, so it should be what one looks at: the lines of a page, not a table.
    """
    margin = gap if around else 0
    sized = image_sizes(px).join(places, "img")
    above = Window.partitionBy("sheet").orderBy("no", "img").rowsBetween(Window.unboundedPreceding, -1)
    tops = sized.select("img", "sheet", (F.coalesce(F.sum(F.col("h") + gap).over(above), F.lit(0)) + margin).alias("top"))
    sheets = sized.groupBy(F.col("sheet").alias("img")).agg(F.max("w").alias("w"), (F.sum(F.col("h") + gap) - gap + 2 * margin).alias("h"))
    moved = px.join(tops, "img").select(F.col("sheet").alias("img"), (F.col("y") + F.col("top")).alias("y"), "x", "v")
    return painted(canvas(sheets, ground), moved)


def contact_sheets(px: DataFrame, places: DataFrame, cell: int, columns: int, room: int, inset: int = 4) -> DataFrame:
    """Images in framed cells, `columns` a row: places (img, sheet, place), place counting a sheet's cells from 0.

    An image that is larger than its cell without room on each side is reduced by area, never enlarged, and stands in the middle. A sheet
    reaches to the row of its last place.
    """
    space = cell - 2 * room
    scale = F.least(F.lit(float(space)) / F.col("w"), F.lit(float(space)) / F.col("h"), F.lit(1.0))
    side = lambda c: F.greatest(F.lit(1), F.floor(F.round(F.col(c) * scale, 9)))
    small = geometry.area_resized(px, side("w"), side("h"))
    corner = places.select("img", "sheet", F.expr(f"place % {columns} * {cell}").alias("ox"), F.expr(f"place div {columns} * {cell}").alias("oy"))
    middle = lambda o, at, n: F.expr(f"{o} + ({cell} - {n}) div 2 + {at}")
    drawn = small.join(corner, "img").select(F.col("sheet").alias("img"), middle("oy", "y", "h").alias("y"), middle("ox", "x", "w").alias("x"), half_up(F.col("v")).alias("v"))
    frames = corner.select(F.col("sheet").alias("img"), *[F.expr(f"o{c} + {n}").alias(f"{c}{i}") for c in "xy" for i, n in enumerate((inset, cell - inset))])
    sheets = places.groupBy(F.col("sheet").alias("img")).agg(F.lit(columns * cell).alias("w"), F.expr(f"(max(place) div {columns} + 1) * {cell}").alias("h"))
    return painted(canvas(sheets), box_edges(frames, FRAME), drawn)


def compared(strips: DataFrame, pairs: DataFrame, part: int = 900, factor: int = 2) -> DataFrame:
    """Strips of one pair (img, sheet, no) below each other, the first `part` columns, enlarged."""
    both = stacked(strips, pairs, STRIP_GAP, PAPER, around=False)
    start = image_sizes(both).select("img", F.lit(0).alias("x0"), F.lit(part).alias("x1"), F.lit(0).alias("y0"), F.col("h").alias("y1"))
    return enlarged(cropped(both, start), factor)


def packed(px: DataFrame) -> DataFrame:
    """Dense images as (img, w, h, gray): bytes row by row. Rows are put together first, then images of rows."""
    digits = F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.col("v"))).cast("long")), 2, "0")

    def joined(at: str, part: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), part.alias("part")))), lambda r: r["part"]), "")

    rows = px.groupBy("img", "w", "h", "y").agg(joined("x", digits).alias("row"))
    return rows.groupBy("img", "w", "h").agg(F.unhex(joined("y", F.col("row"))).alias("gray"))
