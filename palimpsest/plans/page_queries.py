"""Pages of benchmark texts: drawn, cut into lines, read back and rated; lines of part names for the choice of a font."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluate as V, glyphs as G, lines as L, pages as D, reading as R
from palimpsest.operators.alphabet import EM, GLYPH_SCHEMA, glyphs
from palimpsest.plans.tile_queries import _tiles, query
from palimpsest.plans.sqltext import TILES
from palimpsest.tables import materialize, table

SIZE, WIDTH = 20, 26
TWINS = ("LV", "QT")


def _fonts(spark, atlas):
    """The alphabets' extents and mean advances, one row each."""
    rows = spark.createDataFrame([tuple(g.values()) for gs in atlas.values() for g in gs], GLYPH_SCHEMA)
    return G.extents(rows, EM).join(G.mean_advances(rows), "font")


def _lines(spark, d):
    """Whole benchmark texts, folded, as lines of at most WIDTH letters."""
    texts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), T.translit_spaced(F.col("text")).alias("text")).where("text <> ''")
    return D.wrapped(texts, WIDTH)


def _pages(spark, d):
    ink, sizes = D.drawn(_lines(spark, d), glyphs(1, twins=TWINS), SIZE)
    return materialize(ink, "page-ink"), materialize(sizes, "page-sizes")


@query()
def page_ink(spark, d):
    """Pages as drawn: size, ink, and ink per letter."""
    ink, sizes = _pages(spark, d)
    letters = _lines(spark, d).groupBy("key").agg(F.sum(F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("letters"), F.count("*").alias("n_lines"))
    return sizes.join(ink.groupBy("key").agg(F.count("*").alias("ink")), "key").join(letters, "key").withColumn("per_letter", F.round(F.col("ink") / F.col("letters"), 6))


@query()
def page_lines(spark, d):
    """The lines found on each page, with the bounds of their ink."""
    ink, sizes = _pages(spark, d)
    return L.bounded_lines(L.line_bands(L.page_profiles(ink, sizes)), ink)


@query()
def page_ways(spark, d):
    """How the lines of each page are found, the pitch, and how many there are and should be."""
    ink, sizes = _pages(spark, d)
    want = _lines(spark, d).groupBy("key").agg(F.count("*").alias("want"))
    return L.line_bands(L.page_profiles(ink, sizes)).select("key", "way", "pitch", F.size("found").alias("n_lines")).join(want, "key")


def _read(spark, d):
    atlas = {"alphabet-1": glyphs(1, twins=TWINS)}
    ink, sizes = _pages(spark, d)
    lines = L.bounded_lines(L.line_bands(L.page_profiles(ink, sizes)), ink)
    cropped = materialize(L.cropped_lines(lines, ink, sizes).withColumn("font", F.lit("alphabet-1")), "cropped-lines")
    return R.read_lines(cropped, _fonts(spark, atlas), atlas, EM)


@query()
def page_read(spark, d):
    """Every page read back and rated, letters that look the same counting as one."""
    got = R.page_readings(_read(spark, d))
    want = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), T.translit_spaced(F.col("text")).alias("want")).where("want <> ''")
    flat = [T.canonical(F.replace(c, F.lit("\n"), F.lit(" ")), "VQ", "LT") for c in (F.col("want"), F.coalesce("text", F.lit("")))]
    rated = want.join(got, "key", "left").withColumn("cer", F.round(T.cer(*flat), 6))
    return rated.select("key", "want", "text", "cer", F.round("confidence", 6).alias("confidence"), "n_lines")


@query()
def font_choice(spark, d):
    """Each kind of part name drawn in one of three alphabets by its length, read with all three; the best reading's alphabet."""
    atlas = {f"alphabet-{n}": glyphs(n) for n in (1, 2, 3)}
    names = table(spark, d, "part").select(T.translit_spaced(F.col("p_name")).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("parts"))
    drawn = []
    for n, rows in enumerate(atlas.values()):
        own = names.where(F.length("text") % 3 == n).select(F.col("text").alias("key"), "text")
        drawn.append(D.drawn(D.wrapped(own, 6), rows, SIZE))  # a page of one line would be taken for a page without gaps
    ink, sizes = (materialize(a.unionByName(b).unionByName(c), "name-pages") for a, b, c in zip(*drawn, strict=True))
    lines = L.bounded_lines(L.line_bands(L.page_profiles(ink, sizes)), ink)
    cropped = L.cropped_lines(lines, ink, sizes)
    tried = materialize(V.grid(cropped, spark.createDataFrame([(f,) for f in atlas], "font string")), "lines-and-fonts")
    best = R.best_font(R.page_readings(R.read_lines(tried, _fonts(spark, atlas), atlas, EM)))
    return names.join(best, names["text"] == best["key"]).select(names["text"], "parts", F.concat(F.lit("alphabet-"), F.length(names["text"]) % 3 + 1).alias("drawn"), "font", F.replace(best["text"], F.lit("\n"), F.lit(" ")).alias("got"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {TILES}, lv AS (SELECT * FROM (VALUES ('even', 1.0::DOUBLE, 1.0::DOUBLE), ('ramp', 0.45::DOUBLE, 1.2::DOUBLE)) t(level, dark, bright)),
q AS (SELECT img, level, y, x, v * (dark + (bright - dark) * x / 7) AS lit FROM px, lv)
SELECT img, level, CAST(sum(greatest(0, least(255, floor(round(lit, 6) + 0.5)))) AS BIGINT) AS total FROM q GROUP BY img, level""")
def tile_light_ramp(spark, d):
    """Tiles in even and in uneven light, without noise."""
    return D.damaged(_tiles(spark, d), {"even": (1.0, 1.0, 0.0), "ramp": (0.45, 1.2, 0.0)}).groupBy("img", "level").agg(F.sum("v").alias("total"))


@query()
def tile_levels(spark, d):
    """Gray statistics of the tiles at each level of damage."""
    return D.damaged(_tiles(spark, d)).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("deviation"))
