"""Pixel operators over embedding tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import pixels as P
from palimpsest.operators.ctc import greedy
from palimpsest.plans.sqltext import TILES, boxed, inked
from palimpsest.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tiles(spark, d):
    return P.tiles(table(spark, d, "embeddings"))


def _ink(spark, d):
    return P.sauvola(_tiles(spark, d), P.sauvola_radius(8, 8))


INK = f"WITH {TILES}, {inked('px', 'ink')}"


@query(f"WITH {TILES} SELECT v, count(*) AS n FROM px GROUP BY v")
def tile_gray_hist(spark, d):
    return _tiles(spark, d).groupBy("v").agg(F.count("*").alias("n"))


@query(f"WITH {TILES} SELECT img, CAST(sum(255 - v) AS BIGINT) AS inverted_sum, CAST(max(255 - v) AS INT) AS brightest FROM px GROUP BY img")
def tile_invert(spark, d):
    return P.invert(_tiles(spark, d)).groupBy("img").agg(F.sum("v").alias("inverted_sum"), F.max("v").alias("brightest"))


@query(f"""WITH {TILES}, a AS (SELECT *, sum(v) OVER (PARTITION BY img, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS a, sum(v * v) OVER (PARTITION BY img, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS b FROM px)
SELECT img, y, x, CAST(sum(a) OVER (PARTITION BY img, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, CAST(sum(b) OVER (PARTITION BY img, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s2 FROM a""")
def tile_integral(spark, d):
    return P.integral(_tiles(spark, d)).select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "s", "s2")


@query(f"WITH {TILES}, {boxed('px', 'bx', 2, 'v')} SELECT img, y, x, CAST(b AS BIGINT) AS b FROM bx")
def tile_box_sum(spark, d):
    return P.box_sum(_tiles(spark, d), 2, F.col("v").cast("long"), "b").select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "b")


@query(f"{INK} SELECT img, round(sum(ink) / count(*), 6) AS coverage FROM ink GROUP BY img")
def tile_sauvola_coverage(spark, d):
    return P.coverage(_ink(spark, d)).select("img", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {TILES}, both_ways AS (SELECT img * 2 AS img, y, x, v FROM px UNION ALL SELECT img * 2 + 1, y, x, 255 - v FROM px), {inked('both_ways', 'ink')},
c AS (SELECT img, sum(ink) / count(*) AS c FROM ink GROUP BY img)
SELECT img, round(c, 6) AS coverage, c > 0.35 AS inverted, round(CASE WHEN c > 0.35 THEN 1 - c ELSE c END, 6) AS final_coverage FROM c""")
def tile_polarity(spark, d):
    px = _tiles(spark, d)
    both = px.withColumn("img", F.col("img") * 2).unionByName(P.invert(px).withColumn("img", F.col("img") * 2 + 1))
    out = P.flip_if_heavy(P.coverage(P.sauvola(both, 4)))
    return out.select("img", F.round("coverage", 6).alias("coverage"), "inverted", F.round("final_coverage", 6).alias("final_coverage"))


@query(f"""WITH {TILES}, inv AS (SELECT img, y, x, 255 - v AS v FROM px), {inked('px', 'dk')}, {inked('inv', 'lt')},
d AS (SELECT img, sum(ink) / count(*) AS dark FROM dk GROUP BY img), l AS (SELECT img, sum(ink) / count(*) AS light FROM lt GROUP BY img),
b AS (SELECT img, dark, light, CASE WHEN dark > 0.35 THEN 1 - dark ELSE dark END AS flipped FROM d JOIN l USING (img)),
s AS (SELECT *, CASE WHEN light < 0.008 OR light > 0.42 THEN -100.0 ELSE -abs(ln(light / 0.10)) END AS ls, CASE WHEN flipped < 0.008 OR flipped > 0.42 THEN -100.0 ELSE -abs(ln(flipped / 0.10)) END AS fs FROM b),
ch AS (SELECT *, CASE WHEN dark BETWEEN 0.03 AND 0.30 THEN 'dark' WHEN ls >= fs AND ls > -50 THEN 'light' WHEN dark > 0.35 THEN 'flipped' ELSE 'dark' END AS choice FROM s)
SELECT img, round(dark, 6) AS dark, round(light, 6) AS light, choice, round(CASE choice WHEN 'light' THEN light WHEN 'flipped' THEN flipped ELSE dark END, 6) AS coverage FROM ch""")
def tile_auto_polarity(spark, d):
    out = P.auto_polarity(_tiles(spark, d), 4)
    return out.select("img", F.round("dark", 6).alias("dark"), F.round("light", 6).alias("light"), "choice", F.round("coverage", 6).alias("coverage"))


@query(f"{INK}, {boxed('ink', 'nb', 1, 'ink')} SELECT img, CAST(sum(ink) AS BIGINT) AS before_n, CAST(sum(CASE WHEN b - ink < 2 THEN 0 ELSE ink END) AS BIGINT) AS after_n FROM nb GROUP BY img")
def tile_despeckle(spark, d):
    ink = _ink(spark, d).withColumn("was", F.col("ink"))
    return P.despeckle(ink).groupBy("img").agg(F.sum("was").alias("before_n"), F.sum("ink").alias("after_n"))


@query(f"{INK} SELECT img, y, CAST(sum(ink) AS BIGINT) AS n FROM ink GROUP BY img, y")
def tile_row_profile(spark, d):
    return P.row_profile(_ink(spark, d)).withColumn("y", F.col("y").cast("long"))


@query(f"""{INK}, cols AS (SELECT img, x, sum(ink) AS n FROM ink GROUP BY img, x)
SELECT img, x, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (PARTITION BY img ORDER BY x) - n AS BIGINT) AS before FROM cols""")
def tile_column_prefix(spark, d):
    return P.column_profile(_ink(spark, d)).withColumn("x", F.col("x").cast("long"))


ANGLES = [float(a) for a in range(-12, 13, 3)]


@query(f"""{INK}, ang AS (SELECT i, -12.0 + 3 * i AS deg FROM range(0, 9) t(i)), m AS (
  SELECT img, i, deg, y + floor((x - 4.0) * tan(deg * 3.141592653589793 / 180) + 0.5) AS yy FROM ink, ang WHERE ink = 1),
r AS (SELECT img, i, deg, yy, count(*) AS n FROM m WHERE yy >= 0 AND yy < 8 GROUP BY img, i, deg, yy),
s AS (SELECT img, i, deg, sum(n * n) - sum(n) * sum(n) / 8 AS score FROM r GROUP BY img, i, deg)
SELECT img, CAST(deg AS DOUBLE) AS deg, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(score, 9) DESC, i) AS k FROM s) WHERE k = 1""")
def tile_skew_argmax(spark, d):
    return P.first_best(P.skew_scores(_ink(spark, d), ANGLES), "img").select("img", "deg", F.round("score", 6).alias("score"))


@query(f"""{INK}, t AS (SELECT img, y, x, floor((x - 3.5) * cos(30.0 * 3.141592653589793 / 180) + (y - 3.5) * sin(30.0 * 3.141592653589793 / 180) + 3.5 + 0.5) AS sx,
  floor(-(x - 3.5) * sin(30.0 * 3.141592653589793 / 180) + (y - 3.5) * cos(30.0 * 3.141592653589793 / 180) + 3.5 + 0.5) AS sy FROM ink)
SELECT t.img, CAST(sum(coalesce(k.ink, 0)) AS BIGINT) AS n, CAST(sum(coalesce(k.ink, 0) * (8 * t.y + t.x)) AS BIGINT) AS moment FROM t LEFT JOIN ink k ON k.img = t.img AND k.x = t.sx AND k.y = t.sy GROUP BY t.img""")
def tile_rotate(spark, d):
    return P.rotate(_ink(spark, d), 30.0).groupBy("img").agg(F.sum("ink").alias("n"), F.sum(F.col("ink") * (8 * F.col("y") + F.col("x"))).alias("moment"))


@query(f"WITH {TILES} SELECT img, CAST(sum(v * (8 * x + 7 - y)) AS BIGINT) AS moment FROM px GROUP BY img")
def tile_orient(spark, d):
    return P.orient(_tiles(spark, d), 6).groupBy("img").agg(F.sum((F.col("v") * (8 * F.col("y") + F.col("x"))).cast("long")).alias("moment"))


@query(f"WITH {TILES}, g AS (SELECT a.i AS ny, b.i AS nx FROM range(0, 4) a(i), range(0, 4) b(i)) SELECT img, ny AS y, nx AS x, v FROM g JOIN px ON px.y = least(7, floor((ny + 0.5) / 0.5)) AND px.x = least(7, floor((nx + 0.5) / 0.5))")
def tile_downscale(spark, d):
    return P.downscale(_tiles(spark, d), 0.5).select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


@query(f"WITH {TILES} SELECT img, y - 1 AS y, x - 2 AS x, v FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6")
def tile_crop(spark, d):
    return P.crop(_tiles(spark, d), 2, 1, 6, 7).select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


@query(f"{INK}, g AS (SELECT img, y, x, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS g FROM ink WHERE ink = 1) SELECT img, y, min(x) AS start, max(x) + 1 AS \"end\" FROM g GROUP BY img, y, g")
def tile_runs(spark, d):
    return P.ink_runs(_ink(spark, d)).select("img", *[F.col(c).cast("long").alias(c) for c in ("y", "start", "end")])


@query(f"{INK} SELECT img, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM ink WHERE ink = 1 GROUP BY img")
def tile_bounds(spark, d):
    return P.ink_bounds(_ink(spark, d)).select("img", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(f"{INK}, b AS (SELECT img, min(x) AS first_ink FROM ink WHERE ink = 1 GROUP BY img) SELECT img, first_ink, greatest(0, first_ink - 2) AS start_from FROM b")
def tile_first_ink(spark, d):
    b = P.ink_bounds(_ink(spark, d)).select("img", F.col("x0").cast("long").alias("first_ink"))
    return b.withColumn("start_from", F.greatest(F.lit(0).cast("long"), F.col("first_ink") - 2))


@query(f"""{INK}, t AS (SELECT label, y, x, round(avg((255 - v) / 255), 9) AS mask FROM px GROUP BY label, y, x),
s AS (SELECT img, ink.label, sum(ink * mask) AS c, sum(mask) AS mass, sum(ink) AS marks FROM ink JOIN t ON t.label = ink.label AND t.y = ink.y AND t.x = ink.x GROUP BY img, ink.label)
SELECT img, label, round(CASE WHEN marks = 0 THEN 0.0 ELSE 2 * c / (mass + marks) END, 6) AS dice FROM s""")
def tile_dice_vs_label_template(spark, d):
    px = _tiles(spark, d)
    template = px.groupBy("label", "y", "x").agg(F.round(F.avg((255 - F.col("v")) / 255), 9).alias("mask"))
    return P.dice(_ink(spark, d), template, "label").select("img", "label", F.round("dice", 6).alias("dice"))


@query(f"""WITH {TILES}, h AS (SELECT img, v, count(*) AS n FROM px GROUP BY img, v),
c AS (SELECT img, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY img) AS n, sum(n * v) OVER (PARTITION BY img) AS s FROM h WINDOW u AS (PARTITION BY img ORDER BY v)),
s AS (SELECT img, v, n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) AS score FROM c WHERE n > n0)
SELECT img, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(score, 6) DESC, v) AS k FROM s) WHERE k = 1""")
def tile_otsu(spark, d):
    return P.otsu(_tiles(spark, d))


CTC = f"""WITH {TILES}, r AS (SELECT img, y, x, v, row_number() OVER (PARTITION BY img, y ORDER BY v DESC, x) AS k FROM px),
st AS (SELECT img, y, max(CASE WHEN k = 1 THEN x END) AS best, max(CASE WHEN k = 1 THEN v END) / 32.0 AS v1, max(CASE WHEN k = 2 THEN v END) / 32.0 AS v2 FROM r WHERE k <= 2 GROUP BY img, y),
l AS (SELECT *, lag(best, 1, -1) OVER (PARTITION BY img ORDER BY y) AS before FROM st)"""


@query(CTC + """ SELECT img, trim(regexp_replace(string_agg(CASE WHEN best <> 0 AND best <> before THEN substr(' ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(best AS INT), 1) ELSE '' END, '' ORDER BY y), ' +', ' ', 'g')) AS text FROM l GROUP BY img""")
def ctc_greedy_tiles(spark, d):
    logits = _tiles(spark, d).select(F.col("img").alias("key"), F.col("y").alias("t"), F.col("x").alias("c"), (F.col("v") / 32.0).alias("v"))
    return greedy(logits).select(F.col("key").alias("img"), "text")


@query(CTC + " SELECT img, round(avg(1 / (1 + exp(-(v1 - v2)))), 6) AS confidence FROM l GROUP BY img")
def ctc_confidence(spark, d):
    logits = _tiles(spark, d).select(F.col("img").alias("key"), F.col("y").alias("t"), F.col("x").alias("c"), (F.col("v") / 32.0).alias("v"))
    return greedy(logits).select(F.col("key").alias("img"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {TILES} SELECT img, CAST(sum((v * 77 + (255 - v) * 150 + (v * 7 % 256) * 29) >> 8) AS BIGINT) AS total FROM px GROUP BY img")
def tile_gray_of_channels(spark, d):
    """Gray of three channels made of a tile's values."""
    v = F.col("v")
    return _tiles(spark, d).select("img", P.gray(v, 255 - v, v * 7 % 256).cast("long").alias("g")).groupBy("img").agg(F.sum("g").alias("total"))


def _near(name: str, source: str, value: str) -> str:
    return f"{boxed(source, name, 1, value)}"


@query(f"{INK}, {_near('dl', 'ink', 'ink')} SELECT img, CAST(sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM dl GROUP BY img")
def tile_dilate(spark, d):
    return P.dilated(_ink(spark, d), 1).groupBy("img").agg(F.sum("ink").alias("n"))


@query(f"{INK}, {_near('er', 'ink', '1 - ink')} SELECT img, CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM er GROUP BY img")
def tile_erode(spark, d):
    return P.eroded(_ink(spark, d), 1).groupBy("img").agg(F.sum("ink").alias("n"))


@query(f"{INK}, {_near('dl', 'ink', 'ink')}, k2 AS (SELECT img, y, x, CASE WHEN b > 0 THEN 1 ELSE 0 END AS ink FROM dl), {_near('er', 'k2', '1 - ink')} SELECT img, CAST(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM er GROUP BY img")
def tile_close(spark, d):
    return P.closed(_ink(spark, d), 1).groupBy("img").agg(F.sum("ink").alias("n"))


@query(f"WITH {TILES} SELECT img, y // 3 AS y, x // 3 AS x, round(avg(v), 6) AS v FROM px GROUP BY img, y // 3, x // 3")
def tile_area_mean(spark, d):
    return P.area_reduced(_tiles(spark, d), 3).select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"))


@query(f"WITH {TILES} SELECT img, y - 1 AS y, x - 1 AS x, v FROM px WHERE x >= 1 AND x < 7 AND y >= 1")
def tile_crop_shares(spark, d):
    return P.crop_shares(_tiles(spark, d), 0.1, 0.1).select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


def _skew_step(name: str, source: str, i: str, deg: str) -> str:
    """CTEs of the best angle per image among the numbered ones of a source with ink, the first of equals."""
    return f"""{name}_a AS (SELECT ink.img, y, x, {i} AS i, {deg} AS deg FROM {source} WHERE ink = 1),
{name}_m AS (SELECT img, i, deg, y + floor((x - 4.0) * tan(deg * 3.141592653589793 / 180) + 0.5) AS yy FROM {name}_a),
{name}_r AS (SELECT img, i, deg, yy, count(*) AS n FROM {name}_m WHERE yy >= 0 AND yy < 8 GROUP BY img, i, deg, yy),
{name}_s AS (SELECT img, i, deg, sum(n * n) - sum(n) * sum(n) / 8 AS score FROM {name}_r GROUP BY img, i, deg),
{name} AS (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY img ORDER BY round(score, 9) DESC, i) = 1)"""


@query(f"""{INK}, {_skew_step("co", "ink, range(0, 25) g(k)", "k", "(k - 12)::DOUBLE")},
{_skew_step("fi", "ink JOIN co ON co.img = ink.img, range(0, 17) g(k)", "k", "round(co.deg + k / 8 - 1, 9)")}
SELECT img, round(deg, 6) AS deg, round(score, 6) AS score FROM fi""")
def tile_skew(spark, d):
    """The skew of each tile by the coarse and the fine grid."""
    return P.estimated_skew(_ink(spark, d)).select("img", F.round("deg", 6).alias("deg"), F.round("score", 6).alias("score"))
