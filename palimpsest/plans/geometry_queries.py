"""Page geometry on embedding tiles: twenty of them side by side make a small photo, eight in steps a bent line."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import filters as N, geometry as G
from palimpsest.plans.sqltext import TILES, boxed
from palimpsest.plans.tile_queries import INK, _ink, _tiles, query
from palimpsest.tables import materialize

#: Tiles of a mosaic side by side and below each other; its size; tiles of a line in steps and its height.
ACROSS, DOWN = 4, 5
WIDE, HIGH = 8 * ACROSS, 8 * DOWN
STEPS = 8
STEP_HIGH = 8 + STEPS - 1


def mosaics(px, *values: str):
    """Each ACROSS x DOWN consecutive tiles as one image."""
    at = F.col("img") % (ACROSS * DOWN)
    y, x = (at - at % ACROSS) / ACROSS * 8 + F.col("y"), at % ACROSS * 8 + F.col("x")
    return px.select(((F.col("img") - at) / (ACROSS * DOWN)).cast("long").alias("img"), F.lit(WIDE).alias("w"), F.lit(HIGH).alias("h"), y.cast("int").alias("y"), x.cast("int").alias("x"), *values)


def stairs(ink):
    """Each STEPS consecutive tiles of ink as one line, every tile a pixel below the last, or above it in every second line."""
    at = F.col("img") % STEPS
    number = ((F.col("img") - at) / STEPS).cast("long")
    step = F.when(number % 2 == 0, at).otherwise(STEPS - 1 - at)
    return ink.select(number.alias("img"), F.lit(8 * STEPS).alias("w"), F.lit(STEP_HIGH).alias("h"), (F.col("y") + step).cast("int").alias("y"), (at * 8 + F.col("x")).cast("int").alias("x"), "ink")


def _rows(df, *values):
    return df.select("img", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *values)


@query(f"""WITH {TILES}, c AS (SELECT img, ty, tx, v * (least((ty + 1) * 8, (y + 1) * 3) - greatest(ty * 8, y * 3)) * (least((tx + 1) * 8, (x + 1) * 5) - greatest(tx * 8, x * 5)) AS s
  FROM px, range(0, 3) a(ty), range(0, 5) b(tx) WHERE (ty + 1) * 8 > y * 3 AND ty * 8 < (y + 1) * 3 AND (tx + 1) * 8 > x * 5 AND tx * 8 < (x + 1) * 5)
SELECT img, 5 AS w, 3 AS h, ty AS y, tx AS x, round(sum(s) / 64, 6) AS v FROM c GROUP BY img, ty, tx""")
def tile_area_resize(spark, d):
    """Means over areas that don't end between pixels: 8 x 8 to 5 x 3."""
    return _rows(G.area_resized(_tiles(spark, d), F.lit(5), F.lit(3)), F.round("v", 6).alias("v"))


@query(f"""WITH {TILES}, z AS (SELECT img // {ACROSS * DOWN} AS img, img % {ACROSS * DOWN} // {ACROSS} * 8 + y AS y, img % {ACROSS} * 8 + x AS x, v FROM px),
c AS (SELECT img, ty, tx, v * (least((ty + 1) * {HIGH}, (y + 1) * 25) - greatest(ty * {HIGH}, y * 25)) * (least((tx + 1) * {WIDE}, (x + 1) * 20) - greatest(tx * {WIDE}, x * 20)) AS s
  FROM z, range(0, 25) a(ty), range(0, 20) b(tx) WHERE (ty + 1) * {HIGH} > y * 25 AND ty * {HIGH} < (y + 1) * 25 AND (tx + 1) * {WIDE} > x * 20 AND tx * {WIDE} < (x + 1) * 20)
SELECT img, 20 AS w, 25 AS h, ty AS y, tx AS x, round(sum(s) / {WIDE * HIGH}, 6) AS v FROM c GROUP BY img, ty, tx""")
def photo_shrunk(spark, d):
    """Photos of at most 25 pixels a side."""
    return _rows(G.shrunk(mosaics(_tiles(spark, d), "v"), 25), F.round("v", 6).alias("v"))


@query(f"""{INK}, c AS (SELECT img, ty, tx, ink * (least((ty + 1) * 8, (y + 1) * 13) - greatest(ty * 8, y * 13)) * (least((tx + 1) * 8, (x + 1) * 17) - greatest(tx * 8, x * 17)) AS s
  FROM ink, range(0, 13) a(ty), range(0, 17) b(tx) WHERE (ty + 1) * 8 > y * 13 AND ty * 8 < (y + 1) * 13 AND (tx + 1) * 8 > x * 17 AND tx * 8 < (x + 1) * 17),
s AS (SELECT img, ty + 4 AS y, CASE WHEN sum(s) / 64 > 0.35 THEN 1 ELSE 0 END AS ink FROM c GROUP BY img, ty, tx)
SELECT i.img, 17 AS w, 21 AS h, r AS y, CAST(coalesce(sum(ink), 0) AS BIGINT) AS n FROM (SELECT DISTINCT img FROM px) i CROSS JOIN range(0, 21) t(r) LEFT JOIN s ON s.img = i.img AND s.y = r GROUP BY i.img, r""")
def tile_prepared_line(spark, d):
    """Tiles as lines at 13 pixels an em, stretched by 1.3: area means, ink from 0.35 on, room above and below."""
    made = G.prepared_lines(_ink(spark, d).select("img", "w", "h", "y", "x", "ink"), 13, 1.0, 1.3)
    return made.groupBy("img", "w", "h", "y").agg(F.sum("ink").alias("n")).select("img", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), F.col("y").cast("long").alias("y"), "n")


@query(f"""{INK} SELECT img, 56 AS w, ny AS y, CAST(sum(ink) AS BIGINT) AS n FROM ink, range(0, 48) a(ny), range(0, 48) b(nx)
WHERE y = least(7, floor((ny + 0.5) * 8 / 48)) AND x = least(7, floor((nx + 0.5) * 8 / 48)) GROUP BY img, ny""")
def tile_network_line(spark, d):
    """Tiles as lines at the height that a network takes."""
    made = G.network_lines(_ink(spark, d))
    return made.groupBy("img", "w", "y").agg(F.sum("ink").cast("long").alias("n")).select("img", F.col("w").cast("long").alias("w"), F.col("y").cast("long").alias("y"), "n")


# perspective

CORNER_SQL = f"""{INK}, k AS (SELECT img, x, y, y * 8 + x AS p FROM ink WHERE ink = 1),
q AS (SELECT img, {", ".join(f"CAST((list(p ORDER BY {r}, p))[1] % 8 AS DOUBLE) AS x{i}, CAST((list(p ORDER BY {r}, p))[1] // 8 AS DOUBLE) AS y{i}" for i, r in enumerate(("x + y", "y - x", "-(x + y)", "x - y")))} FROM k GROUP BY img)"""


def _corners(spark, d):
    got = N.ink_corners(_ink(spark, d))
    return got.select("img", *[F.col(f"{c}_{a}").cast("double").alias(f"{a}{i}") for i, c in enumerate(("tl", "tr", "br", "bl")) for a in "xy"])


def _warp_sql(quads: str, source: str) -> str:
    """CTEs wq: the quadrangles' own maps from the unit square; wp: the warped pixels (img, w, h, y, x, v)."""
    turn = lambda a, b, c: f"(x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b})"
    turns = [turn(i, (i + 1) % 4, (i + 2) % 4) for i in range(4)]
    side = lambda i, j: f"sqrt(pow(x{i} - x{j}, 2) + pow(y{i} - y{j}, 2))"
    size = lambda a, b: f"CAST(greatest(10, floor(round(greatest({a}, {b}), 9))) AS BIGINT)"
    far = lambda t: f"(-0.75 * pow({t}, 3) + 3.75 * pow({t}, 2) - 6.0 * {t} + 3.0)"
    near = lambda t: f"(1.25 * pow({t}, 3) - 2.25 * pow({t}, 2) + 1)"
    tap = lambda at, i: f"CASE {i} WHEN 0 THEN {far(f'({at} - floor({at}) + 1)')} WHEN 1 THEN {near(f'({at} - floor({at}))')} WHEN 2 THEN {near(f'(1 - ({at} - floor({at})))')} ELSE {far(f'(2 - ({at} - floor({at})))')} END"
    return f"""w0 AS (SELECT *, {size(side(0, 1), side(3, 2))} AS w, {size(side(0, 3), side(1, 2))} AS h, x0 - x1 + x2 - x3 AS ex, y0 - y1 + y2 - y3 AS ey, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS den
  FROM {quads} WHERE least({", ".join(turns)}) > 0 OR greatest({", ".join(turns)}) < 0),
w1 AS (SELECT *, (ex * (y3 - y2) - (x3 - x2) * ey) / den AS g, ((x1 - x2) * ey - ex * (y1 - y2)) / den AS hh FROM w0),
w2 AS (SELECT img, w, h, ty, tx, round(((x1 - x0 + g * x1) * u + (x3 - x0 + hh * x3) * v + x0) / (g * u + hh * v + 1), 9) AS sx, round(((y1 - y0 + g * y1) * u + (y3 - y0 + hh * y3) * v + y0) / (g * u + hh * v + 1), 9) AS sy
  FROM (SELECT w1.*, ty, tx, CAST(tx AS DOUBLE) / (w - 1) AS u, CAST(ty AS DOUBLE) / (h - 1) AS v FROM w1, LATERAL (SELECT unnest(range(0, w)) AS tx) a, LATERAL (SELECT unnest(range(0, h)) AS ty) b)),
w3 AS (SELECT img, w, h, ty, tx, floor(sy) + i - 1 AS y, floor(sx) + j - 1 AS x, {tap("sy", "i")} * {tap("sx", "j")} AS share FROM w2, range(0, 4) a(i), range(0, 4) b(j)),
wp AS (SELECT w3.img, w3.w, w3.h, ty AS y, tx AS x, CAST(greatest(0, least(255, floor(round(coalesce(sum(s.v * share), 0), 6) + 0.5))) AS BIGINT) AS v
  FROM w3 LEFT JOIN {source} s ON s.img = w3.img AND s.y = w3.y AND s.x = w3.x GROUP BY w3.img, w3.w, w3.h, ty, tx)"""


@query(f"{CORNER_SQL}, {_warp_sql('q', 'px')} SELECT * FROM wp")
def tile_warp(spark, d):
    """The quadrangle of each tile's ink pulled to a rectangle; tiles whose corners don't make one have no rows."""
    return _rows(G.warped(_tiles(spark, d), _corners(spark, d)), F.col("v").cast("long").alias("v"))


@query(f"""{CORNER_SQL}, t AS (SELECT a.*, {", ".join(f"b.{c}{i} AS {n}{i}" for i in range(4) for c, n in (("x", "u"), ("y", "v")))} FROM q a JOIN q b ON b.img = a.img + 1),
f AS (SELECT *, {" AND ".join("(least({0}) > 0 OR greatest({0}) < 0)".format(", ".join(f"({x}{(i + 1) % 4} - {x}{i}) * ({y}{(i + 2) % 4} - {y}{(i + 1) % 4}) - ({y}{(i + 1) % 4} - {y}{i}) * ({x}{(i + 2) % 4} - {x}{(i + 1) % 4})" for i in range(4))) for x, y in ("xy", "uv"))} AS ok FROM t),
s AS (SELECT img, ok, ((v1 - v0) * (u1 - u3) - (u1 - u0) * (v1 - v3)) / ((v2 - v0) * (u1 - u3) - (u2 - u0) * (v1 - v3)) AS s, u0, u2, v0, v2 FROM f WHERE ok)
SELECT img, round(u0 + s * (u2 - u0) + 1e-9, 5) AS x, round(v0 + s * (v2 - v0) + 1e-9, 5) AS y FROM s""")
def quad_perspective(spark, d):
    """The map from a tile's corners to the next tile's takes the point where the diagonals cross to where the other ones cross."""
    corners = _corners(spark, d)
    after = corners.select((F.col("img") - 1).alias("img"), *[F.col(f"{c}{i}").alias(f"{n}{i}") for i in range(4) for c, n in (("x", "u"), ("y", "v"))])
    maps = G.perspective(corners.join(after, "img")).where("m_a is not null")
    along = F.expr("((y1 - y0) * (x1 - x3) - (x1 - x0) * (y1 - y3)) / ((y2 - y0) * (x1 - x3) - (x2 - x0) * (y1 - y3))")
    at = maps.withColumn("s", along).withColumn("px", F.expr("x0 + s * (x2 - x0)")).withColumn("py", F.expr("y0 + s * (y2 - y0)"))
    under = F.expr("m_g * px + m_h * py + m_i")
    return at.select("img", F.round(F.expr("m_a * px + m_b * py + m_c") / under + 1e-9, 5).alias("x"), F.round(F.expr("m_d * px + m_e * py + m_f") / under + 1e-9, 5).alias("y"))


# the page in a photo

_WEIGHTS = ", ".join(f"({i - 3}, {w!r}::DOUBLE)" for i, w in enumerate(N.gaussian_weights(7)))
_AROUND = ", ".join(f"({i}, {dy}, {dx})" for i, (dy, dx) in enumerate(G.AROUND))
MASK_SQL = f"""{TILES}, mz AS (SELECT img // {ACROSS * DOWN} AS img, img % {ACROSS * DOWN} // {ACROSS} * 8 + y AS y, img % {ACROSS} * 8 + x AS x, v FROM px), gw AS (SELECT * FROM (VALUES {_WEIGHTS}) t(d, wt)),
b0 AS (SELECT img, y, x, wt, CASE WHEN abs(x + d) > {WIDE - 1} THEN {2 * WIDE - 2} - abs(x + d) ELSE abs(x + d) END AS sx FROM mz, gw),
b1 AS (SELECT b0.img, b0.y, b0.x, sum(wt * v) AS b FROM b0 JOIN mz q ON q.img = b0.img AND q.y = b0.y AND q.x = b0.sx GROUP BY b0.img, b0.y, b0.x),
b2 AS (SELECT img, y, x, wt, CASE WHEN abs(y + d) > {HIGH - 1} THEN {2 * HIGH - 2} - abs(y + d) ELSE abs(y + d) END AS sy FROM mz, gw),
sf AS (SELECT b2.img, b2.y, b2.x, CAST(floor(round(sum(wt * b), 9) + 0.5) AS INT) AS v FROM b2 JOIN b1 q ON q.img = b2.img AND q.y = b2.sy AND q.x = b2.x GROUP BY b2.img, b2.y, b2.x),
hs AS (SELECT img, v, count(*) AS n FROM sf GROUP BY img, v),
hc AS (SELECT img, v, sum(n) OVER u AS n0, sum(n * v) OVER u AS s0, sum(n) OVER (PARTITION BY img) AS n, sum(n * v) OVER (PARTITION BY img) AS s FROM hs WINDOW u AS (PARTITION BY img ORDER BY v)),
ho AS (SELECT img, v, n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) AS score FROM hc WHERE n > n0),
th AS (SELECT img, v AS t FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(score, 6) DESC, v) AS k FROM ho) WHERE k = 1),
m0 AS (SELECT sf.img, y, x, CASE WHEN v > t THEN 1 ELSE 0 END AS ink FROM sf LEFT JOIN th ON th.img = sf.img),
{boxed("m0", "m1", 1, "ink")}, m2 AS (SELECT img, y, x, CASE WHEN b > 0 THEN 1 ELSE 0 END AS ink FROM m1),
{boxed("m2", "m3", 1, "1 - ink")}, m4 AS (SELECT img, y, x, CASE WHEN b = 0 THEN 1 ELSE 0 END AS ink FROM m3),
{boxed("m4", "m5", 1, "1 - ink")}, m6 AS (SELECT img, y, x, CASE WHEN b = 0 THEN 1 ELSE 0 END AS ink FROM m5),
{boxed("m6", "m7", 1, "ink")}, mk AS (SELECT img, y, x, CASE WHEN b > 0 THEN 1 ELSE 0 END AS ink FROM m7)"""
OUTLINE_SQL = f"""{MASK_SQL},
rn AS (SELECT img, y, min(x) AS a, max(x) AS e, y * {WIDE} + min(x) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS g FROM mk WHERE ink = 1) GROUP BY img, y, g),
rr AS (SELECT img, id, id AS r FROM rn UNION SELECT rr.img, rr.id, n.id FROM rr JOIN rn o ON o.img = rr.img AND o.id = rr.r JOIN rn n ON n.img = rr.img AND abs(n.y - o.y) = 1 AND n.a <= o.e + 1 AND n.e >= o.a - 1),
rl AS (SELECT img, id, min(r) AS label FROM rr GROUP BY img, id),
cp AS (SELECT rn.img, label, rn.y, unnest(range(a, e + 1)) AS x FROM rn JOIN rl ON rl.img = rn.img AND rl.id = rn.id),
ar AS (SELECT * FROM (VALUES {_AROUND}) t(i, dy, dx)),
sc AS (SELECT c.img, c.label, c.y, c.x, d, arg_min(a.i, k) AS nd FROM cp c, range(0, 8) r(d), range(1, 9) s(k), ar a, cp n WHERE a.i = (d + k) % 8 AND n.img = c.img AND n.label = c.label AND n.y = c.y + a.dy AND n.x = c.x + a.dx GROUP BY c.img, c.label, c.y, c.x, d),
wk AS (SELECT img, label, 0 AS i, y, x, nd, y AS y_, x AS x_, nd AS nd_ FROM sc WHERE d = 4 AND y * {WIDE} + x = label
  UNION ALL SELECT w.img, w.label, w.i + 1, s.y, s.x, s.nd, y_, x_, nd_ FROM wk w JOIN ar a ON a.i = w.nd JOIN sc s ON s.img = w.img AND s.label = w.label AND s.y = w.y + a.dy AND s.x = w.x + a.dx AND s.d = (w.nd + 6 - w.nd % 2) % 8
  WHERE NOT (s.y = y_ AND s.x = x_ AND s.nd = nd_)),
ln AS (SELECT *, count(*) OVER (PARTITION BY img, label) AS n, coalesce(lead(y) OVER o, y_) AS yn, coalesce(lead(x) OVER o, x_) AS xn FROM wk WINDOW o AS (PARTITION BY img, label ORDER BY i)),
os AS (SELECT img, label, abs(sum(y * xn - yn * x)) / 2.0 AS area, sum(sqrt(pow(yn - y, 2) + pow(xn - x, 2))) AS perimeter FROM ln GROUP BY img, label),
bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(area, 6) DESC, label) AS k FROM os) WHERE k = 1 AND area >= 0.15 * {WIDE * HIGH}),
ol AS (SELECT ln.img, i, n, y, x, area, perimeter FROM ln JOIN bo ON bo.img = ln.img AND bo.label = ln.label)"""
QUAD_SQL = f"""{OUTLINE_SQL},
o1 AS (SELECT b.img, arg_max(b.i, (pow(b.y - a.y, 2) + pow(b.x - a.x, 2)) * 100000 - b.i) AS one FROM ol a JOIN ol b ON b.img = a.img WHERE a.i = 0 GROUP BY b.img),
o2 AS (SELECT b.img, any_value(one) AS one, arg_max(b.i, (pow(b.y - a.y, 2) + pow(b.x - a.x, 2)) * 100000 - b.i) AS two FROM o1 JOIN ol a ON a.img = o1.img AND a.i = one JOIN ol b ON b.img = a.img GROUP BY b.img),
od AS (SELECT img, i + o * n AS i, n, y, x, perimeter FROM ol, range(0, 2) t(o)),
sp AS (
  SELECT img, least(one, two) AS i, greatest(one, two) AS j FROM o2
  UNION ALL SELECT o2.img, greatest(one, two), least(one, two) + n FROM o2 JOIN ol ON ol.img = o2.img AND ol.i = 0
  UNION ALL SELECT img, unnest([i, k]), unnest([k, j]) FROM (
    SELECT s.img, s.i, s.j, arg_max(p.i, round(abs((p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x)) / greatest(sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2)), 1e-12), 9) * 1000000 - p.i) AS k,
      max(abs((p.x - a.x) * (b.y - a.y) - (p.y - a.y) * (b.x - a.x)) / greatest(sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2)), 1e-12)) AS far, any_value(p.perimeter) AS perimeter
    FROM sp s JOIN od a ON a.img = s.img AND a.i = s.i JOIN od b ON b.img = s.img AND b.i = s.j JOIN od p ON p.img = s.img AND p.i > s.i AND p.i < s.j GROUP BY s.img, s.i, s.j) WHERE far > 0.02 * perimeter + 1e-9),
pg AS (SELECT DISTINCT od.img, od.i % od.n AS i, od.y, od.x FROM (SELECT img, i FROM sp UNION SELECT img, j FROM sp) s JOIN od ON od.img = s.img AND od.i = s.i),
pn AS (SELECT img, count(*) AS n FROM pg GROUP BY img),
ex AS (SELECT DISTINCT img, y, unnest([min(x) , max(x)]) AS x FROM ol GROUP BY img, y),
he AS (SELECT a.img, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM ex a JOIN ex b ON b.img = a.img AND (a.x, a.y) <> (b.x, b.y) JOIN ex p ON p.img = a.img GROUP BY a.img, a.x, a.y, b.x, b.y
  HAVING bool_and((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0 OR ((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) <= 0))),
hd AS (SELECT img, CASE WHEN (bx - ax) * (byy - ay) >= 0 AND bx <> ax THEN abs(bx - ax) ELSE abs(byy - ay) END / sqrt(pow(bx - ax, 2) + pow(byy - ay, 2)) AS c, CASE WHEN (bx - ax) * (byy - ay) >= 0 AND bx <> ax THEN abs(byy - ay) ELSE abs(bx - ax) END / sqrt(pow(bx - ax, 2) + pow(byy - ay, 2)) AS s FROM he),
hb AS (SELECT hd.img, c, s, min(x * c + y * s) AS l, max(x * c + y * s) AS r, min(y * c - x * s) AS t, max(y * c - x * s) AS b FROM hd JOIN ex ON ex.img = hd.img GROUP BY hd.img, c, s),
bx AS (SELECT * FROM (SELECT *, round((r - l) * (b - t), 6) AS box_area, row_number() OVER (PARTITION BY img ORDER BY round((r - l) * (b - t), 6), round(degrees(atan2(s, c)), 9)) AS k FROM hb) WHERE k = 1),
pt AS (SELECT pg.img, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pg JOIN pn ON pn.img = pg.img WHERE pn.n = 4
  UNION ALL SELECT bx.img, u * c - v * s, u * s + v * c FROM bx JOIN pn ON pn.img = bx.img, LATERAL (SELECT unnest([l, r, r, l]) AS u, unnest([t, t, b, b]) AS v) z WHERE pn.n <> 4),
qd AS (SELECT pt.img, {", ".join(f"(list(x ORDER BY round({r}, 6), x, y))[1] AS x{i}, (list(y ORDER BY round({r}, 6), x, y))[1] AS y{i}" for i, r in enumerate(("x + y", "y - x", "-x - y", "x - y")))} FROM pt GROUP BY pt.img)"""


def _photos(spark, d):
    return mosaics(_tiles(spark, d), "v")


def _quads(spark, d):
    return G.page_quads(G.page_mask(_photos(spark, d), 7, 1, 1))


@query(f"""WITH RECURSIVE {QUAD_SQL} SELECT i.img, CASE WHEN pn.n IS NULL THEN 'none' WHEN pn.n = 4 THEN 'polygon' ELSE 'rectangle' END AS way, round(bo.area, 3) AS area, coalesce(he.n, 0) AS hull_corners, round(bx.box_area, 4) AS box_area,
{", ".join(f"round({c}, 4) AS {c}" for c in G.CORNERS)} FROM (SELECT DISTINCT img FROM mz) i LEFT JOIN pn ON pn.img = i.img LEFT JOIN bo ON bo.img = i.img LEFT JOIN bx ON bx.img = i.img LEFT JOIN qd ON qd.img = i.img LEFT JOIN (SELECT img, count(*) AS n FROM he GROUP BY img) he ON he.img = i.img""")
def photo_quads(spark, d):
    """The corners of the light page in each photo; null where there is none."""
    got = _quads(spark, d)
    return got.select("img", "way", F.round("area", 3).alias("area"), F.coalesce(F.col("hull_corners").cast("long"), F.lit(0)).alias("hull_corners"), F.round("box_area", 4).alias("box_area"), *[F.round(c, 4).alias(c) for c in G.CORNERS])


@query(f"""WITH RECURSIVE {OUTLINE_SQL}, sz AS (SELECT img, label, count(*) AS n FROM cp GROUP BY img, label)
SELECT sz.img, CAST(sz.label AS BIGINT) AS label, sz.n AS pixels, round(coalesce(os.area, 0), 3) AS area, round(coalesce(os.perimeter, 0), 6) AS perimeter FROM sz LEFT JOIN os ON os.img = sz.img AND os.label = sz.label""")
def photo_outlines(spark, d):
    """Area and length of the outline of every light part of a photo."""
    mask = materialize(G.page_mask(_photos(spark, d), 7, 1, 1), "mask")
    size = N.components(mask).groupBy("img", "label").agg(F.count("*").alias("pixels"))
    return G.outlines(mask).join(size, ["img", "label"]).select("img", F.col("label").cast("long").alias("label"), "pixels", F.round("area", 3).alias("area"), F.round("perimeter", 6).alias("perimeter"))


@query(f"""WITH RECURSIVE {QUAD_SQL}, {_warp_sql('qd', 'mz')}, al AS (SELECT img, w, h, v FROM wp UNION ALL SELECT img, {WIDE}, {HIGH}, v FROM mz WHERE img NOT IN (SELECT img FROM qd))
SELECT img, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(sum(v) AS BIGINT) AS total FROM al GROUP BY img, w, h""")
def photo_rectified(spark, d):
    """The page of each photo pulled to a rectangle; photos without one as they are."""
    made = G.rectified(_photos(spark, d), 900, 7, 1, 1)
    return made.groupBy("img", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h")).agg(F.sum("v").cast("long").alias("total"))


# turned pages and bent lines

MOSAIC_INK = f"{INK}, mz AS (SELECT img // {ACROSS * DOWN} AS img, img % {ACROSS * DOWN} // {ACROSS} * 8 + y AS y, img % {ACROSS} * 8 + x AS x, ink FROM ink)"


def _turn_sql(name: str, angles: str) -> str:
    """CTE of the best angle per image, of angles (img, i, deg)."""
    return f"""{name}0 AS (SELECT z.img, i, deg, round(-(x - {WIDE} / 2) * sin(radians(deg)) + (y - {HIGH} / 2) * cos(radians(deg)) + {HIGH} / 2, 9) AS r FROM mz z JOIN {angles} a ON a.img = z.img WHERE ink = 1),
{name}1 AS (SELECT img, i, deg, floor(r) AS y, 1 - (r - floor(r)) AS n FROM {name}0 UNION ALL SELECT img, i, deg, floor(r) + 1, r - floor(r) FROM {name}0),
{name}2 AS (SELECT img, i, deg, y, sum(n) AS n FROM {name}1 WHERE y >= 0 AND y < {HIGH} GROUP BY img, i, deg, y), {name}3 AS (SELECT img, i, deg, sum(n * n) AS score FROM {name}2 GROUP BY img, i, deg),
{name} AS (SELECT img, deg, score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(score, 9) DESC, i) AS k FROM {name}3) WHERE k = 1)"""


TURN_SQL = f"""{MOSAIC_INK}, ca AS (SELECT img, i, -5.0::DOUBLE + 0.5 * i AS deg FROM (SELECT DISTINCT img FROM mz), range(0, 21) t(i)), {_turn_sql("cb", "ca")},
fa AS (SELECT img, i, round(deg + (i - 10) * 0.05::DOUBLE, 6) AS deg FROM cb, range(0, 21) t(i)), {_turn_sql("fb", "fa")}"""


@query(f"""{TURN_SQL}, tn AS (SELECT img, CASE WHEN abs(deg) >= 0.05 THEN radians(deg) ELSE 0 END AS t FROM fb),
s AS (SELECT mz.img, floor(round((x - {WIDE // 2}) * cos(t) - (y - {HIGH // 2}) * sin(t) + {WIDE // 2}, 9) + 0.5) AS sx, floor(round((x - {WIDE // 2}) * sin(t) + (y - {HIGH // 2}) * cos(t) + {HIGH // 2}, 9) + 0.5) AS sy FROM mz JOIN tn ON tn.img = mz.img),
u AS (SELECT s.img, sum(q.ink) AS n FROM s LEFT JOIN mz q ON q.img = s.img AND q.x = s.sx AND q.y = s.sy GROUP BY s.img)
SELECT fb.img, CAST(deg AS DOUBLE) AS deg, round(score, 5) AS score, CAST(coalesce(n, 0) AS BIGINT) AS ink FROM fb JOIN u ON u.img = fb.img""")
def photo_turns(spark, d):
    """The angle that brings a photo's lines level, and its ink after the turn."""
    ink = materialize(mosaics(_ink(spark, d), "ink"), "mosaic-ink")
    turns = materialize(G.page_turn(ink), "turns")
    level = G.turned(ink, turns).groupBy("img").agg(F.sum("ink").cast("long").alias("ink"))
    return turns.join(level, "img").select("img", "deg", F.round("score", 5).alias("score"), "ink")


STAIRS = f"{INK}, st AS (SELECT img // {STEPS} AS img, y + CASE WHEN img // {STEPS} % 2 = 0 THEN img % {STEPS} ELSE {STEPS - 1} - img % {STEPS} END AS y, img % {STEPS} * 8 + x AS x FROM ink WHERE ink = 1)"
BEND_SQL = f"""{STAIRS}, cl AS (SELECT img, x, count(*) AS n, avg(y) AS c FROM st GROUP BY img, x), us AS (SELECT img, median(n) AS u FROM cl GROUP BY img),
so AS (SELECT cl.img, x - {(8 * STEPS - 1) / 2}::DOUBLE AS x, c, CAST(n * n AS DOUBLE) AS w FROM cl JOIN us ON us.img = cl.img WHERE n > 0.2 * u),
mo AS (SELECT img, count(*) AS columns, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * pow(x, 3)) AS s3, sum(w * pow(x, 4)) AS s4, sum(w * c) AS t0, sum(w * c * x) AS t1, sum(w * c * x * x) AS t2 FROM so GROUP BY img),
e1 AS (SELECT *, s2 - s1 * s1 / s0 AS p, s3 - s1 * s2 / s0 AS q, s4 - s2 * s2 / s0 AS r, t1 - s1 * t0 / s0 AS u, t2 - s2 * t0 / s0 AS v FROM mo WHERE columns >= 16),
e2 AS (SELECT *, (v - q * u / p) / (r - q * q / p) AS a FROM e1), e3 AS (SELECT *, (u - q * a) / p AS b FROM e2), be AS (SELECT img, columns, a, b, (t0 - s2 * a - s1 * b) / s0 AS c FROM e3)"""


@query(f"{BEND_SQL} SELECT mo.img, round(a, 8) AS a, round(b, 6) AS b, round(c, 6) AS c, mo.columns FROM mo LEFT JOIN be ON be.img = mo.img")
def line_bends(spark, d):
    """The parabola through each line of tiles in steps."""
    return G.bends(stairs(_ink(spark, d))).select("img", F.round("a", 8).alias("a"), F.round("b", 6).alias("b"), F.round("c", 6).alias("c"), "columns")


@query(f"""{BEND_SQL}, cu AS (SELECT img, xi, a * pow(xi - {(8 * STEPS - 1) / 2}::DOUBLE, 2) + b * (xi - {(8 * STEPS - 1) / 2}::DOUBLE) + c AS v FROM be, range(0, {8 * STEPS}) t(xi)),
sh AS (SELECT img, xi, CAST(round_even(round(v - avg(v) OVER (PARTITION BY img), 9), 0) AS INT) AS s FROM cu), mv AS (SELECT img FROM sh GROUP BY img HAVING max(abs(s)) >= 2),
pt AS (SELECT st.img, st.x, y - CASE WHEN mv.img IS NULL THEN 0 ELSE s END AS y, mv.img IS NOT NULL AS moved FROM st LEFT JOIN sh ON sh.img = st.img AND sh.xi = st.x LEFT JOIN mv ON mv.img = st.img),
bd AS (SELECT img, min(y) AS top, max(y) AS bottom FROM pt GROUP BY img)
SELECT pt.img, CAST(CASE WHEN moved THEN bottom - top + 1 ELSE {STEP_HIGH} END AS BIGINT) AS h, CAST(CASE WHEN moved THEN y - top ELSE y END AS BIGINT) AS y, count(*) AS n, CAST(sum(x) AS BIGINT) AS xs FROM pt JOIN bd ON bd.img = pt.img GROUP BY ALL""")
def line_straightened(spark, d):
    """Lines of tiles in steps, straightened: ink per row."""
    made = G.straightened(stairs(_ink(spark, d)))
    return made.groupBy("img", F.col("h").cast("long").alias("h"), F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("xs"))

