"""Images for looking at, glyphs read alone, likeness by lines, assembled answers and chosen parts of photos, on what the driver tables hold."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palimpsest.functions import requests as Q, text as T
from palimpsest.operators import evaluate as V, geometry as G, glyphs as Y, pixels as P, sheets as S
from palimpsest.plans.geometry_queries import ACROSS, DOWN, HIGH, WIDE, mosaics
from palimpsest.plans.sqltext import TILES, fold, translit
from palimpsest.plans.tile_queries import INK, _ink, _tiles, query
from palimpsest.tables import table

PACKED = "CAST(w AS INT) AS w, CAST(h AS INT) AS h, md5(string_agg(printf('%02X', CAST(v AS INT)), '' ORDER BY y, x)) AS bytes"
#: Cells of a contact sheet: images of one sheet, cells side by side, a cell's side, room around its image, inset of its frame.
CELLS, COLUMNS, CELL, ROOM, INSET = 35, 5, 12, 3, 1
MOSAIC = f"img // {ACROSS * DOWN} AS img, img % {ACROSS * DOWN} // {ACROSS} * 8 + y AS y, img % {ACROSS} * 8 + x AS x"


def _packed(px):
    return S.packed(px).select("img", "w", "h", F.md5(F.hex("gray").cast("binary")).alias("bytes"))


def _places(px, many: int):
    """Each `many` consecutive tiles as one sheet."""
    return S.image_sizes(px).select("img", F.expr(f"img div {many}").alias("sheet"), (F.col("img") % many).alias("no"))


@query(f"""WITH {TILES}, c AS (SELECT img, ty, tx, v * (least((ty + 1) * 8, (y + 1) * 6) - greatest(ty * 8, y * 6)) * (least((tx + 1) * 8, (x + 1) * 6) - greatest(tx * 8, x * 6)) AS s
  FROM px, range(0, 6) a(ty), range(0, 6) b(tx) WHERE (ty + 1) * 8 > y * 6 AND ty * 8 < (y + 1) * 6 AND (tx + 1) * 8 > x * 6 AND tx * 8 < (x + 1) * 6),
im AS (SELECT DISTINCT img, img // {CELLS} AS sheet, img % {CELLS} // {COLUMNS} * {CELL} AS oy, img % {CELLS} % {COLUMNS} * {CELL} AS ox FROM px),
dr AS (SELECT sheet, oy + {ROOM} + ty AS y, ox + {ROOM} + tx AS x, floor(sum(s) / 64.0::DOUBLE + 0.5) AS v FROM c JOIN im USING (img) GROUP BY sheet, oy, ox, ty, tx),
fr AS (SELECT sheet, oy + a AS y, ox + b AS x FROM im, range({INSET}, {CELL - INSET}) t(a), range({INSET}, {CELL - INSET}) u(b) WHERE a IN ({INSET}, {CELL - INSET - 1}) OR b IN ({INSET}, {CELL - INSET - 1})),
sh AS (SELECT sheet, {COLUMNS * CELL} AS w, max(oy) + {CELL} AS h FROM im GROUP BY sheet),
cv AS (SELECT sheet, w, h, y, x FROM sh, range(0, {COLUMNS * CELL}) t(x), range(0, {CELLS // COLUMNS * CELL}) u(y) WHERE y < h),
al AS (SELECT cv.sheet AS img, w, h, cv.y, cv.x, coalesce(dr.v, CASE WHEN fr.y IS NOT NULL THEN 180 ELSE 255 END) AS v FROM cv LEFT JOIN dr ON dr.sheet = cv.sheet AND dr.y = cv.y AND dr.x = cv.x LEFT JOIN fr ON fr.sheet = cv.sheet AND fr.y = cv.y AND fr.x = cv.x)
SELECT img, {PACKED} FROM al GROUP BY img, w, h""")
def glyph_sheets(spark, d):
    """Contact sheets of tiles in framed cells, reduced to fit."""
    px = _tiles(spark, d)
    return _packed(S.contact_sheets(px, _places(px, CELLS).withColumnRenamed("no", "place"), CELL, COLUMNS, ROOM, INSET))


@query(f"""{INK}, b AS (SELECT img, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM ink WHERE ink = 1 GROUP BY img),
im AS (SELECT *, img // 20 AS sheet, 6 + coalesce(sum(y1 - y0 + 6) OVER (PARTITION BY img // 20 ORDER BY img ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM b),
dr AS (SELECT sheet, top + y - y0 AS y, x - x0 AS x, CASE WHEN ink = 1 THEN 0 ELSE 255 END AS v FROM ink JOIN im USING (img) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
sh AS (SELECT sheet, max(x1 - x0) AS w, sum(y1 - y0 + 6) + 6 AS h FROM im GROUP BY sheet),
cv AS (SELECT sheet, w, h, y, x FROM sh, range(0, 8) t(x), range(0, 300) u(y) WHERE x < w AND y < h),
al AS (SELECT cv.sheet AS img, w, h, cv.y, cv.x, coalesce(dr.v, 205) AS v FROM cv LEFT JOIN dr ON dr.sheet = cv.sheet AND dr.y = cv.y AND dr.x = cv.x)
SELECT img, {PACKED} FROM al GROUP BY img, w, h""")
def line_montages(spark, d):
    """The ink of twenty tiles each, cut to its bounds, one below the other."""
    ink = _ink(spark, d)
    cut = S.cropped(S.gray_ink(ink), P.ink_bounds(ink))
    return _packed(S.stacked(cut, _places(cut, 20)))


@query(f"""{INK}, z AS (SELECT {MOSAIC}, ink FROM ink),
b AS (SELECT img, y // 8 AS r, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z WHERE ink = 1 GROUP BY img, y // 8),
al AS (SELECT z.img, {WIDE} AS w, {HIGH} AS h, z.y, z.x, CASE WHEN y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 AND (y IN (y0, y1) OR x IN (x0, x1)) THEN 128 WHEN ink = 1 THEN 0 ELSE 255 END AS v FROM z LEFT JOIN b ON b.img = z.img AND b.r = z.y // 8)
SELECT img, {PACKED} FROM al GROUP BY img, w, h""")
def line_overlays(spark, d):
    """Photos of tiles with a box around the ink of each row of tiles."""
    ink = mosaics(_ink(spark, d), "ink")
    inked = ink.where("ink = 1").groupBy("img", F.expr("y div 8").alias("line"))
    boxes = inked.agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return _packed(S.overlaid(ink, boxes, thick=1))


@query(f"""{INK}, c AS (SELECT img, ty, tx, ink * (least((ty + 1) * 8, (y + 1) * 13) - greatest(ty * 8, y * 13)) * (least((tx + 1) * 8, (x + 1) * 17) - greatest(tx * 8, x * 17)) AS s
  FROM ink, range(0, 13) a(ty), range(0, 17) b(tx) WHERE (ty + 1) * 8 > y * 13 AND ty * 8 < (y + 1) * 13 AND (tx + 1) * 8 > x * 17 AND tx * 8 < (x + 1) * 17),
s AS (SELECT img, ty + 4 AS y, tx AS x, CASE WHEN sum(s) / 64 > 0.35 THEN 255 ELSE 0 END AS v FROM c GROUP BY img, ty, tx),
st AS (SELECT i.img, a AS y, b AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT img FROM px) i CROSS JOIN range(0, 21) t(a) CROSS JOIN range(0, 12) u(b) LEFT JOIN s ON s.img = i.img AND s.y = a AND s.x = b),
sh AS (SELECT img // 2 AS img, CASE WHEN count(*) = 1 THEN 21 ELSE 58 END AS h FROM (SELECT DISTINCT img FROM px) GROUP BY img // 2),
cv AS (SELECT img, h, y, x FROM sh, range(0, 58) t(y), range(0, 12) u(x) WHERE y < h),
al AS (SELECT cv.img, 24 AS w, 2 * cv.h AS h, 2 * cv.y + a AS y, 2 * cv.x + b AS x, coalesce(st.v, 255) AS v FROM cv LEFT JOIN st ON st.img // 2 = cv.img AND st.img % 2 * 37 + st.y = cv.y AND st.x = cv.x, range(0, 2) t(a), range(0, 2) u(b))
SELECT img, {PACKED} FROM al GROUP BY img, w, h""")
def strip_comparisons(spark, d):
    """Two neighbouring tiles each, prepared as lines, below each other, their first twelve columns enlarged."""
    strips = S.gray_ink(G.prepared_lines(_ink(spark, d), 13, 1.0, 1.3), dark=255, light=0)
    return _packed(S.compared(strips, _places(strips, 2), part=12))


@query(f"""WITH {TILES}, z AS (SELECT {MOSAIC}, v FROM px), b AS (SELECT img, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM z WHERE v < 48 GROUP BY img),
f AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, least(1.0::DOUBLE, 16 / greatest(x1 - x0, y1 - y0)::DOUBLE) AS k FROM b),
g AS (SELECT *, CAST(greatest(1, floor(w * k + 0.5)) AS INT) AS dw, CAST(greatest(1, floor(h * k + 0.5)) AS INT) AS dh FROM f),
c AS (SELECT z.img, w, h, dw, dh, y - y0 AS y, x - x0 AS x, v FROM z JOIN g USING (img) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
s AS (SELECT img, dw, dh, w, h, ty, tx, sum(v * (least((ty + 1) * h, (y + 1) * dh) - greatest(ty * h, y * dh)) * (least((tx + 1) * w, (x + 1) * dw) - greatest(tx * w, x * dw))) AS s
  FROM c, range(0, 16) a(ty), range(0, 16) b(tx) WHERE ty < dh AND tx < dw AND (ty + 1) * h > y * dh AND ty * h < (y + 1) * dh AND (tx + 1) * w > x * dw AND tx * w < (x + 1) * dw GROUP BY img, dw, dh, w, h, ty, tx),
al AS (SELECT img, dw AS w, dh AS h, ty AS y, tx AS x, floor(s / (w * h)::DOUBLE + 0.5) AS v FROM s)
SELECT img, {PACKED} FROM al GROUP BY img, w, h""")
def photo_parts(spark, d):
    """The part of each photo around its darkest places, chosen on a view of half its size, at most 16 pixels a side."""
    px = mosaics(_tiles(spark, d), "v")
    dark = px.where("v < 48").groupBy("img").agg(F.min("x").alias("l"), (F.max("x") + 1).alias("r"), F.min("y").alias("t"), (F.max("y") + 1).alias("b"))
    half = lambda c: F.col(c) / 2
    part = Q.chosen_part(half("l"), half("t"), half("r") - half("l"), half("b") - half("t"), F.lit(2), F.lit(HIGH), F.lit(16))
    boxes = dark.select("img", *[part[c].cast("int").alias(c) for c in ("x0", "x1", "y0", "y1")])
    small = G.area_resized(S.cropped(px, boxes), *Q.fitted(F.col("w"), F.col("h"), F.lit(16)))
    return _packed(small.withColumn("v", P.half_up(F.col("v"))))


@query(f"""{INK}, tp AS (SELECT label, y, x, sum(255 - v) AS dark, count(*) AS n FROM px GROUP BY label, y, x),
s AS (SELECT img, tp.label, sum(ink * dark) AS c, sum(dark) AS mass, sum(ink * n * 255) AS marks FROM ink JOIN tp ON tp.y = ink.y AND tp.x = ink.x GROUP BY img, tp.label),
r AS (SELECT img, label, CASE WHEN marks = 0 THEN 0.0::DOUBLE ELSE (2 * c)::DOUBLE / (mass + marks)::DOUBLE END AS dice FROM s),
w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY img ORDER BY dice DESC, label) = 1),
g AS (SELECT 'font ' || img % 4 AS font, chr(65 + t.label) AS want, CASE WHEN dice = 0 THEN '' ELSE chr(65 + w.label) END AS got FROM w JOIN (SELECT DISTINCT img, label FROM px) t USING (img)),
k AS (SELECT font, want, got, count(*) AS k, want = got OR (font = 'font 0' AND want IN ('A', 'B') AND got IN ('A', 'B')) AS ok FROM g GROUP BY font, want, got)
SELECT font, CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (WHERE ok), 0) AS BIGINT) AS right, coalesce(string_agg(want || '>' || CASE WHEN got = '' THEN '{V.NOTHING}' ELSE got END || ' x' || k, ', ' ORDER BY want || '>' || CASE WHEN got = '' THEN '{V.NOTHING}' ELSE got END || ' x' || k) FILTER (WHERE NOT ok), '') AS failures
FROM k GROUP BY font""")
def isolated_glyphs(spark, d):
    """Tiles read alone by the best of all labels' templates: right ones and failures of four fonts; two letters of one font look the same."""
    letter = F.char(65 + F.col("label"))
    px = _tiles(spark, d)
    read = Y.read_alone(_ink(spark, d), Y.shape_sums(px.withColumn("letter", letter)))
    truth = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), letter.alias("want"))
    readings = read.join(truth, "img").select(F.concat(F.lit("font "), (F.col("img") % 4).cast("string")).alias("font"), "want", "got")
    twins = spark.createDataFrame([("font 0", c, "AB") for c in "AB"], "font string, ch string, grp string")
    return V.isolated_accuracy(readings, twins)


_LINES = "list_transform(string_split(coalesce(%s, ''), chr(10)), lambda s: trim(regexp_replace(" + fold("s") + ", '[^A-Z ]+', '', 'g')))"


@query(f"""WITH tu AS (SELECT a.conv_id, a.turn, {_LINES % "a.text"} AS want, {_LINES % "b.text"} AS got FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
l AS (SELECT conv_id, turn, want, unnest(got) AS g, generate_subscripts(got, 1) AS i FROM tu), e AS (SELECT conv_id, turn, g, coalesce(want[i], '') AS w FROM l),
s AS (SELECT conv_id, turn, g, CASE WHEN g <> '' THEN 1 - levenshtein(w, g)::DOUBLE / greatest(length(w), length(g)) END AS s FROM e)
SELECT conv_id, turn, count(s) AS lines, round(coalesce(avg(s), 0), 6) AS similarity FROM s GROUP BY conv_id, turn""")
def turn_line_similarity(spark, d):
    """Each turn read as the next one, compared line by line."""
    letters = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.translit_kept), "\n")
    c = table(spark, d, "conversations").select("conv_id", "turn", letters.alias("want_text"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("want_text").alias("got_text")), ["conv_id", "turn"])
    told = V.line_similarity(pairs.select(F.struct("conv_id", "turn").alias("key"), "want_text", "got_text"))
    return told.select("key.conv_id", "key.turn", "lines", F.round("similarity", 6).alias("similarity"))


_CELLS = "list_transform(list_filter(string_split(letters, ''), lambda c: c <> ''), lambda c: CASE WHEN c IN ('L', 'V') THEN 'L/V' WHEN c IN ('Q', 'T') THEN 'Q/T' ELSE c END)"


@query(f"""WITH ev AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
a AS (SELECT conv_id, turn, role, text, {translit("coalesce(text, '')")} AS letters, coalesce(event_type, '') AS kind, CAST(floor(value * 100 / 100 + 0.5) AS BIGINT) AS tenths FROM conversations LEFT JOIN ev ON user_id = conv_id AND k = turn),
b AS (SELECT *, {_CELLS} AS cells FROM a),
c AS (SELECT *, array_to_string(list_transform(cells, lambda c: CASE WHEN contains(c, '/') THEN '[' || c || ']' ELSE c END), '') AS shown, list_position(cells, 'L/V') AS lv, list_position(cells, 'Q/T') AS qt FROM b),
s AS (SELECT *, CASE WHEN kind = 'error' THEN 'error' WHEN coalesce(shown, '') = '' THEN 'empty' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN concat_ws(', ', role, CASE WHEN kind <> 'view' THEN 'fast reader' ELSE 'confidence ' || CAST(floor(round(length(letters) / length(text) * 100, 9) + 0.5) AS BIGINT) || ' %' END, (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines', (tenths // 10) || '.' || (tenths % 10) || ' s') END AS heading,
  md5(CASE WHEN status = 'error' THEN 'reader stopped' ELSE coalesce(shown, '') END) AS shown, CASE WHEN status <> 'ok' THEN NULL WHEN lv > 0 AND qt > 0 THEN CASE WHEN lv < qt THEN 'L/V, Q/T' ELSE 'Q/T, L/V' END WHEN lv > 0 THEN 'L/V' WHEN qt > 0 THEN 'Q/T' END AS legend, status = 'ok' AND kind = 'view' AS corrected FROM s""")
def assembled_answers(spark, d):
    """Turns as answers: the user's event of the same number is how the reader ran (an error, the old reader for a view) and for how long."""
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    runs = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), number.alias("turn"), F.col("event_type").alias("kind"), (F.col("value") * 100).alias("ms"))
    kind = F.coalesce("kind", F.lit(""))
    letters = T.translit(F.coalesce("text", F.lit("")))
    cells = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.when(c.isin("L", "V"), "L/V").when(c.isin("Q", "T"), "Q/T").otherwise(c))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    a = table(spark, d, "conversations").join(runs, ["conv_id", "turn"], "left")
    told = Q.answer(F.when(kind == "error", "reader stopped"), cells, Q.font_label(F.col("role"), "Family-"), Q.uses_neural(F.col("role"), kind == "view"), F.length(letters) / F.length("text"), lines, F.col("ms"))
    return a.select("conv_id", "turn", told["status"].alias("status"), told["heading"].alias("heading"), F.md5(told["text"].cast("binary")).alias("shown"), told["legend"].alias("legend"), told["corrected"].alias("corrected"))
