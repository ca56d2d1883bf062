"""The second reader on strips of eight tiles, the mean tile of each label being a letter; lines by growth on event profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import strips as S
from palimpsest.plans.profile_queries import PROFILE, _profile
from palimpsest.plans.sqltext import TILES, inked
from palimpsest.plans.tile_queries import _ink, _tiles, query
from palimpsest.tables import materialize

#: Tiles of a strip, rows of room above and below, size of an em and advance of a space in it.
TILES_A_STRIP, ROOM, EM, SPACE = 8, 2, 8.0, 0.5
STRIP_SQL = f"""{TILES}, {inked('px', 'ink')}, st AS (SELECT img // {TILES_A_STRIP} AS img, y + {ROOM} AS y, img % {TILES_A_STRIP} * 8 + x AS x FROM ink WHERE ink = 1),
tp AS (SELECT label, y, x, round(avg((255 - v) / 255), 9) AS mask FROM px GROUP BY label, y, x), ms AS (SELECT label, sum(mask) AS mass FROM tp GROUP BY label),
mt AS (SELECT st.img, label, st.y - tp.y AS y, st.x - tp.x AS x, sum(mask) AS both_, count(*) AS under FROM st JOIN tp ON st.y - tp.y BETWEEN 0 AND {2 * ROOM} AND st.x - tp.x BETWEEN 0 AND {8 * TILES_A_STRIP - 8} GROUP BY ALL),
mp AS (SELECT i.img, ms.label, a.y, b.x, coalesce(round(2 * both_ / (under + mass), 9), 0.0::DOUBLE) AS dice
  FROM (SELECT DISTINCT img FROM st) i CROSS JOIN ms CROSS JOIN range(0, {2 * ROOM + 1}) a(y) CROSS JOIN range(0, {8 * TILES_A_STRIP - 7}) b(x) LEFT JOIN mt ON mt.img = i.img AND mt.label = ms.label AND mt.y = a.y AND mt.x = b.x)"""


def _strips(spark, d):
    ink = _ink(spark, d)
    at = F.col("img") % TILES_A_STRIP
    rows = ink.select(((F.col("img") - at) / TILES_A_STRIP).cast("long").alias("img"), F.lit(8 * TILES_A_STRIP).alias("w"), F.lit(8).alias("h"), "y", (at * 8 + F.col("x")).alias("x"), "ink")
    return S.packed(rows, ROOM)


def _letters(spark, d):
    """The mean dark share of each label's tiles, label by label: as many masks as there are labels."""
    mean = _tiles(spark, d).groupBy("label", "y", "x").agg(F.round(F.avg((255 - F.col("v")) / 255), 9).alias("mask"))
    out = {}
    for r in mean.orderBy("label", "y", "x").collect():
        out.setdefault(r["label"], np.zeros((8, 8)))[r["y"], r["x"]] = r["mask"]
    return out


@query(f"WITH {STRIP_SQL} SELECT CAST(img AS VARCHAR) AS img, CAST(label AS VARCHAR) AS name, y, x, round(dice + 1e-10::DOUBLE, 6) AS dice FROM mp")
def strip_maps(spark, d):
    """How well each letter fits each place of each strip."""
    maps = S.correlation_maps(_strips(spark, d), {str(k): m for k, m in _letters(spark, d).items()})
    return maps.select("img", "name", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round(F.col("dice") + 1e-10, 6).alias("dice"))


_WIDTH, _HEIGHT = 8 * TILES_A_STRIP, 8 + 2 * ROOM


@query(f"""WITH RECURSIVE {STRIP_SQL}, sr AS (SELECT img, label, x, dice FROM mp WHERE y = {ROOM}),
ci AS (SELECT i.img, t.x, count(st.x) AS n FROM (SELECT DISTINCT img FROM st) i CROSS JOIN range(0, {_WIDTH}) t(x) LEFT JOIN st ON st.img = i.img AND st.x = t.x GROUP BY i.img, t.x),
pc AS (SELECT img, label + 1 AS piece, x, adv, 1 + 3 * label + adv - 6 AS ord, chr(CAST(65 + label AS INT)) AS ch, adv * (dice - 0.3::DOUBLE) AS gain FROM sr, range(7, 10) t(adv) WHERE dice >= 0.3 AND x + adv <= {_WIDTH}
  UNION ALL SELECT a.img, 0, a.x, adv, adv - 4, ' ', adv * (0.55::DOUBLE - 6.0::DOUBLE * (CAST(sum(b.n) AS DOUBLE) / (adv * {_HEIGHT})) - 0.3::DOUBLE) FROM ci a CROSS JOIN range(4, 6) t(adv) JOIN ci b ON b.img = a.img AND b.x >= a.x AND b.x < a.x + adv WHERE a.x + adv <= {_WIDTH} GROUP BY a.img, a.x, adv),
dp AS (SELECT DISTINCT img, 0 AS e, [0.0::DOUBLE] AS b, [''] AS t FROM st
  UNION ALL SELECT img, e, list_append(b, coalesce(top.v, -1e300::DOUBLE)), list_append(t, coalesce(top.s, '')) FROM (
    SELECT d.img, d.e + 1 AS e, any_value(d.b) AS b, any_value(d.t) AS t,
      (list(struct_pack(v := d.b[p.x + 1] + p.gain, s := d.t[p.x + 1] || p.ch) ORDER BY d.b[p.x + 1] + p.gain DESC, p.adv DESC, p.ord) FILTER (p.x IS NOT NULL AND d.b[p.x + 1] > -1e299))[1] AS top
    FROM dp d LEFT JOIN pc p ON p.img = d.img AND p.x + p.adv = d.e + 1 WHERE d.e < {_WIDTH} GROUP BY d.img, d.e)),
en AS (SELECT img, b, t, unnest(range({_WIDTH - 8}, {_WIDTH + 1})) AS e FROM dp WHERE e = {_WIDTH}),
bs AS (SELECT img, (list(struct_pack(v := b[e + 1], s := t[e + 1]) ORDER BY b[e + 1] DESC, e))[1] AS top FROM en GROUP BY img)
SELECT CAST(img AS VARCHAR) AS img, top.s AS text, round(top.v, 6) AS gain FROM bs""")
def strip_readings(spark, d):
    """Each strip as the row of letters and spaces that explains it best."""
    letters = _letters(spark, d)
    n = len(letters)
    masks = S.Masks(tuple(chr(65 + k) for k in letters), tuple(letters.values()), (8,) * n, (0,) * n, (0,) * n)
    return S.decoded_lines(_strips(spark, d), masks, EM, SPACE, ROOM).select("img", "text", F.round("gain", 6).alias("gain"))


LEAST, SHARE, CORE = 2, 0.3, 0.35


@query(f"""WITH {PROFILE}, sm AS (SELECT *, round((n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0)) / 3.0::DOUBLE, 9) AS s FROM pr WINDOW w AS (PARTITION BY key ORDER BY y)),
ab AS (SELECT *, s > max(s) OVER (PARTITION BY key) * {SHARE}::DOUBLE AS a FROM sm), rn AS (SELECT key, y, n, y - row_number() OVER (PARTITION BY key ORDER BY y) AS g FROM ab WHERE a),
bd AS (SELECT key, g, max(n) AS most, arg_max(y, n * 1000000 - y) AS core FROM rn GROUP BY key, g HAVING count(*) >= {LEAST} AND max(n) > 0),
de AS (SELECT rn.key, rn.g, y, core, y - row_number() OVER (PARTITION BY rn.key, rn.g ORDER BY y) AS i FROM rn JOIN bd ON bd.key = rn.key AND bd.g = rn.g WHERE n > most * {CORE}::DOUBLE)
SELECT key, min(y) AS y0, max(y) + 1 AS y1 FROM de GROUP BY key, g, i HAVING bool_or(y = core)""")
def profile_grown(spark, d):
    """Lines by growth from the densest row of each band."""
    rows = _profile(spark, d).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("r"))
    profiles = rows.select("key", F.size("r").alias("h"), F.transform("r", lambda v: v["n"].cast("double")).alias("p"))
    return S.grown_bands(profiles, LEAST, SHARE, CORE).select("key", F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


@query(f"""WITH {TILES}, {inked('px', 'ink')}, st AS (SELECT img // {TILES_A_STRIP} AS key, y + img % {TILES_A_STRIP} * 10 AS y, x FROM ink WHERE ink = 1),
pr AS (SELECT k.key, r AS y, count(st.y) AS n FROM (SELECT DISTINCT key FROM st) k CROSS JOIN range(0, {10 * TILES_A_STRIP}) t(r) LEFT JOIN st ON st.key = k.key AND st.y = r GROUP BY k.key, r),
sm AS (SELECT *, round((n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0)) / 3.0::DOUBLE, 9) AS s FROM pr WINDOW w AS (PARTITION BY key ORDER BY y)),
ab AS (SELECT *, s > max(s) OVER (PARTITION BY key) * {SHARE}::DOUBLE AS a FROM sm), rn AS (SELECT key, y, n, y - row_number() OVER (PARTITION BY key ORDER BY y) AS g FROM ab WHERE a),
bd AS (SELECT key, g, max(n) AS most, arg_max(y, n * 1000000 - y) AS core FROM rn GROUP BY key, g HAVING count(*) >= {LEAST} AND max(n) > 0),
de AS (SELECT rn.key, rn.g, y, core, y - row_number() OVER (PARTITION BY rn.key, rn.g ORDER BY y) AS i FROM rn JOIN bd ON bd.key = rn.key AND bd.g = rn.g WHERE n > most * {CORE}::DOUBLE),
gb AS (SELECT key, min(y) AS y0, max(y) + 1 AS y1 FROM de GROUP BY key, g, i HAVING bool_or(y = core)),
bo AS (SELECT gb.key, y0, y1, min(x) AS x0, max(x) + 1 AS x1 FROM gb JOIN st ON st.key = gb.key AND st.y >= y0 AND st.y < y1 GROUP BY gb.key, y0, y1 HAVING max(x) + 1 - min(x) >= {LEAST}),
ok AS (SELECT *, count(*) OVER (PARTITION BY key) AS c, median(y1 - y0) OVER (PARTITION BY key) AS mid FROM bo)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY y0) - 1 AS line, y0, y1, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1 FROM ok WHERE c < 3 OR y1 - y0 >= mid * 0.45""")
def tile_grown_lines(spark, d):
    """Columns of eight tiles as pages of eight lines, found by growth, with their bounds."""
    ink = _ink(spark, d).where("ink = 1")
    at = F.col("img") % TILES_A_STRIP
    pages = ink.select(((F.col("img") - at) / TILES_A_STRIP).cast("long").alias("key"), (F.col("y") + at * 10).cast("int").alias("y"), "x")
    pages = materialize(pages, "tile-pages")
    counts = pages.groupBy("key", "y").agg(F.count("*").cast("double").alias("n")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("rows"))
    profiles = counts.select("key", F.lit(10 * TILES_A_STRIP).alias("h"), F.expr(f"transform(sequence(0, {10 * TILES_A_STRIP - 1}), y -> coalesce(try_element_at(rows, y), 0D))").alias("p"))
    found = S.grown_lines(S.grown_bands(profiles, LEAST, SHARE, CORE), pages, LEAST)
    return found.select("key", *[F.col(c).cast("long").alias(c) for c in ("line", "y0", "y1", "x0", "x1")])
