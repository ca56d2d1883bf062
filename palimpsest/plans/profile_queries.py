"""Line finding over profiles: events per hour of a user group stand for ink per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import profiles as L
from palimpsest.plans.tile_queries import QUERIES, SQL  # noqa: F401
from palimpsest.plans.tile_queries import query
from palimpsest.tables import table

PROFILE = """pr AS (
  SELECT key, y, sum(n) AS n FROM (
    SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) - (SELECT CAST(floor(min(epoch(ts)) / 3600) AS BIGINT) FROM events) AS y, 1 AS n FROM events
    UNION ALL SELECT k.event_type, h.y, 0 FROM (SELECT DISTINCT event_type FROM events) k, (SELECT unnest(range(0, (SELECT CAST(floor(max(epoch(ts)) / 3600) - floor(min(epoch(ts)) / 3600) + 1 AS BIGINT) FROM events))) AS y) h
  ) GROUP BY key, y
)"""


def _profile(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("key"), F.expr("unix_timestamp(ts) div 3600").alias("hour"))
    span = events.agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    rows = events.groupBy("key", "hour").agg(F.count("*").alias("n"))
    grid = events.select("key").distinct().crossJoin(F.broadcast(span)).select("key", "h0", F.explode(F.sequence("h0", "h1")).alias("hour"))
    return grid.join(rows, ["key", "hour"], "left").select("key", (F.col("hour") - F.col("h0")).alias("y"), F.coalesce("n", F.lit(0)).alias("n"))


BANDS = PROFILE + """, bd AS (SELECT key, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT key, y, y - row_number() OVER (PARTITION BY key ORDER BY y) AS g FROM pr WHERE n >= 2) GROUP BY key, g HAVING max(y) + 1 - min(y) >= 2)"""


@query(f"WITH {BANDS} SELECT * FROM bd")
def profile_bands(spark, d):
    return L.bands_above(_profile(spark, d), 2, 2)


@query(f"WITH {PROFILE} SELECT key, y, round(avg(n) OVER (PARTITION BY key ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS sm FROM pr")
def profile_smooth(spark, d):
    return L.smooth(_profile(spark, d), 3).select("key", "y", F.round("sm", 6).alias("sm"))


VALLEYS = PROFILE + """, sm AS (SELECT *, avg(n) OVER (PARTITION BY key ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS sm, max(n) OVER (PARTITION BY key) AS peak, count(*) OVER (PARTITION BY key) AS h FROM pr),
sd AS (SELECT *, sm <= lag(sm) OVER w AND sm <= lead(sm) OVER w AS low, least(coalesce(max(sm) OVER (PARTITION BY key ORDER BY y ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), 0), coalesce(max(sm) OVER (PARTITION BY key ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING), 0)) AS side FROM sm WINDOW w AS (PARTITION BY key ORDER BY y)),
vl AS (SELECT key, y FROM sd WHERE low AND side >= peak * 0.18 AND sm / side <= 0.8 AND sm / peak < 0.55 AND y >= 3 AND y < h - 3)"""


@query(f"WITH {VALLEYS} SELECT * FROM vl")
def profile_valleys(spark, d):
    return L.valleys(_profile(spark, d))


@query(f"""WITH {VALLEYS}, o AS (SELECT key, list(y ORDER BY y) AS ys FROM vl GROUP BY key)
SELECT key, unnest(list_reduce(list_transform(ys, lambda y: [y]), lambda acc, y: CASE WHEN y[1] - acc[-1] > 6 THEN acc || y ELSE acc END)) AS y FROM o""")
def profile_split_dedupe(spark, d):
    kept = L.keep_apart(L.valleys(_profile(spark, d)), 6)
    return kept.select("key", F.explode("kept").alias("y")).withColumn("y", F.col("y").cast("long"))


@query(f"""WITH {BANDS}, o AS (SELECT key, list([y0, y1] ORDER BY y0) AS bs, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS target FROM bd GROUP BY key),
m AS (SELECT key, unnest(list_reduce(list_transform(bs, lambda b: [b]), lambda acc, b: CASE WHEN b[1][1] - acc[-1][2] <= 3 AND b[1][2] - acc[-1][1] <= target * 1.65 THEN acc[:-2] || [[acc[-1][1], b[1][2]]] ELSE acc || b END)) AS b FROM o)
SELECT key, b[1] AS y0, b[2] AS y1 FROM m""")
def profile_merge(spark, d):
    merged = L.merge_thin(L.bands_above(_profile(spark, d), 2, 2))
    return merged.select("key", F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


PITCH = PROFILE + """, df AS (SELECT key, y, n - lag(n) OVER (PARTITION BY key ORDER BY y) AS d FROM pr), dd AS (SELECT * FROM df WHERE d IS NOT NULL),
sc AS (SELECT a.key, lag, sum(a.d * b.d) / count(*) AS s FROM dd a, range(9, 61) t(lag), dd b WHERE b.key = a.key AND b.y = a.y + lag GROUP BY a.key, lag),
pk AS (SELECT key, lag, s FROM (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM sc WINDOW w AS (PARTITION BY key ORDER BY lag)) WHERE s >= a AND s >= b AND s > 0),
pt AS (SELECT k.key, coalesce(min(lag), 0) AS pitch FROM (SELECT DISTINCT key FROM pr) k LEFT JOIN (SELECT *, max(s) OVER (PARTITION BY key) AS top FROM pk) p ON p.key = k.key AND s >= top * 0.5 GROUP BY k.key)"""


@query(f"WITH {PITCH} SELECT key, CAST(pitch AS INT) AS pitch FROM pt")
def profile_pitch(spark, d):
    return L.pitch(_profile(spark, d), 9, 60)


@query(f"""WITH {BANDS}, t AS (SELECT key, y0, y1, y1 - y0 AS h, 3 AS pitch FROM bd), n AS (SELECT *, CASE WHEN h <= pitch * 1.55 THEN 1 ELSE greatest(2, CAST(floor((h + pitch * 0.15) / pitch + 0.5) AS BIGINT)) END AS parts FROM t),
e AS (SELECT *, unnest(range(0, parts)) AS i FROM n)
SELECT key, CAST(floor(y0 + i * (h / parts)) AS BIGINT) AS y0, CAST(ceil(y0 + (i + 1) * (h / parts)) AS BIGINT) AS y1 FROM e""")
def profile_split_tall(spark, d):
    return L.split_tall(L.bands_above(_profile(spark, d), 2, 2).withColumn("pitch", F.lit(3)))
