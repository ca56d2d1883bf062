"""Filters, resampling and connected ink on embedding tiles, band outliers, page texts and split words."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import filters as N, lexicon as X, profiles as L
from palimpsest.plans.profile_queries import BANDS, _profile
from palimpsest.plans.sqltext import TILES, fold
from palimpsest.plans.text_queries import LEX, WEIGHTED, _lexicon, _tokens
from palimpsest.plans.tile_queries import INK, _ink, _tiles, query
from palimpsest.tables import materialize, table

SIZE = 5


def _placed(df, *values):
    return df.select("img", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *values)


@query(f"""WITH {TILES}, w AS (SELECT img, y, x, greatest(0, least(7, y + dy)) AS sy, greatest(0, least(7, x + dx)) AS sx FROM px, range(-2, 3) a(dy), range(-2, 3) b(dx))
SELECT w.img, w.y, w.x, list_sort(list(q.v))[13] AS v FROM w JOIN px q ON q.img = w.img AND q.y = w.sy AND q.x = w.sx GROUP BY w.img, w.y, w.x""")
def tile_median(spark, d):
    return _placed(N.median_blur(_tiles(spark, d), SIZE), "v")


BLUR = f"""{TILES}, g AS (SELECT * FROM (VALUES {", ".join(f"({i - SIZE // 2}, {w!r}::DOUBLE)" for i, w in enumerate(N.gaussian_weights(SIZE)))}) t(d, wt)),
r0 AS (SELECT img, y, x, wt, CASE WHEN abs(x + d) > 7 THEN 14 - abs(x + d) ELSE abs(x + d) END AS sx FROM px, g),
r1 AS (SELECT r0.img, r0.y, r0.x, sum(wt * v) AS b FROM r0 JOIN px q ON q.img = r0.img AND q.y = r0.y AND q.x = r0.sx GROUP BY r0.img, r0.y, r0.x),
c0 AS (SELECT img, y, x, wt, CASE WHEN abs(y + d) > 7 THEN 14 - abs(y + d) ELSE abs(y + d) END AS sy FROM px, g),
c1 AS (SELECT c0.img, c0.y, c0.x, sum(wt * b) AS blur FROM c0 JOIN r1 q ON q.img = c0.img AND q.y = c0.sy AND q.x = c0.x GROUP BY c0.img, c0.y, c0.x),
bl AS (SELECT px.img, px.y, px.x, v, blur FROM px JOIN c1 ON c1.img = px.img AND c1.y = px.y AND c1.x = px.x)"""


@query(f"WITH {BLUR} SELECT img, y, x, CAST(greatest(0, least(255, floor(round(CASE WHEN blur <= 0 THEN 0 ELSE v / blur * 180.0::DOUBLE END, 9)))) AS INT) AS v FROM bl")
def tile_flatten_light(spark, d):
    return _placed(N.flatten_light(_tiles(spark, d), SIZE), "v")


@query(f"WITH {BLUR} SELECT img, CAST(sum(CASE WHEN v <= floor(round(blur, 9) + 0.5) - 12 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM bl GROUP BY img")
def tile_adaptive_ink(spark, d):
    return N.adaptive_ink(_tiles(spark, d), SIZE).groupBy("img").agg(F.sum("ink").alias("n"))


@query(f"""WITH {TILES}, t AS (SELECT img, ty, tx, (ty + 0.5) * 8 / 6 - 0.5::DOUBLE AS sy, (tx + 0.5) * 8 / 6 - 0.5::DOUBLE AS sx FROM (SELECT DISTINCT img FROM px), range(0, 6) a(ty), range(0, 6) b(tx)),
c AS (SELECT img, ty, tx, greatest(0, least(7, floor(sy) + dy)) AS y, greatest(0, least(7, floor(sx) + dx)) AS x,
  CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END * CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END AS share FROM t, range(0, 2) e(dy), range(0, 2) f(dx))
SELECT c.img, ty AS y, tx AS x, round(sum(v * share) / 255, 6) AS v FROM c JOIN px q ON q.img = c.img AND q.y = c.y AND q.x = c.x GROUP BY c.img, ty, tx""")
def tile_resample(spark, d):
    return _placed(N.resample(_tiles(spark, d), 6, 6), F.round("v", 6).alias("v"))


REACH = INK.replace("WITH", "WITH RECURSIVE", 1) + """, mk AS (SELECT img, y, x, v, y * 8 + x AS p FROM ink WHERE ink = 1),
reach AS (SELECT img, p, p AS r FROM mk UNION SELECT reach.img, reach.p, n.p FROM reach JOIN mk n ON n.img = reach.img AND abs(n.y - reach.r // 8) <= 1 AND abs(n.x - reach.r % 8) <= 1),
lb AS (SELECT img, p, min(r) AS label FROM reach GROUP BY img, p),
st AS (SELECT lb.img, label, count(*) AS area, avg(v) AS mean_v FROM lb JOIN mk ON mk.img = lb.img AND mk.p = lb.p GROUP BY lb.img, label)"""


@query(f"{REACH} SELECT img, CAST(label AS INT) AS label, area, round(mean_v, 6) AS mean_v FROM st")
def tile_components(spark, d):
    return N.component_stats(_ink(spark, d)).select("img", "label", "area", F.round("mean_v", 6).alias("mean_v"))


@query(f"{REACH} SELECT i.img, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT img FROM ink) i LEFT JOIN (SELECT img, sum(area) AS n FROM st WHERE area >= 4 GROUP BY img) s ON s.img = i.img")
def tile_drop_specks(spark, d):
    return N.drop_specks(_ink(spark, d), 4).groupBy("img").agg(F.sum("ink").cast("long").alias("n"))


@query(f"{REACH} SELECT i.img, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT img FROM ink) i LEFT JOIN (SELECT img, sum(area) AS n FROM st WHERE mean_v <= 100 GROUP BY img) s ON s.img = i.img")
def tile_drop_faint(spark, d):
    return N.drop_faint(_ink(spark, d), 100).groupBy("img").agg(F.sum("ink").cast("long").alias("n"))


def _corner(rank: str, name: str) -> str:
    """Place of the first pixel by rank, as two columns."""
    return f"(list(p ORDER BY {rank}, p))[1] // 8 AS {name}_y, (list(p ORDER BY {rank}, p))[1] % 8 AS {name}_x"


@query(f"{INK}, k AS (SELECT img, x, y, y * 8 + x AS p FROM ink WHERE ink = 1) SELECT img, {_corner('x + y', 'tl')}, {_corner('y - x', 'tr')}, {_corner('-(x + y)', 'br')}, {_corner('x - y', 'bl')} FROM k GROUP BY img")
def tile_ink_corners(spark, d):
    got = N.ink_corners(_ink(spark, d))
    return got.select("img", *[F.col(c).cast("long").alias(c) for c in got.columns if c != "img"])


MEDIANS = f"WITH {BANDS}, md AS (SELECT key, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS upper, median(y1 - y0) AS middle, count(*) AS n FROM bd GROUP BY key)"


@query(f"{MEDIANS} SELECT bd.key, y0, y1 FROM bd JOIN md ON md.key = bd.key WHERE n < 3 OR y1 - y0 <= upper * 2.4")
def profile_drop_tall(spark, d):
    return L.drop_tall(L.bands_above(_profile(spark, d), 2, 2))


@query(f"{MEDIANS} SELECT bd.key, y0, y1 FROM bd JOIN md ON md.key = bd.key WHERE n < 3 OR y1 - y0 >= middle * 0.45")
def profile_drop_low(spark, d):
    return L.drop_low(L.bands_above(_profile(spark, d), 2, 2))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS page, round(coalesce(avg(length(text)), 0), 6) AS mean_length FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def page_texts(spark, d):
    """Lines put together in order, with the mean of a figure of each line."""
    lines = table(spark, d, "conversations").where("text is not null")
    told = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ls"), F.avg(F.length("text")).alias("mean_length"))
    return told.select("conv_id", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("page"), F.round("mean_length", 6).alias("mean_length"))


def _glued(spark, d):
    """Benchmark words and each pair of neighbours without the space between them."""
    words = F.filter(F.split(T.translit_spaced(F.col("text")), " "), lambda x: x != "")
    told = table(spark, d, "benchmark").select(words.alias("ws"))
    pairs = F.zip_with("ws", F.slice("ws", F.lit(2), F.size("ws")), lambda a, b: F.concat(a, b))
    return told.select(F.explode(pairs).alias("token")).where("token is not null").unionByName(_tokens(spark, d).select("token")).distinct()


def _best_sql(name: str, tokens: str, limit: int | None = None) -> str:
    """CTE of the best correction of each token of a CTE: (token, cand, dist). Every word of fitting length is scored whose folded form is near enough."""
    most = "CASE WHEN length(token) <= 4 THEN 1 WHEN length(token) <= 7 THEN 2 WHEN length(token) <= 11 THEN 3 ELSE 4 END" if limit is None else str(limit)
    slack = "CASE WHEN length(token) >= 6 THEN 2 ELSE 1 END" if limit is None else str(limit)
    pairs = "('EU', 'UE', 'BH', 'HB', 'TQ', 'QT', 'LV', 'VL', 'WV', 'VW', 'BW', 'WB')"
    dist, near = WEIGHTED, "levenshtein(translate(token, 'UQHLVW', 'ETBBBB'), translate(cand, 'UQHLVW', 'ETBBBB')) <= most"
    if limit == 1:  # up to 1 there are one plain edit, or confusions alone
        unlike = "[token[i] || cand[i] for i in generate_series(1, length(token)) if token[i] <> cand[i]]"
        dist = f"CASE WHEN length(token) = length(cand) AND len({unlike}) <= 2 AND len(list_filter({unlike}, lambda x: x NOT IN {pairs})) = 0 THEN 0.35::DOUBLE * len({unlike}) WHEN levenshtein(token, cand) <= 1 THEN 1.0::DOUBLE ELSE 9.0::DOUBLE END"
        near = "levenshtein(token, cand) <= 2"
    swap = "length(token) = length(cand) AND len(df) = 1 AND df[1] IN ('EU', 'UE', 'BH', 'HB', 'TQ', 'QT', 'LV', 'VL', 'WV', 'VW', 'BW', 'WB')"
    return f"""{name}_c AS (SELECT token, word AS cand, rnk, {most} AS most FROM {tokens} JOIN lex ON abs(len - length(token)) <= least({most}, {slack}) WHERE length(token) >= 2 AND word <> token),
{name}_e AS MATERIALIZED (SELECT *, {dist} AS dist FROM {name}_c WHERE {near}),
{name}_p AS (SELECT *, length(token) = length(cand) AS same, list_sum([CAST(token[i] = cand[i] AS INT) for i in generate_series(1, least(length(token), length(cand)))]) AS pos,
  [token[i] || cand[i] for i in generate_series(1, least(length(token), length(cand))) if token[i] <> cand[i]] AS df FROM {name}_e WHERE dist <= most AND NOT (dist >= 2 AND rnk > 8000)),
{name}_w AS (SELECT * FROM {name}_p QUALIFY row_number() OVER (PARTITION BY token ORDER BY round(dist, 6), same DESC, pos DESC, rnk, cand) = 1),
{name}_g AS (SELECT w.*, own.rnk AS own_rnk, {swap} AS swap FROM {name}_w w LEFT JOIN lex own ON own.word = w.token),
{name} AS (SELECT token, cand, dist FROM {name}_g WHERE pos >= ceil(length(token) / 3) AND (length(token) > 2 OR dist < 0.99 OR swap) AND (own_rnk IS NULL OR (same AND dist <= 0.5 AND swap AND rnk <= 100 AND rnk <= own_rnk / 20)))"""


def _split_sql(name: str, tokens: str) -> str:
    """CTE of the best cut of each unknown token of a CTE into two words."""
    return f"""{name}_k AS (SELECT token, unnest(range(3, length(token) - 2)) AS cut FROM {tokens} WHERE length(token) BETWEEN 6 AND 14 AND token NOT IN (SELECT word FROM lex)),
{name}_a AS (SELECT token, cut, token[:cut] AS a, token[cut + 1:] AS b FROM {name}_k), {name}_h AS (SELECT a AS token FROM {name}_a UNION SELECT b FROM {name}_a),
{name}_u AS (SELECT token FROM {name}_h WHERE token NOT IN (SELECT word FROM lex)), {_best_sql(f"{name}_m", f"{name}_u", 1)},
{name}_t AS (SELECT token, token AS cand, 0.0::DOUBLE AS dist FROM {name}_h WHERE token IN (SELECT word FROM lex) UNION ALL SELECT * FROM {name}_m),
{name}_f AS (SELECT t.* FROM {name}_t t JOIN lex ON lex.word = t.cand WHERE rnk <= 8000),
{name} AS (SELECT c.token, x.cand || ' ' || y.cand AS cand, x.dist + y.dist AS dist FROM {name}_a c JOIN {name}_f x ON x.token = c.a JOIN {name}_f y ON y.token = c.b WHERE x.dist + y.dist <= 1
  QUALIFY row_number() OVER (PARTITION BY c.token ORDER BY round(x.dist + y.dist, 6), cut, x.cand || ' ' || y.cand) = 1)"""


def _correct_sql(name: str, tokens: str) -> str:
    """CTE of each token's correction: one word, or two where those are strictly closer."""
    return f"""{name}_q AS MATERIALIZED (SELECT DISTINCT token FROM {tokens} WHERE length(token) >= 2), {_best_sql(f"{name}_1", f"{name}_q")}, {_split_sql(f"{name}_2", f"{name}_q")},
{name} AS (SELECT token, cand, dist FROM (SELECT *, 0 AS way FROM {name}_1 UNION ALL SELECT *, 1 FROM {name}_2) QUALIFY row_number() OVER (PARTITION BY token ORDER BY round(dist, 6), way, cand) = 1)"""


_WORDS_SQL = rf"list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace({fold('text')}, '[^A-Z\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
_GLUED_SQL = f"bw AS (SELECT {_WORDS_SQL} AS ws FROM benchmark), tk AS (SELECT unnest(ws) AS token FROM bw UNION SELECT unnest([ws[i] || ws[i + 1] for i in range(1, len(ws))]) FROM bw)"


@query(f"WITH {LEX}, {_GLUED_SQL}, {_split_sql('sp', 'tk')} SELECT token, cand, round(dist, 6) AS dist FROM sp")
def split_guess(spark, d):
    """Words that are two words without a space, with the best place to cut."""
    lex = materialize(_lexicon(spark, d), "lexicon")
    return X.split_words(_glued(spark, d), lex).select("token", "cand", F.round("dist", 6).alias("dist"))


@query(f"WITH {LEX}, {_GLUED_SQL}, {_correct_sql('cr', 'tk')} SELECT token, cand, round(dist, 6) AS dist FROM cr")
def word_corrections(spark, d):
    """Benchmark words and glued pairs with their correction: one word, or two."""
    lex = materialize(_lexicon(spark, d), "lexicon")
    return X.correct_words(_glued(spark, d), lex).select("token", "cand", F.round("dist", 6).alias("dist"))


def _torn(spark, d):
    """Benchmark lines in capitals with some words torn apart, as a bad reading leaves them."""
    texts = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = F.filter(F.split(T.translit_spaced(F.col("text")), " "), lambda x: x != "")
    torn = F.flatten(F.transform(words, lambda x, i: F.when((i % 3 == 1) & (F.length(x) > 4), F.array(F.substring(x, 1, 2), F.substring(x, 3, 1 << 20))).otherwise(F.array(x))))
    return texts.select(F.col("item_id").cast("string").alias("key"), "line", torn.alias("tokens"))


@query()
def token_repair(spark, d):
    """Torn lines put together and corrected, with the casing of sentences."""
    lex = materialize(_lexicon(spark, d), "lexicon")
    fixed = materialize(X.repair_lines(_torn(spark, d), lex), "repaired")
    text = X.cased_lines(fixed, lex)
    return fixed.join(text, ["key", "line"]).select("key", "line", F.size("words").alias("n_words"), "text")


@query()
def repair_changes(spark, d):
    """Per text the first lines that repair changed."""
    lex = materialize(_lexicon(spark, d), "lexicon")
    lines = _torn(spark, d)
    return X.changed_lines(lines, X.repair_lines(lines, lex)).select("key", F.array_join("changes", "\n").alias("changes"))
