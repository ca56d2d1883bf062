"""Glyph tables, requests, grouped reports, grids and samples over the driver tables.

Tiles stand for glyphs and parts for requests. A turn of a conversation read as the next one is a reading, with its error rate; the
user's event of the same number tells its kind, its seconds and when it began.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palimpsest.functions import requests as Q, text as T
from palimpsest.operators import evaluate as V, glyphs as G, reading as R
from palimpsest.plans.sqltext import translit
from palimpsest.plans.tile_queries import query
from palimpsest.tables import table

GLYPHS = """gl AS (SELECT 'font ' || label AS font, chr(CAST(65 + vec_id % 26 AS INT)) || CAST(vec_id // 26 AS VARCHAR) AS ch, CAST(vec_id % 4 AS DOUBLE) / 4 AS adv, CAST(0 AS DOUBLE) AS x0, -CAST(vec_id % 7 AS DOUBLE) / 8 AS y0,
  CAST(8 AS INT) AS w, CAST(4 + vec_id % 5 AS INT) AS h, array_to_string([CASE WHEN list_sum([embedding[i] for i in range(1, 65) if ((i - 1) // 32) * 3 + least(2, (i - 1) % 8 // 3) = r]) > 0 THEN '#' ELSE '.' END for r in range(0, 6)], '') AS bitmap FROM embeddings)"""


def _glyphs(spark, d):
    """Tiles as glyphs: the label is the font, the bitmap the tile in three by two cells, dark where its values there add up to more than nothing."""
    e = table(spark, d, "embeddings")
    n = F.col("vec_id")
    sums = F.expr("transform(sequence(0, 5), r -> aggregate(filter(embedding, (v, i) -> i div 32 * 3 + least(2, i % 8 div 3) = r), 0D, (s, v) -> s + v))")
    marks = F.array_join(F.transform(sums, lambda v: F.when(v > 0, "#").otherwise(".")), "")
    return e.select(F.concat(F.lit("font "), "label").alias("font"), F.concat(F.char(65 + n % 26), F.expr("vec_id div 26").cast("string")).alias("ch"), ((n % 4) / 4).alias("adv"), F.lit(0.0).alias("x0"), (-(n % 7) / 8).alias("y0"), F.lit(8).alias("w"), (4 + n % 5).cast("int").alias("h"), marks.alias("bitmap"))


@query(f"WITH {GLYPHS} SELECT font, min(y0) AS top, max(y0 + h / 8) AS bottom, max(y0 + h / 8) - min(y0) AS height, list_sort(list(h / 8))[count(*) // 2 + 1] AS median_h FROM gl WHERE h > 0 GROUP BY font")
def font_extents(spark, d):
    return G.extents(_glyphs(spark, d), 8)


@query(f"WITH {GLYPHS} SELECT font, round(coalesce(avg(adv) FILTER (WHERE adv <> 0), 0), 6) AS adv_em FROM gl GROUP BY font")
def font_advances(spark, d):
    return G.mean_advances(_glyphs(spark, d)).select("font", F.round("adv_em", 6).alias("adv_em"))


@query(f"WITH {GLYPHS} SELECT font, min(adv) AS least_adv, max(adv) AS most_adv, min(h) AS least_h, max(h) AS most_h, max(adv) - min(adv) AS adv_spread, max(h) - min(h) AS h_spread, max(adv) = min(adv) AS monospaced FROM gl GROUP BY font")
def font_spacing(spark, d):
    return G.spacing(_glyphs(spark, d))


@query(f"WITH {GLYPHS} SELECT font, string_agg(ch, '' ORDER BY ch) AS grp, CAST(count(*) AS INT) AS n FROM gl GROUP BY font, bitmap HAVING count(*) > 1")
def look_alike_glyphs(spark, d):
    return G.look_alikes(_glyphs(spark, d))


@query(f"WITH {GLYPHS} SELECT font, count(*) AS letters, count(DISTINCT w || '/' || h || '/' || bitmap[1] || '/' || bitmap[3] || '/' || bitmap[5] || '/' || adv) AS looks FROM gl GROUP BY font")
def glyph_signatures(spark, d):
    return G.signatures(_glyphs(spark, d), (0, 2, 4))


@query(f"WITH {GLYPHS}, s AS (SELECT DISTINCT font, 0.5::DOUBLE AS space_adv FROM gl WHERE font <= 'font 3') SELECT gl.font, count(*) AS n, round(sum(coalesce(space_adv, 0.25)), 6) AS spaces FROM gl LEFT JOIN s ON s.font = gl.font WHERE w > 0 AND h > 0 GROUP BY gl.font")
def usable_glyphs(spark, d):
    g = _glyphs(spark, d)
    spaces = g.where("font <= 'font 3'").select("font", F.lit(0.5).alias("space_adv")).distinct()
    return G.usable(g, spaces).groupBy("font").agg(F.count("*").alias("n"), F.round(F.sum("space_adv"), 6).alias("spaces"))


REQUESTS = """rq AS (SELECT p_partkey, CAST(p_size * 61 + 200 AS INT) AS w, CAST(p_partkey % 1700 + 150 AS INT) AS h, CASE WHEN p_partkey % 5 = 0 THEN '__auto__' ELSE 'Family-' || replace(p_type, ' ', '-') END AS font,
  p_partkey % 3 = 0 AS legacy, p_partkey % 2 = 0 AS detail, p_partkey % 7 < 3 AS warm, 0.3 + (p_partkey % 11) / 10.0::DOUBLE AS factor FROM part),
en AS (SELECT *, font <> '__auto__' AND NOT legacy AS neural FROM rq), sd AS (SELECT *, CASE WHEN neural AND detail THEN 2200 ELSE 1100 END AS side FROM en),
ft AS (SELECT *, CAST(greatest(1, floor(w * least(1.0::DOUBLE, side / greatest(w, h)::DOUBLE) + 0.5)) AS INT) AS dw, CAST(greatest(1, floor(h * least(1.0::DOUBLE, side / greatest(w, h)::DOUBLE) + 0.5)) AS INT) AS dh FROM sd),
es AS (SELECT *, CAST(greatest(1, floor(40 * (h / 1850.0::DOUBLE) + 0.5)) AS INT) AS n_lines FROM ft),
sc AS (SELECT *, CAST(greatest(1, floor(round(CASE WHEN neural THEN factor * (0.4 + (dw * dh) / 1e6 * 0.1 + n_lines * 0.05 + CASE WHEN warm THEN 0.0 ELSE 0.5 END) ELSE factor * (0.4 + (dw * dh) / 1e6 * 0.1 + n_lines * 0.05) * 60 * CASE WHEN font = '__auto__' THEN 8 ELSE 1 END END, 9) + 0.5)) AS INT) AS seconds FROM es)"""


def _requests(spark, d):
    """Requests with sizes, font and reader, as parts have them."""
    n = F.col("p_partkey")
    r = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 61 + 200).cast("int").alias("w"), (n % 1700 + 150).cast("int").alias("h"), F.when(n % 5 == 0, "__auto__").otherwise(F.concat(F.lit("Family-"), F.replace("p_type", F.lit(" "), F.lit("-")))).alias("font"), (n % 3 == 0).alias("legacy"), (n % 2 == 0).alias("detail"), (n % 7 < 3).alias("warm"), (0.3 + (n % 11) / 10).alias("factor"))
    r = r.withColumn("neural", Q.uses_neural(F.col("font"), F.col("legacy"))).withColumn("side", Q.longest_side(F.col("neural"), F.col("detail")))
    dw, dh = Q.fitted(F.col("w"), F.col("h"), F.col("side"))
    r = r.withColumn("dw", dw).withColumn("dh", dh).withColumn("n_lines", Q.estimated_lines(F.col("h") / 1850.0))
    return r.withColumn("seconds", Q.estimated_seconds(F.col("dw") * F.col("dh"), F.col("h") / 1850.0, F.col("neural"), F.col("warm"), F.when(F.col("font") == "__auto__", 8).otherwise(1), F.col("factor")))


@query(f"WITH {REQUESTS} SELECT p_partkey, neural, side, dw, dh, n_lines, seconds FROM sc")
def request_estimates(spark, d):
    return _requests(spark, d).select("p_partkey", "neural", "side", "dw", "dh", "n_lines", "seconds")


@query(f"""WITH {REQUESTS} SELECT p_partkey, replace(regexp_replace(font, '^Family-', ''), '-', ' ') AS label, CASE WHEN seconds < 60 THEN 'ca. ' || seconds || ' s' WHEN seconds % 60 = 0 THEN 'ca. ' || seconds // 60 || ' min' ELSE 'ca. ' || seconds // 60 || ' min ' || seconds % 60 || ' s' END AS told,
  NOT neural AND (dw * dh > 700000 OR greatest(dw, dh) >= side) AS large FROM sc""")
def request_texts(spark, d):
    r = _requests(spark, d)
    return r.select("p_partkey", Q.font_label(F.col("font"), "Family-").alias("label"), Q.time_text(F.col("seconds")).alias("told"), Q.is_large(F.col("dw"), F.col("dh"), F.col("side"), F.col("neural")).alias("large"))


@query(f"WITH {REQUESTS} SELECT p_partkey, round(greatest(1.0::DOUBLE, greatest(w, h) / 1100.0::DOUBLE), 6) AS scale, CAST(greatest(1, floor(7 * greatest(1.0::DOUBLE, greatest(w, h) / 1100.0::DOUBLE) + 0.5)) AS INT) AS px, round(h / 0.75, 6) AS em FROM rq")
def page_scales(spark, d):
    scale = Q.page_scale(F.col("w"), F.col("h"))
    return _requests(spark, d).select("p_partkey", F.round(scale, 6).alias("scale"), Q.scaled_px(7, scale).alias("px"), F.round(Q.em_of_height(F.col("h")), 6).alias("em"))


@query(r"""SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS INT) AS n_tokens, regexp_matches(regexp_replace(upper(text), '[^A-Z]+', ' ', 'g'), '\bTHE\s*ON\b') AS says,
  CASE WHEN text IS NULL THEN 'error' WHEN trim(text) = '' THEN 'empty' ELSE 'ok' END AS status FROM conversations""")
def answer_status(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(Q.tokens(text)).alias("n_tokens"), Q.says(text, "THE", "ON").alias("says"), Q.status(F.when(text.isNull(), "no text"), text).alias("status"))


@query("SELECT p_partkey, array_to_string([chr(CAST(ascii(c) + 61440 AS INT)) for c in string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '')], '') AS coded FROM part")
def symbol_codes(spark, d):
    """Part names as code points of a symbol font."""
    return table(spark, d, "part").select("p_partkey", Q.encoded(T.translit(F.col("p_name")), 0xF000).alias("coded"))


@query("""SELECT p_partkey, array_to_string([CASE WHEN i = 1 AND p_size % 2 = 0 THEN c ELSE lower(c) END for c, i in [CASE WHEN x IN ('L', 'V') THEN 'L/V' ELSE x END for x in string_split(regexp_replace(upper(p_name), '[^A-Z]', '', 'g'), '')]], '') AS cased FROM part""")
def marked_casing(spark, d):
    cells = F.transform(F.split(T.translit(F.col("p_name")), ""), lambda c: F.when(c.isin("L", "V"), "L/V").otherwise(c))
    return table(spark, d, "part").select("p_partkey", Q.marked_case(cells, F.col("p_size") % 2 == 0).alias("cased"))


TIMED = f"""ev AS (SELECT user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
tu AS (SELECT a.conv_id, a.turn, a.role AS font, {translit('a.text')} AS want, {translit('b.text')} AS got FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
tm AS (SELECT conv_id * 1000 + turn AS reading, font, event_type AS brief, round(CASE WHEN length(want) = 0 THEN 1.0::DOUBLE ELSE levenshtein(want, got) / length(want) END, 6) AS cer, value / 10 AS sec, length(got) > length(want) AS inverted, length(want) > 0 AS ok,
  CAST(700 + 200 * least(4, length(want) // 100) AS INT) AS dim, CAST(floor(epoch(ts)) AS BIGINT) AS began FROM tu JOIN ev ON ev.user_id = tu.conv_id AND ev.k = tu.turn)"""


def _timed(spark, d):
    """Readings: font (role), brief (kind of event), error rate, seconds, whether longer than the truth, whether there is a truth, size by the truth's length, start."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", T.translit(F.col("text")).alias("want"))
    pairs = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("want").alias("got")), ["conv_id", "turn"])
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    events = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), number.alias("turn"), "ts", "event_type", "value")
    size = F.length("want")
    return pairs.join(events, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reading"),
        F.col("role").alias("font"),
        F.col("event_type").alias("brief"),
        F.round(T.cer(F.col("want"), F.col("got")), 6).alias("cer"),
        (F.col("value") / 10).alias("sec"),
        (F.length("got") > size).alias("inverted"),
        (size > 0).alias("ok"),
        (700 + 200 * F.least(F.lit(4), F.floor(size / 100))).cast("int").alias("dim"),
        F.unix_timestamp("ts").alias("began"),
    )


@query(f"WITH {TIMED} SELECT font, brief, count(*) AS n, round(avg(cer), 6) AS mean_cer, round(avg(sec), 6) AS mean_sec FROM tm GROUP BY font, brief")
def report_by_font_and_brief(spark, d):
    return V.means(_timed(spark, d), ["font", "brief"], mean_cer="cer", mean_sec="sec")


@query(f"WITH {TIMED} SELECT font, count(*) FILTER (WHERE brief = 'view') AS n, round(avg(cer) FILTER (WHERE brief = 'view'), 6) AS mean_cer FROM tm GROUP BY font")
def report_clean_by_font(spark, d):
    return V.means(_timed(spark, d), ["font"], F.col("brief") == "view", mean_cer="cer")


@query(f"WITH {TIMED} SELECT brief, count(*) AS n, round(avg(cer), 6) AS mean_cer, CAST(sum(CAST(inverted AS INT)) AS BIGINT) AS inverted FROM tm GROUP BY brief")
def report_inverted(spark, d):
    return V.means(_timed(spark, d), ["brief"], sums=("inverted",), mean_cer="cer")


@query(f"WITH {TIMED} SELECT dim, count(*) FILTER (WHERE ok) AS n, round(avg(cer) FILTER (WHERE ok), 6) AS adjusted, round(avg(sec) FILTER (WHERE ok), 6) AS prep FROM tm GROUP BY dim")
def report_by_size(spark, d):
    return V.means(_timed(spark, d), ["dim"], F.col("ok"), adjusted="cer", prep="sec")


@query(f"WITH {TIMED} SELECT round(sum(sec), 3) AS cpu, round(max(began + sec) - min(began), 3) AS wall, round(sum(sec) / (max(began + sec) - min(began)), 9) AS speed_up FROM tm")
def report_speed_up(spark, d):
    s = V.speed_up(_timed(spark, d).select("began", (F.col("began") + F.col("sec")).alias("done")), "began", "done")
    return s.select(F.round("cpu", 3).alias("cpu"), F.round("wall", 3).alias("wall"), F.round("speed_up", 9).alias("speed_up"))


@query(f"WITH {TIMED} SELECT rpad(font, 16, ' ') || '  ' || lpad(CAST(count(*) AS VARCHAR), 8, ' ') || '  ' || rpad(brief, 2, ' ') AS line FROM tm GROUP BY font, brief")
def report_lines(spark, d):
    return V.report(V.means(_timed(spark, d), ["font", "brief"]), font=16, n=8, brief=2)


@query(f"WITH {TIMED} SELECT font, CASE WHEN count(*) = 0 THEN '-' ELSE CAST(CAST(floor(100.0::DOUBLE * sum(CAST(inverted AS INT)) / count(*) + 0.5) AS BIGINT) AS VARCHAR) || '% (' || sum(CAST(inverted AS INT)) || '/' || count(*) || ')' END AS told FROM tm GROUP BY font")
def report_shares(spark, d):
    s = V.means(_timed(spark, d), ["font"], sums=("inverted",))
    return s.select("font", Q.share_text(F.col("inverted"), F.col("n")).alias("told"))


@query(f"WITH {TIMED} SELECT font, brief, dim, reading, cer FROM tm QUALIFY row_number() OVER (PARTITION BY font, brief ORDER BY round(cer, 9) DESC, reading) = 1")
def best_candidates(spark, d):
    return V.first_best(_timed(spark, d), ["font", "brief"], "cer", "reading").select("font", "brief", "dim", "reading", "cer")


@query(f"WITH {TIMED} SELECT font, reading, cer FROM tm WHERE cer > 0 QUALIFY row_number() OVER (PARTITION BY font ORDER BY cer DESC, reading) <= 25")
def worst_examples(spark, d):
    """The 25 worst readings of each font, as a report shows them."""
    return V.examples(_timed(spark, d).where("cer > 0"), ["font"], [F.desc("cer"), "reading"], 25).select("font", "reading", "cer")


@query(f"WITH {TIMED}, s AS (SELECT font, list_sort(list(DISTINCT dim)) AS ds FROM tm GROUP BY font) SELECT font, CAST(CASE WHEN len(ds) > 1 THEN ds[2] - ds[1] ELSE ds[1] * 0.08 END AS DOUBLE) AS step FROM s")
def size_steps(spark, d):
    return V.size_step(_timed(spark, d), "font", "dim").select("font", F.col("step").cast("double").alias("step"))


@query(f"""WITH {TIMED}, m AS (SELECT reading, reading // 64 AS batch, dim FROM tm) SELECT reading, batch, CAST(ceil(max(dim) OVER (PARTITION BY batch) / 4.0) * 4 AS BIGINT) AS padded, CAST(greatest(1, dim // 8) AS BIGINT) AS steps FROM m""")
def padded_batches(spark, d):
    return V.padded(_timed(spark, d), "dim", "reading", 64).select("reading", "batch", "padded", "steps")


@query(f"WITH {TIMED} SELECT DISTINCT font, brief FROM tm")
def font_brief_keys(spark, d):
    return _timed(spark, d).select("font", "brief").distinct()


@query(f"WITH {TIMED}, f AS (SELECT DISTINCT font FROM tm), b AS (SELECT DISTINCT brief FROM tm), s AS (SELECT DISTINCT dim FROM tm) SELECT font, brief, dim FROM f, b, s UNION ALL SELECT 'scan', 'scan', dim FROM s")
def sweep_grid(spark, d):
    """Every size with every font and brief, and one scan of each size."""
    t = _timed(spark, d)
    axes = [t.select(c).distinct() for c in ("font", "brief", "dim")]
    return V.grid(*axes).unionByName(axes[2].select(F.lit("scan").alias("font"), F.lit("scan").alias("brief"), "dim"))


@query(f"WITH {TIMED}, c AS (SELECT * FROM (VALUES (5, 5), (7, 9)) v(steps, fine)) SELECT steps, fine, font, count(*) AS n, round(avg(cer * steps / fine), 6) AS mean_cer FROM tm, c GROUP BY steps, fine, font")
def settings_by_items(spark, d):
    settings = spark.createDataFrame([(5, 5), (7, 9)], "steps int, fine int")
    tried = V.grid(_timed(spark, d), F.broadcast(settings)).withColumn("value", F.col("cer") * F.col("steps") / F.col("fine"))
    return V.means(tried, ["steps", "fine", "font"], mean_cer="value")


@query(rf"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '\p{{L}}+')) AS word, generate_subscripts(regexp_extract_all(text, '\p{{L}}+'), 1) AS i FROM benchmark), t AS (SELECT item_id * 1000000 + i AS ord, word, {translit('word')} AS u FROM w)
SELECT u, word, ord FROM t QUALIFY row_number() OVER (PARTITION BY u ORDER BY ord) = 1""")
def first_seen_words(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)).alias("i", "word"))
    return V.first_seen(w.select((F.col("item_id") * 1000000 + F.col("i") + 1).alias("ord"), "word", T.translit(F.col("word")).alias("u")), ["u"], "ord").select("u", "word", "ord")


@query(f"WITH {GLYPHS}, gg AS (SELECT font, string_agg(ch[1], '' ORDER BY ch) AS grp FROM gl GROUP BY font, bitmap HAVING count(*) > 1) SELECT font, c AS ch, array_to_string(string_split(grp, ''), '/') AS alternatives, count(*) AS n FROM (SELECT font, grp, unnest(string_split(grp, '')) AS c FROM gg) GROUP BY font, c, grp")
def glyph_alternatives(spark, d):
    g = _glyphs(spark, d).groupBy("font", "bitmap").agg(F.array_sort(F.collect_list("ch")).alias("chs")).where(F.size("chs") > 1)
    groups = g.select("font", F.array_join(F.transform("chs", lambda c: F.substring(c, 1, 1)), "").alias("grp"))
    return G.ambiguity(groups).groupBy("font", "ch", "alternatives").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, CAST(10 + o_orderkey % 40 AS INT) AS tall FROM orders),
l AS (SELECT o_orderkey, least(tall / 1.25::DOUBLE, tall / 0.8::DOUBLE) * 0.9::DOUBLE AS lo, greatest(tall / 1.25::DOUBLE, tall / 0.8::DOUBLE) * 1.25::DOUBLE AS hi, tall + 4 AS bot FROM a),
c AS (SELECT o_orderkey, lo + (hi - lo) * i / 4 AS em, bot - 0.25::DOUBLE * (lo + (hi - lo) * i / 4) AS b1, 4 + 1.0::DOUBLE * (lo + (hi - lo) * i / 4) AS b2 FROM l, range(0, 5) t(i)),
u AS (SELECT o_orderkey, em, b1 AS baseline FROM c WHERE em >= 6 UNION ALL SELECT o_orderkey, em, b2 FROM c WHERE em >= 6 AND abs(b2 - b1) > 3 UNION ALL SELECT o_orderkey, em, (b1 + b2) / 2 FROM c WHERE em >= 6 AND abs(b2 - b1) > 3)
SELECT o_orderkey, count(*) AS n, round(min(em), 6) AS least_em, round(max(em), 6) AS most_em, round(sum(baseline), 4) AS baselines FROM u GROUP BY o_orderkey""")
def line_scale_candidates(spark, d):
    """Sizes and baselines to try on lines of many heights."""
    lines = table(spark, d, "orders").select("o_orderkey", F.lit(4).alias("ink_top"), (14 + F.col("o_orderkey") % 40).cast("int").alias("ink_bottom"), F.lit(-1.0).alias("top"), F.lit(0.25).alias("bottom"), F.lit(1.25).alias("height"), F.lit(0.8).alias("median_h"))
    c = R.coarse_candidates(lines, 5).select("o_orderkey", F.explode("cands").alias("c"))
    return c.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.min("c.em"), 6).alias("least_em"), F.round(F.max("c.em"), 6).alias("most_em"), F.round(F.sum("c.baseline"), 4).alias("baselines"))
