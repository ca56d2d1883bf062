"""Text, lexicon, evaluation and progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluate as V
from palimpsest.operators import lexicon as X
from palimpsest.plans.sqltext import fold, translit
from palimpsest.plans.tile_queries import query
from palimpsest.tables import materialize, table


@query(f"SELECT doc_id, md5({translit('text')}) AS folded FROM documents")
def translit_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.translit(F.col("text")).cast("binary")).alias("folded"))


@query(rf"""SELECT doc_id, md5(upper(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'SS'))) AS normed, md5(regexp_replace({fold('text')}, '[^A-Z ]+', '', 'g')) AS kept,
  md5(trim(regexp_replace(regexp_replace({fold('text')}, '[^A-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS spaced FROM documents""")
def norm_docs(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.norm(t).cast("binary")).alias("normed"), F.md5(T.translit_kept(t).cast("binary")).alias("kept"), F.md5(T.translit_spaced(t).cast("binary")).alias("spaced"))


@query(f"SELECT doc_id, md5(translate({translit('text')}, 'QV', 'TL')) AS canon, CAST(length({translit('text')}) - length(replace(replace({translit('text')}, 'Q', ''), 'V', '')) AS INT) AS twins FROM documents")
def canonical_docs(spark, d):
    s = T.translit(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.canonical(s, "QV", "TL").cast("binary")).alias("canon"), (F.length(s) - F.length(F.translate(s, "QV", ""))).alias("twins"))


LEX = r"""raw AS (SELECT raw, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '([\p{L}]+)', 1)) AS raw FROM documents) GROUP BY raw),
fo AS (SELECT %s AS word, raw, n FROM raw),
cn AS (SELECT word, sum(n) AS n, max(CAST(raw = upper(raw[1]) || lower(raw[2:]) AS INT)) > max(CAST(raw = lower(raw) AS INT)) AS is_noun FROM fo WHERE length(word) >= 2 GROUP BY word),
lex AS (SELECT word, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 AS INT) AS rnk, CAST(length(word) AS INT) AS len, is_noun FROM cn QUALIFY rnk < 12000)""" % translit("raw")


def _lexicon(spark, d):
    return X.build_lexicon(X.corpus_words(table(spark, d, "documents")))


@query(f"WITH {LEX} SELECT word, rnk, len FROM lex")
def lexicon_build(spark, d):
    return _lexicon(spark, d).select("word", "rnk", "len")


@query(f"WITH {LEX} SELECT len, count(*) AS n, CAST(sum(CAST(is_noun AS INT)) AS BIGINT) AS nouns FROM lex GROUP BY len")
def noun_flags(spark, d):
    return _lexicon(spark, d).groupBy("len").agg(F.count("*").alias("n"), F.sum(F.col("is_noun").cast("int")).alias("nouns"))


@query(f"WITH {LEX} SELECT word, rnk, is_noun FROM lex")
def noun_bits_roundtrip(spark, d):
    lex = _lexicon(spark, d)
    return X.unpack_noun_bits(lex, X.noun_bits(lex))


TURNS = f"""tu AS (SELECT a.conv_id, a.turn, {translit('a.text')} AS want, {translit('b.text')} AS got FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def _turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.translit(F.col("text")).alias("t"))
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("got"))
    return c.withColumnRenamed("t", "want").join(later, ["conv_id", "turn"])


@query(f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN length(want) = 0 THEN 1.0 ELSE levenshtein(want, got) / length(want) END, 6) AS cer FROM tu")
def cer_turns(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.round(T.cer(F.col("want"), F.col("got")), 6).alias("cer"))


@query(f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN greatest(length(want), length(got)) = 0 THEN 1.0 ELSE 1 - levenshtein(want, got) / greatest(length(want), length(got)) END, 6) AS similarity FROM tu")
def similarity_turns(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.round(T.similarity(F.col("want"), F.col("got")), 6).alias("similarity"))


@query(f"WITH {TURNS}, e AS (SELECT levenshtein(want, got) AS e, length(want) AS n FROM tu WHERE length(want) > 0) SELECT round(sum(e) / sum(n), 6) AS micro, round(avg(e / n), 6) AS macro, count(*) AS n FROM e")
def micro_vs_macro_cer(spark, d):
    e = _turns(spark, d).where("length(want) > 0").select(F.levenshtein("want", "got").alias("e"), F.length("want").alias("n"))
    return e.agg(F.round(F.sum("e") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("e") / F.col("n")), 6).alias("macro"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT lang AS a, source AS b, CAST(1 - quality AS DOUBLE) AS v FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN grouping(a) = 0 THEN 'a' WHEN grouping(b) = 0 THEN 'b' ELSE 'all' END AS by_what, coalesce(a, b) AS grp, count(*) AS n, round(avg(v), 6) AS mean_v, CAST(sum(CAST(v = 0 AS INT)) AS BIGINT) AS perfect
FROM r GROUP BY GROUPING SETS ((a), (b), ())""")
def eval_grouping_sets(spark, d):
    r = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id").withColumn("cer", (1 - F.col("quality")).cast("double"))
    return V.grouped_stats(r, "lang", "source")


def _spaced_turns(spark, d):
    """Neighbouring turns, words parted by spaces."""
    c = table(spark, d, "conversations").select("conv_id", "turn", T.translit_spaced(F.col("text")).alias("want_text"))
    t = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("want_text").alias("got_text")), ["conv_id", "turn"])
    return t.select(F.format_string("%012d/%06d", "conv_id", "turn").alias("key"), "want_text", "got_text")


def _edits(spark, d):
    return V.edit_scripts(_spaced_turns(spark, d))


def _twins(spark):
    return spark.createDataFrame([("L", "LV"), ("V", "LV"), ("Q", "QT"), ("T", "QT")], "ch string, grp string")


@query()
def edit_operations(spark, d):
    """Edits by kind of each pair of turns."""
    return _edits(spark, d).groupBy("key").agg(*[F.sum((F.col("op") == op).cast("long")).alias(op) for op in ("eq", "sub", "ins", "del")])


@query()
def confusion_topk(spark, d):
    return V.top_confusions(V.confusions(_edits(spark, d), _twins(spark)))


@query()
def confusion_counts(spark, d):
    """Raw and net counts of every confusion."""
    return V.confusions(_edits(spark, d), _twins(spark)).select("want", "got", "n", "net")


@query()
def letter_error_rates(spark, d):
    return V.letter_error_rates(_edits(spark, d))


@query()
def context_only_errors(spark, d):
    """Letters often wrong in words that the first letter of some turn gets right."""
    e = materialize(V.tallied_edits(_spaced_turns(spark, d)), "tallied-edits")
    return V.context_only_errors(e, e.where("lead and op = 'eq'"))


@query()
def word_start_errors(spark, d):
    return V.word_start_rates(_edits(spark, d))


@query(f"""WITH w AS (SELECT doc_id, string_split({translit('text')}, '') AS cs FROM documents)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(list_filter(cs, lambda c: c <> ''), lambda c: CASE WHEN c IN ('L', 'V') THEN '[L/V]' WHEN c IN ('Q', 'T') THEN '[Q/T]' ELSE c END), ''), '')) AS marked FROM w""")
def mark_ambiguous(spark, d):
    marks = {c: f"[{'/'.join(g)}]" for g in ("LV", "QT") for c in g}
    return table(spark, d, "documents").select("doc_id", F.md5(T.marked(T.translit(F.col("text")), marks).cast("binary")).alias("marked"))


@query(f"""WITH {LEX}, tk AS (SELECT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z]+|[^A-Z]+')) AS tok, generate_subscripts(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z]+|[^A-Z]+'), 1) AS i FROM documents),
s AS (SELECT *, regexp_matches(tok, '^[A-Z]+$') AS is_word, coalesce(lag(tok) OVER (PARTITION BY doc_id ORDER BY i), '.') AS before FROM tk),
f AS (SELECT doc_id, i, tok, is_word, i = min(CASE WHEN is_word THEN i END) OVER (PARTITION BY doc_id) OR regexp_matches(before, '[.!?\\n]') AS st, coalesce(is_noun, false) AS noun FROM s LEFT JOIN lex ON lex.word = tok),
o AS (SELECT doc_id, i, CASE WHEN NOT is_word OR length(tok) = 1 THEN tok WHEN noun OR st THEN tok[1] || lower(tok[2:]) ELSE lower(tok) END AS out FROM f)
SELECT doc_id, md5(string_agg(out, '' ORDER BY i)) AS recased FROM o GROUP BY doc_id""")
def recase_docs(spark, d):
    told = X.recased(table(spark, d, "documents").select("doc_id", "text"), _lexicon(spark, d))
    return told.where("out is not null and out <> ''").select("doc_id", F.md5(F.col("out").cast("binary")).alias("recased"))


TOKENS = rf"tok AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace({fold('text')}, '[^A-Z\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS token FROM benchmark) GROUP BY token)"


def _tokens(spark, d):
    toks = table(spark, d, "benchmark").select(F.explode(F.split(T.translit_spaced(F.col("text")), " ")).alias("token")).where("token <> ''")
    return toks.groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {LEX}, {TOKENS} SELECT token, n, token IN (SELECT word FROM lex) AS known FROM tok")
def exact_lexicon_mark(spark, d):
    return X.mark_known(_tokens(spark, d), _lexicon(spark, d)).select("token", "n", "known")


def _fuzzy_sql(dist: str, among: str = "true") -> str:
    """The best correction of each token by a distance, among the candidates of fitting length for which a condition holds."""
    swap = "length(token) = length(cand) AND len(df) = 1 AND df[1] IN ('EU', 'UE', 'BH', 'HB', 'TQ', 'QT', 'LV', 'VL', 'WV', 'VW', 'BW', 'WB')"
    return f"""WITH {LEX}, {TOKENS}, few AS (SELECT word, rnk, len FROM lex),
c AS (SELECT token, word AS cand, rnk FROM tok JOIN few ON len BETWEEN greatest(2, length(token) - CASE WHEN length(token) >= 6 THEN 2 ELSE 1 END) AND length(token) + CASE WHEN length(token) >= 6 THEN 2 ELSE 1 END WHERE length(token) >= 2 AND word <> token),
m AS (SELECT *, CASE WHEN length(token) <= 4 THEN 1 WHEN length(token) <= 7 THEN 2 WHEN length(token) <= 11 THEN 3 ELSE 4 END AS most FROM c),
b AS (SELECT *, levenshtein(token, cand) AS plain, levenshtein(translate(token, 'UQHLVW', 'ETBBBB'), translate(cand, 'UQHLVW', 'ETBBBB')) AS alike FROM m WHERE abs(length(token) - length(cand)) <= most),
e AS (SELECT *, {dist} AS dist FROM b WHERE {among}),
r AS (SELECT * FROM e WHERE NOT (dist >= 2 AND rnk > 8000)),
p AS (SELECT *, length(token) = length(cand) AS same, list_sum([CAST(token[i] = cand[i] AS INT) for i in generate_series(1, least(length(token), length(cand)))]) AS pos,
  [token[i] || cand[i] for i in generate_series(1, least(length(token), length(cand))) if token[i] <> cand[i]] AS df FROM r WHERE dist <= most),
w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY token ORDER BY round(dist, 6), same DESC, pos DESC, rnk, cand) = 1),
g AS (SELECT w.*, own.rnk AS own_rnk, {swap} AS swap FROM w LEFT JOIN few own ON own.word = w.token)
SELECT token, cand, round(dist, 6) AS dist FROM g WHERE pos >= ceil(length(token) / 3) AND (length(token) > 2 OR dist < 0.99 OR swap) AND (own_rnk IS NULL OR (same AND dist <= 0.5 AND swap AND rnk <= 100 AND rnk <= own_rnk / 20))"""


@query(_fuzzy_sql("CAST(levenshtein(token, cand) AS DOUBLE)"))
def fuzzy_unit_best(spark, d):
    return X.best_words(_tokens(spark, d), materialize(_lexicon(spark, d), "lexicon"), weighted=False).select("token", "cand", F.round("dist", 6).alias("dist"))


WEIGHTED = """list_reduce(list_prepend(CAST(range(0, length(cand) + 1) AS DOUBLE[]), list_transform(range(1, length(token) + 1), lambda i: [CAST(i AS DOUBLE)])),
  lambda prev, row: list_reduce(list_prepend([prev[1] + 1.0], list_transform(range(1, length(cand) + 1), lambda j: [CAST(j AS DOUBLE)])),
    lambda cur, j: cur || [least(prev[CAST(j[1] AS INT) + 1] + 1.0, cur[-1] + 1.0, prev[CAST(j[1] AS INT)] + CASE WHEN token[CAST(row[1] AS INT)] = cand[CAST(j[1] AS INT)] THEN 0.0
      WHEN token[CAST(row[1] AS INT)] || cand[CAST(j[1] AS INT)] IN ('EU', 'UE', 'BH', 'HB', 'TQ', 'QT', 'LV', 'VL', 'WV', 'VW', 'BW', 'WB') THEN 0.35 ELSE 1.0 END)]))[-1]"""


@query(_fuzzy_sql(WEIGHTED, "alike <= most"))
def fuzzy_weighted_best(spark, d):
    return X.best_words(_tokens(spark, d), materialize(_lexicon(spark, d), "lexicon")).select("token", "cand", F.round("dist", 6).alias("dist"))


@query(f"""WITH {LEX}, {TOKENS}, own AS (SELECT DISTINCT {translit('w')} AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE {translit('w')} <> ''),
both_ AS (SELECT coalesce(lex.word, own.word) AS word, coalesce(rnk, 99999) AS rnk, own.word IS NOT NULL AS cu FROM lex FULL JOIN own ON own.word = lex.word),
c AS (SELECT token, word AS cand, rnk, cu, CASE WHEN length(token) <= 4 THEN 1 WHEN length(token) <= 7 THEN 2 WHEN length(token) <= 11 THEN 3 ELSE 4 END AS most, length(token) = length(word) AS same, levenshtein(token, word) AS dist
  FROM tok JOIN both_ ON abs(length(word) - length(token)) <= CASE WHEN length(token) >= 6 THEN 2 ELSE 1 END WHERE length(token) >= 2 AND length(word) >= 2 AND word <> token),
p AS (SELECT *, list_sum([CAST(token[i] = cand[i] AS INT) for i in generate_series(1, least(length(token), length(cand)))]) AS pos,
  [token[i] || cand[i] for i in generate_series(1, least(length(token), length(cand))) if token[i] <> cand[i]] AS df FROM c WHERE dist <= most AND NOT (dist >= 2 AND rnk > 8000 AND NOT cu)),
w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY token ORDER BY dist, same DESC, pos DESC, cu DESC, rnk, cand) = 1),
g AS (SELECT w.*, b.rnk AS own_rnk, same AND len(df) = 1 AND df[1] IN ('EU', 'UE', 'BH', 'HB', 'TQ', 'QT', 'LV', 'VL', 'WV', 'VW', 'BW', 'WB') AS swap FROM w LEFT JOIN both_ b ON b.word = w.token)
SELECT token, cand, CAST(dist AS DOUBLE) AS dist, cu AS is_custom FROM g WHERE pos >= ceil(length(token) / 3) AND (length(token) > 2 OR dist < 0.99 OR swap OR cu) AND (own_rnk IS NULL OR cu OR (same AND dist <= 0.5 AND swap AND rnk <= 100 AND rnk <= own_rnk / 20))""")
def custom_word_best(spark, d):
    """Corrections where the words of part names are a user's own: rare as they are, they pass the gates and come first among equals.

    The SQL measures every pair of fitting length.
    """
    own = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    lexicon = materialize(X.build_lexicon(X.corpus_words(table(spark, d, "documents")), own), "lexicon")
    best = X.best_words(_tokens(spark, d), lexicon, weighted=False)
    told = best.join(lexicon.select(F.col("word").alias("cand"), "is_custom"), "cand")
    return told.select("token", "cand", F.round("dist", 6).alias("dist"), "is_custom")


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 3) AS font, TRY_CAST(regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)', 4) AS INT) AS pt, regexp_matches(url, '^(https?)://([^/]+)/([a-z]+)/([0-9]+)') AS fits FROM pages")
def catalog_regex(spark, d):
    p = r"^(https?)://([^/]+)/([a-z]+)/([0-9]+)"
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", p, 3).alias("font"), F.expr(f"try_cast(regexp_extract(url, r'{p}', 4) as int)").alias("pt"), F.col("url").rlike(p).alias("fits"))


@query("""WITH r AS (SELECT o_orderpriority AS item, year(o_orderdate) AS setting, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY value, setting) AS k, first_value(value) OVER (PARTITION BY item ORDER BY setting) AS base FROM r)
SELECT item, CAST(setting AS INT) AS setting, round(value, 2) AS value, round(value - base, 2) AS delta FROM k WHERE k = 1""")
def sweep_argmin_delta(spark, d):
    r = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("item"), F.year("o_orderdate").alias("setting")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return V.best_of_sweep(r, "item", "setting", "value").select("item", "setting", F.round("value", 2).alias("value"), F.round("delta", 2).alias("delta"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, len(list_filter(ws, lambda x: {translit('x')} <> x)) AS n, list_filter(ws, lambda x: {translit('x')} <> x)[1:20] AS firsts FROM w)
SELECT doc_id, CAST(n AS INT) AS n, array_to_string(list_transform(firsts, lambda x: x || '>' || {translit('x')}), ' ') AS changes FROM c""")
def changed_log_cap(spark, d):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: (x != "") & (T.translit(x) != x))
    c = table(spark, d, "documents").select("doc_id", words.alias("ws"))
    return c.select("doc_id", F.size("ws").alias("n"), F.array_join(F.transform(F.slice("ws", 1, 20), lambda x: F.concat(x, F.lit(">"), T.translit(x))), " ").alias("changes"))


@query("SELECT user_id, event_id, CAST(floor(epoch(ts)) - floor(epoch(before)) AS BIGINT) AS gap FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE floor(epoch(ts)) - floor(epoch(before)) > 7200")
def watchdog_gaps(spark, d):
    from palimpsest.streaming.progress import silent_gaps

    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts")
    return silent_gaps(e, 7200).select(F.col("job").alias("user_id"), F.col("seq").alias("event_id"), "gap")


@query("""WITH o AS (SELECT user_id, list(greatest(0.3, least(20.0, value / 10)) ORDER BY ts, event_id) AS fs FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, round(list_reduce(fs, lambda a, f: (a + f) / 2), 6) AS factor FROM o""")
def ewma_calibration(spark, d):
    from palimpsest.streaming.progress import calibrate

    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), "ts", (F.col("value") / 10).alias("pace"))
    return calibrate(e).select(F.col("device").alias("user_id"), F.round("factor", 6).alias("factor"))


@query("""WITH j AS (SELECT event_type, count(*) AS done, floor(epoch(max(ts))) - floor(epoch(min(ts))) AS elapsed FROM events GROUP BY event_type)
SELECT event_type, done, CAST(elapsed AS BIGINT) AS elapsed, round(elapsed + (50000 - done) * elapsed / done + 0.3, 3) AS eta FROM j""")
def eta_projection(spark, d):
    from palimpsest.streaming.progress import eta

    e = table(spark, d, "events").select(F.col("event_type").alias("job"), "ts")
    return eta(e, 50000).select(F.col("job").alias("event_type"), "done", "elapsed", F.round("eta", 3).alias("eta"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, max(event_type) OVER (PARTITION BY user_id) AS latest FROM events) WHERE event_type = latest")
def latest_job_only(spark, d):
    from palimpsest.streaming.progress import latest_only

    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("job"))
    return latest_only(e, "user_id", "job").withColumnRenamed("job", "event_type")
