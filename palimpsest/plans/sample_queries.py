"""Photo tags, a lexicon by dictionary rules and filled lines, on what the driver tables hold."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from palimpsest.operators import lexicon as X
from palimpsest.plans.sqltext import fold, translit
from palimpsest.plans.tile_queries import query
from palimpsest.sources import readers
from palimpsest.tables import table


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE p_partkey % 8 + 1 END AS INT) AS orientation FROM part")
def part_orientations(spark, d):
    """A photo's head per part, in either byte order, the tag at a place of its own, the same bytes elsewhere as a decoy."""
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("big"), (F.col("p_size") % 20).cast("int").alias("gap"), (F.col("p_partkey") % 8 + 1).alias("value"))

    def number(v, n):
        digits = F.lpad(F.hex(v.cast("long")), 2 * n, "0")
        return F.when(F.col("big"), digits).otherwise(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n, 0, -1)]))

    def entry(tag, value):
        return F.concat(number(F.lit(tag), 2), number(F.lit(3), 2), number(F.lit(1), 4), number(value, 2), F.lit("0000"))

    hidden = F.col("p_partkey") % 11 == 0  # such a photo has no tag of its own
    own = F.when(hidden, entry(0x0110, F.col("value"))).otherwise(entry(0x0112, F.col("value")))
    tags = F.concat(F.when(F.col("big"), "4D4D").otherwise("4949"), number(F.lit(42), 2), number(F.col("gap") + 8, 4), F.expr("repeat('EE', gap)"), number(F.lit(2), 2), entry(0x010F, F.lit(9)), own, F.lit("00000000"))
    length = lambda body: F.lpad(F.hex(F.length(body) / 2 + 2), 4, "0")
    decoy = entry(0x0112, F.col("value") % 8 + 1)
    body = F.concat(F.lit("457869660000"), tags)
    file = F.concat(F.lit("FFD8FFFE"), length(decoy), decoy, F.lit("FFE1"), length(body), body, F.lit("FFDA0002"), decoy, F.lit("FFD9"))
    return parts.select("p_partkey", readers.orientation(F.unhex(file)).alias("orientation"))


#: An affix file in small.
RULES = """SFX A Y 3
SFX A 0 e [^e]
SFX A e en e
SFX A y ies [^aeiou]y
SFX B N 1
SFX B 0 s .
PFX C Y 1
PFX C 0 un .
PFX D N 1
PFX D a o a"""
_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '([\p{L}]+)', 1)) AS w FROM benchmark"
_RULE_SQL = ", ".join(f"('{k}', '{f}', {c}, '{s}', '{a}', '{r}')" for k, f, c, s, a, r in (("SFX", "A", "true", "", "e", "[^e]"), ("SFX", "A", "true", "e", "en", "e"), ("SFX", "A", "true", "y", "ies", "[^aeiou]y"), ("SFX", "B", "false", "", "s", "."), ("PFX", "C", "true", "", "un", "."), ("PFX", "D", "false", "a", "o", "a")))
_PLACE_SQL = ", ".join(f"('{p}')" for p in X.T.PLACES)


def _ended(source: str) -> str:
    return f"SELECT left(w, length(w) - length(strip)) || adds AS w, flags, crossed FROM {source} JOIN ru ON kind = 'SFX' AND contains(flags, flag) WHERE regexp_matches(w, '(?:' || cond || ')$') AND suffix(w, strip)"


def _begun(source: str) -> str:
    return f"SELECT adds || w[length(strip) + 1:] AS w, flags, ru.crossed FROM {source} JOIN ru ON kind = 'PFX' AND contains(flags, flag) WHERE regexp_matches(w, '^(?:' || cond || ')') AND prefix(w, strip)"


@query(rf"""WITH ru AS (SELECT * FROM (VALUES {_RULE_SQL}) t(kind, flag, crossed, strip, adds, cond)),
sm AS (SELECT w, CASE WHEN length(w) % 2 = 0 THEN 'A' ELSE '' END || CASE WHEN length(w) % 3 = 0 THEN 'B' ELSE '' END || CASE WHEN length(w) % 5 = 0 THEN 'CD' ELSE '' END AS flags FROM ({_WORDS})),
en AS ({_ended("sm")}), bg AS ({_begun("sm")}), bo AS ({_begun("(SELECT w, flags FROM en WHERE crossed) e")}),
fm AS (SELECT w FROM sm UNION SELECT w FROM en UNION SELECT w FROM bg UNION SELECT w FROM bo WHERE crossed),
rw AS (SELECT raw, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '([\p{{L}}]+)', 1)) AS raw FROM documents) GROUP BY raw),
gd AS (SELECT {translit('raw')} AS word, n FROM rw WHERE raw IN (SELECT w FROM fm) OR lower(raw) IN (SELECT w FROM fm) OR upper(raw[1]) || lower(raw[2:]) IN (SELECT w FROM fm)),
cm AS (SELECT word, max(n) AS n FROM gd WHERE length(word) >= 2 GROUP BY word ORDER BY n DESC, word LIMIT 12000),
nn AS (SELECT {translit('w')} AS word, max(CAST(w[1] = upper(w[1]) AS INT)) > max(CAST(w[1] = lower(w[1]) AS INT)) AS noun FROM sm GROUP BY 1),
cu AS (SELECT {translit('w')} AS word, max(CAST(w[1] = upper(w[1]) AND w[1] <> lower(w[1]) AS INT)) AS capital FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS w FROM part) GROUP BY 1 HAVING length(word) >= 2),
al AS (SELECT word, 0 AS part, n FROM cm UNION ALL SELECT p, 1, 0 FROM (VALUES {_PLACE_SQL}) t(p) UNION ALL SELECT word, 2, 0 FROM cu),
on_ AS (SELECT word, min(part) AS part, arg_min(n, part) AS n, max(CAST(part = 1 AS INT)) AS place FROM al GROUP BY word)
SELECT on_.word, CAST(row_number() OVER (ORDER BY part, n DESC, on_.word) - 1 AS INT) AS rnk, CAST(length(on_.word) AS INT) AS len, capital IS NOT NULL AS is_custom, coalesce(noun, false) OR place = 1 OR coalesce(capital, 0) = 1 AS is_noun
FROM on_ LEFT JOIN nn ON nn.word = on_.word LEFT JOIN cu ON cu.word = on_.word""")
def lexicon_accepted(spark, d):
    """The words of documents that the stems of benchmark words accept by affix rules, with places and the first words of part names."""
    rules = X.affix_rules(spark.createDataFrame([(line,) for line in RULES.split("\n")], "value string"))
    stems = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}]+)"), 1)).alias("stem")).distinct()
    size = F.length("stem")
    flags = F.concat(F.when(size % 2 == 0, "A").otherwise(""), F.when(size % 3 == 0, "B").otherwise(""), F.when(size % 5 == 0, "CD").otherwise(""))
    custom = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("word")).distinct()
    return X.accepted_lexicon(X.corpus_words(table(spark, d, "documents")), stems.withColumn("flags", flags), rules, custom)


_FILL = """CASE WHEN s.fl OR length(s.tx) >= most THEN s WHEN s.tx = '' THEN struct_pack(tx := left(w.tx, most), fl := false)
  WHEN length(s.tx) + 1 + length(w.tx) > most THEN struct_pack(tx := s.tx, fl := true) ELSE struct_pack(tx := s.tx || ' ' || w.tx, fl := false) END"""


@query(rf"""WITH wd AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS at_ FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace({fold('text')}, '[^A-Z\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM benchmark)),
nw AS (SELECT count(*) AS n FROM wd), ky AS (SELECT p_partkey AS key, CAST(18 + ('0x' || md5('7/' || p_partkey || '/length')[1:8])::BIGINT % 25 AS INT) AS most FROM part),
sl AS (SELECT key, most, slot, ('0x' || md5('7/' || key || '/' || slot)[1:8])::BIGINT % n AS at_ FROM ky, range(0, 22) t(slot), nw),
ls AS (SELECT key, most, list(struct_pack(tx := w, fl := false) ORDER BY slot) AS ws FROM sl JOIN wd ON wd.at_ = sl.at_ GROUP BY key, most)
SELECT key AS p_partkey, list_reduce(list_prepend(struct_pack(tx := '', fl := false), ws), lambda s, w: {_FILL}).tx AS text FROM ls""")
def part_lines(spark, d):
    """A line of words drawn at random for each part."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(X.T.translit_spaced(F.col("text")), " ")).alias("word")).where("word <> ''").distinct()
    numbered = words.withColumn("at", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("word")) - 1).cast("long"))  # as many rows as a benchmark has words
    return X.filled_lines(table(spark, d, "part").select(F.col("p_partkey").alias("key")), numbered, "7").select(F.col("key").alias("p_partkey"), "text")
