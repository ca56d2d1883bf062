"""Word lexicons: building, exact marking, fuzzy correction of words and repair of lines.

A lexicon is (word, rnk, len, is_custom, is_noun), rnk counting from 0 in order of frequency. Fuzzy candidates
are found by an equality join on short pieces of words, which loses none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions import text as T
from palimpsest.operators.pixels import dealt
from palimpsest.tables import materialize

#: Caps and gates of the lexicon and of corrections.
CAP, RARE_RANK, UNKNOWN_RANK = 12000, 8000, 99999
SWAP_RANK, SWAP_RATIO = 100, 20
SPLIT_FROM, SPLIT_TO, LEAST_PART, SPLIT_DISTANCE = 6, 14, 3, 1


def corpus_words(docs: DataFrame) -> DataFrame:
    """(raw, n): the words of letters of all texts, as written, with their counts."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}]+)"), 1)
    return docs.select(F.explode(words).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))


def build_lexicon(words: DataFrame, custom: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """Lexicon of (raw, n): folded words of two letters or more by falling count, ties by word, the first `cap`.

    A word is a noun when its capitalised form occurs and its lower-case form does not. Custom words (word)
    are added behind, or marked where they are present.
    """
    folded = words.withColumn("word", T.translit(F.col("raw"))).where(F.length("word") >= 2)
    capital = F.col("raw") == F.concat(F.upper(F.substring("raw", 1, 1)), F.lower(F.substring("raw", 2, 1 << 30)))
    lower = F.col("raw") == F.lower("raw")
    counted = folded.groupBy("word").agg(F.sum("n").alias("n"), (F.max(capital.cast("int")) > F.max(lower.cast("int"))).alias("is_noun"))
    top = counted.orderBy(F.desc("n"), "word").limit(cap)
    ranked = top.withColumn("rnk", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "word")) - 1).cast("int"))
    out = ranked.select("word", "rnk", F.length("word").alias("len"), F.lit(False).alias("is_custom"), "is_noun")
    if custom is None:
        return out
    own = custom.select(T.translit(F.col("word")).alias("word")).where("word <> ''").distinct().withColumn("own", F.lit(True))
    return out.join(own, "word", "full").select("word", F.coalesce("rnk", F.lit(UNKNOWN_RANK)).alias("rnk"), F.length("word").alias("len"), F.coalesce("own", F.lit(False)).alias("is_custom"), F.coalesce("is_noun", F.lit(False)).alias("is_noun"))


def affix_rules(lines: DataFrame) -> DataFrame:
    """Rules (kind, flag, crossed, strip, add, cond) of an affix file's lines (value).

    A head `SFX A Y 4` tells whether the flag's rules combine with those of the other kind, a rule `SFX A e en [^n]e` what is taken off, put on, and how
    a stem has to end (PFX: begin). Flags are single letters; flags that a rule itself hands on are left out.
    """
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.get("f", F.lit(0)).isin("PFX", "SFX"))
    kind, flag = F.col("f")[0].alias("kind"), F.col("f")[1].alias("flag")
    heads = f.where("size(f) = 4").select(kind, flag, (F.col("f")[2] == "Y").alias("crossed"))
    bare = lambda c: F.when(c == "0", F.lit("")).otherwise(c)
    rules = f.where("size(f) >= 5").select(kind, flag, bare(F.col("f")[2]).alias("strip"), bare(F.split(F.col("f")[3], "/")[0]).alias("add"), F.col("f")[4].alias("cond"))
    return rules.join(heads.distinct(), ["kind", "flag"], "left").select("kind", "flag", F.coalesce("crossed", F.lit(False)).alias("crossed"), "strip", "add", "cond")


def _affixed(words: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """Words (word, flags) -> (word, flags, crossed) with each fitting rule of their flags applied."""
    own = rules.where(F.col("kind") == kind)
    met = words.withColumn("flag", F.explode(F.split("flags", ""))).join(own, "flag")
    end = kind == "SFX"
    fits = F.rlike("word", F.concat(F.lit("(?:"), "cond", F.lit(")$")) if end else F.concat(F.lit("^(?:"), "cond", F.lit(")")))
    rest = F.expr("left(word, length(word) - length(strip))" if end else "substring(word, length(strip) + 1)")
    there = F.endswith("word", "strip") if end else F.startswith("word", "strip")
    return met.where(fits & there).select((F.concat(rest, "add") if end else F.concat("add", rest)).alias("word"), "flags", "crossed")


def affixed_forms(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """(form): stems (stem, flags) and all words that one suffix, one prefix, or one of each where both allow it, make of them."""
    plain = stems.select(F.col("stem").alias("word"), F.coalesce("flags", F.lit("")).alias("flags"))
    ended = _affixed(plain, rules, "SFX")
    begun = _affixed(plain, rules, "PFX")
    both = _affixed(ended.where("crossed").select("word", "flags"), rules, "PFX").where("crossed")
    return plain.select("word").unionByName(ended.select("word")).unionByName(begun.select("word")).unionByName(both.select("word")).select(F.col("word").alias("form")).distinct()


def _first_capital(word: Column) -> Column:
    """A capital first, as one letter: an initial sharp s has one of its own, other letters whose capital is several stay."""
    first = F.substring(word, 1, 1)
    capital = F.when(first == "ß", F.lit("ẞ")).when(F.length(F.upper(first)) > 1, first).otherwise(F.upper(first))
    return F.concat(capital, F.substring(F.lower(word), 2, 1 << 30))


def accepted(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Words (raw, ..) that are a form as they are, in small letters, or with a capital first."""
    ways = F.array_distinct(F.array("raw", F.lower("raw"), _first_capital(F.col("raw"))))
    known = words.select("raw").distinct().withColumn("form", F.explode(ways)).join(forms, "form", "left_semi").select("raw").distinct()
    return words.join(known, "raw", "left_semi")


def accepted_lexicon(words: DataFrame, stems: DataFrame, rules: DataFrame, custom: DataFrame, cap: int = CAP) -> DataFrame:
    """A lexicon of the words (raw, n) that a dictionary's stems and affix rules accept, of place names and of custom words (word).

    Folded words by falling count of their first spelling, the first `cap` (ties by word); then places, then custom words by name, each once. A word
    is a noun when its stem is written with a capital only, a place always, a custom word also when it begins with a capital.
    """
    folded_stems = stems.select(F.col("stem"), T.translit(F.col("stem")).alias("word")).where(F.length("word") >= 2)
    begins = F.substring("stem", 1, 1)
    nouns = folded_stems.groupBy("word").agg((F.max((begins == F.upper(begins)).cast("int")) > F.max((begins == F.lower(begins)).cast("int"))).alias("noun")).where("noun")
    good = accepted(words, affixed_forms(stems, rules)).withColumn("word", T.translit(F.col("raw"))).where(F.length("word") >= 2)
    common = good.groupBy("word").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "word").limit(cap).withColumn("part", F.lit(0))
    places = words.sparkSession.createDataFrame([(p,) for p in T.PLACES], "word string").select("word", F.lit(0).cast("long").alias("n"), F.lit(1).alias("part"))
    own = custom.select(T.translit(F.col("word")).alias("word"), F.substring("word", 1, 1).alias("first")).where(F.length("word") >= 2)
    own = own.groupBy("word").agg(F.max(((F.col("first") == F.upper("first")) & (F.col("first") != F.lower("first"))).cast("int")).alias("capital"))
    listed = common.unionByName(places).unionByName(own.select("word", F.lit(0).cast("long").alias("n"), F.lit(2).alias("part")))
    once = listed.groupBy("word").agg(F.min(F.struct("part", (-F.col("n")).alias("n"))).alias("at"), F.max((F.col("part") == 1).cast("int")).alias("place"))
    told = once.join(nouns, "word", "left").join(own, "word", "left")
    # a lexicon has at most `cap` words besides places and a user's own
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at.part", "at.n", "word")) - 1
    noun = F.coalesce("noun", F.lit(False)) | (F.col("place") == 1) | (F.coalesce("capital", F.lit(0)) == 1)
    return told.select("word", rank.cast("int").alias("rnk"), F.length("word").alias("len"), F.col("capital").isNotNull().alias("is_custom"), noun.alias("is_noun"))


#: Fixed values of filled lines: least and most letters.
FILL_FROM, FILL_TO = 18, 42


def _drawn(seed: str) -> Column:
    """A number from 0 to 2^32 - 1 that follows from a text."""
    return F.conv(F.substring(F.md5(F.expr(seed).cast("binary")), 1, 8), 16, 10).cast("long")


def filled_lines(keys: DataFrame, words: DataFrame, seed: str) -> DataFrame:
    """Lines of words drawn at random, one per key (key, text): each is filled to a length of its own, FILL_FROM to FILL_TO letters.

    words: (word, at), at counting from 0. Which length and which words follow from hashes of seed, key and the word's number in the line, so the lines are the
    same however the keys are spread. A word that would make its line too long ends it; a first word that is too long is cut. Without words there are no lines.
    """
    size = words.agg(F.count("*").alias("size"))
    line = keys.select("key").crossJoin(size).where("size > 0").withColumn("most", (FILL_FROM + _drawn(f"concat('{seed}', '/', key, '/length')") % (FILL_TO - FILL_FROM + 1)).cast("int"))  # one row of a count
    # words have a letter at least, so a line takes no more than half as many as it may have letters
    slots = line.withColumn("slot", F.explode(F.expr(f"sequence(0, {FILL_TO} div 2)"))).withColumn("at", _drawn(f"concat('{seed}', '/', key, '/', slot)") % F.col("size"))
    drawn = slots.join(words, "at").groupBy("key", "most").agg(F.array_sort(F.collect_list(F.struct("slot", "word"))).alias("ws"))
    text = """aggregate(ws, named_struct('text', '', 'full', false), (s, w) -> case
      when s.full or length(s.text) >= most then s
      when s.text = '' then named_struct('text', left(w.word, most), 'full', false)
      when length(s.text) + 1 + length(w.word) > most then named_struct('text', s.text, 'full', true)
      else named_struct('text', concat(s.text, ' ', w.word), 'full', false) end, s -> s.text)"""
    return drawn.select("key", F.expr(text).alias("text"))


def noun_bits(lexicon: DataFrame) -> DataFrame:
    """Noun flags as bytes (byte_no, bits), bit rnk & 7 of byte rnk >> 3."""
    bit = F.when(F.col("is_noun"), F.expr("shiftleft(1, rnk % 8)")).otherwise(0)
    return lexicon.groupBy(F.expr("rnk div 8").alias("byte_no")).agg(F.sum(bit).cast("int").alias("bits"))


def unpack_noun_bits(lexicon: DataFrame, bits: DataFrame) -> DataFrame:
    """(word, rnk, is_noun) with the flags read back from noun_bits."""
    at = lexicon.select("word", "rnk", F.expr("rnk div 8").alias("byte_no"))
    return at.join(bits, "byte_no").select("word", "rnk", (F.expr("shiftright(bits, rnk % 8)") % 2 == 1).alias("is_noun"))


def mark_known(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add known: whether the token is a word of the lexicon."""
    return tokens.join(lexicon.select(F.col("word").alias("token"), F.lit(True).alias("known")), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: Letters of a piece that are compared; an untouched piece has an untouched beginning.
PIECE_LETTERS = 4


def folded(word: Column) -> Column:
    """Confusable letters as one, so that only other edits are left between two words."""
    return F.translate(word, "UQHLVW", "ETBBBB")


def candidates(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, cand, rnk, is_custom): words of similar length other than the token, within its distance limit but for confusions.

    k edits leave one of k + 1 pieces of a token as it is, at most k places away. So each piece is joined with the
    equal pieces of words at those places; what meets is then checked by the distance of the folded words.
    """
    asked = tokens.select("token").distinct().where(F.length("token") >= 2).withColumn("most", T.distance_limit(F.length("token")))
    asked = asked.withColumn("f", folded(F.col("token")))
    pieces = F.expr(
        f"""transform(sequence(0, most), i -> named_struct('at', length(token) * i div (most + 1),
          'gram', substr(f, int(length(token) * i div (most + 1)) + 1, least({PIECE_LETTERS}, int(length(token) * (i + 1) div (most + 1) - length(token) * i div (most + 1))))))"""
    )
    asked = asked.select("token", "f", "most", F.explode(pieces).alias("p"))
    asked = asked.select("token", "f", "most", "p.gram", F.explode(F.expr("sequence(int(p.at) - most, int(p.at) + most)")).alias("at")).where("at >= 0")
    asked = dealt(asked, "token")  # few bytes make many candidates: by their bytes all would meet in one task
    words = lexicon.select(F.col("word").alias("cand"), "rnk", "is_custom", folded(F.col("word")).alias("g"))
    grams = F.expr(f"flatten(transform(sequence(1, {PIECE_LETTERS}), n -> if(length(g) >= n, transform(sequence(0, length(g) - n), a -> named_struct('at', a, 'gram', substr(g, a + 1, n))), array())))")
    words = words.select("cand", "rnk", "is_custom", "g", F.explode(grams).alias("w")).select("cand", "rnk", "is_custom", "g", F.col("w.at").alias("at"), F.col("w.gram").alias("gram"))
    slack = F.when(F.length("token") >= 6, 2).otherwise(1)
    met = asked.join(words, ["gram", "at"]).where((F.abs(F.length("cand") - F.length("token")) <= slack) & (F.length("cand") >= 2) & (F.col("cand") != F.col("token")))
    return met.select("token", "f", "most", "cand", "rnk", "is_custom", "g").distinct().where(F.levenshtein("f", "g") <= F.col("most")).select("token", "cand", "rnk", "is_custom")


def close_candidates(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As candidates, for distances of 1 at most, by an equality join.

    Within one edit two words share a form with one letter left out at most; beyond it only confusions can
    add up to 1 or less, and those leave a word the same once confusable letters are folded into one.
    """

    def forms(word: str):
        less = F.expr(f"transform(sequence(1, length({word})), i -> concat(left({word}, i - 1), substring({word}, i + 1)))")
        alike = F.concat(F.lit("~"), folded(F.col(word)))
        return F.explode(F.array_distinct(F.concat(F.array(F.col(word), alike), less)))

    asked = tokens.select("token").distinct().where(F.length("token") >= 2).select("token", forms("token").alias("form"))
    asked = dealt(asked, "token")
    words = lexicon.select(F.col("word").alias("cand"), "rnk", "is_custom", forms("word").alias("form"))
    return asked.join(words, "form").where("cand <> token").select("token", "cand", "rnk", "is_custom").distinct()


def best_words(tokens: DataFrame, lexicon: DataFrame, weighted: bool = True, limit: int | None = None) -> DataFrame:
    """The best correction of each token, if one passes: (token, cand, dist).

    Candidates within the distance limit are ranked by distance, same length, equal positions, custom, rank;
    the gates then test the winner only, so a failing winner means no correction.
    """
    near = close_candidates(tokens, lexicon) if limit == 1 else candidates(tokens, lexicon)
    far = F.abs(F.length("token") - F.length("cand"))
    near = near.withColumn("most", T.distance_limit(F.length("token")) if limit is None else F.lit(limit)).where(far <= F.col("most"))
    near = near.withColumn("plain", F.levenshtein("token", "cand"))
    if weighted:
        # the weighted distance is at most the plain one, and at least that of the folded words or the plain one at the cost of
        # confusions; so a candidate whose bound is above the least plain distance of a token can't be its best
        bound = F.greatest(F.levenshtein(folded(F.col("token")), folded(F.col("cand"))).cast("double"), F.col("plain") * T.CONFUSABLE_COST)
        sure = F.when((F.col("rnk") <= RARE_RANK) | F.col("is_custom") | (F.col("plain") < 2), F.col("plain"))
        near = near.withColumn("up", F.coalesce(F.min(sure).over(Window.partitionBy("token")), F.col("most"))).where(bound <= F.least("up", "most"))
    near = near.withColumn("dist", T.weighted_distance("token", "cand") if weighted else F.col("plain").cast("double"))
    near = near.where("dist <= most").where(~((F.col("dist") >= 2) & (F.col("rnk") > RARE_RANK) & ~F.col("is_custom")))
    near = near.withColumn("same", F.length("token") == F.length("cand")).withColumn("pos", T.position_matches(F.col("token"), F.col("cand")))
    order = [F.round("dist", 6), F.desc("same"), F.desc("pos"), F.desc("is_custom"), "rnk", "cand"]
    won = near.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where("r = 1")
    own = lexicon.select(F.col("word").alias("token"), F.col("rnk").alias("own_rnk"))
    won = won.join(own, "token", "left").withColumn("swap", T.is_confusion_swap(F.col("token"), F.col("cand")))
    enough = F.col("pos") >= F.ceil(F.length("token") / 3)
    short = (F.length("token") > 2) | (F.col("dist") < 0.99) | F.col("swap") | F.col("is_custom")
    settled = F.col("own_rnk").isNull() | F.col("is_custom") | (F.col("same") & (F.col("dist") <= 0.5) & F.col("swap") & (F.col("rnk") <= SWAP_RANK) & (F.col("rnk") <= F.col("own_rnk") / SWAP_RATIO))
    return won.where(enough & short & settled).select("token", "cand", "dist")


def split_words(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The best cut of each unknown token into two words, if one passes: (token, cand, dist).

    Each half is a word or the best correction of one; both are frequent or custom, and their distances add
    up to SPLIT_DISTANCE at most. The least distance wins, then the first cut.
    """
    unknown = mark_known(tokens.select("token").distinct(), lexicon).where(~F.col("known") & F.length("token").between(SPLIT_FROM, SPLIT_TO))
    cuts = unknown.select("token", F.explode(F.sequence(F.lit(LEAST_PART), F.length("token") - LEAST_PART)).alias("at"))
    cuts = cuts.select("token", "at", F.expr("left(token, at)").alias("a"), F.expr("substring(token, at + 1)").alias("b"))
    halves = mark_known(cuts.select(F.explode(F.array("a", "b")).alias("token")).distinct(), lexicon)
    mended = best_words(halves.where("not known"), lexicon, limit=SPLIT_DISTANCE)
    told = halves.where("known").select("token", F.col("token").alias("cand"), F.lit(0.0).alias("dist")).unionByName(mended)
    usual = lexicon.where((F.col("rnk") <= RARE_RANK) | F.col("is_custom")).select(F.col("word").alias("cand"))
    told = told.join(usual, "cand").select(F.col("token").alias("half"), F.col("cand").alias("word"), "dist")
    sides = [told.select(F.col("half").alias(s), F.col("word").alias(f"word_{s}"), F.col("dist").alias(f"dist_{s}")) for s in "ab"]
    both = cuts.join(sides[0], "a").join(sides[1], "b").withColumn("dist", F.col("dist_a") + F.col("dist_b")).where(F.col("dist") <= SPLIT_DISTANCE)
    best = both.groupBy("token").agg(F.min(F.struct(F.round("dist", 6).alias("dist"), "at", F.concat_ws(" ", "word_a", "word_b").alias("cand"))).alias("m"))
    return best.select("token", "m.cand", "m.dist")


def correct_words(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, cand, dist): one word's correction, or two words where those are strictly closer.

    Custom words and tokens of one letter are left alone; a token without a correction has no row.
    """
    own = lexicon.where("is_custom").select(F.col("word").alias("token"))
    asked = tokens.select("token").distinct().where(F.length("token") >= 2).join(own, "token", "left_anti")
    ways = best_words(asked, lexicon).withColumn("way", F.lit(0)).unionByName(split_words(asked, lexicon).withColumn("way", F.lit(1)))
    best = ways.groupBy("token").agg(F.min(F.struct(F.round("dist", 6).alias("dist"), "way", "cand")).alias("m"))
    return best.select("token", "m.cand", "m.dist")


def _cased(text: str, nouns: frozenset[str]) -> str:
    """A text in capitals with the casing of sentences and nouns; only A-Z are letters."""
    parts = _WORD.split(text)  # words at odd places
    for i in range(1, len(parts), 2):
        word = parts[i]
        if len(word) > 1:
            starts = i == 1 or (parts[i - 1] != " " and _STOP.search(parts[i - 1]))
            parts[i] = T.PLACES.get(word) or (word[0] + word[1:].lower() if starts or word in nouns else word.lower())
    return "".join(parts)


_WORD, _STOP = re.compile("([A-Z]+)"), re.compile(r"[.!?\n]")


def recased(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """texts with out: text in capitals with the casing of sentences and nouns, within each row.

    Each text is read once where it lies, beside the lexicon's nouns, which every task gets; a lexicon's common words are CAP at most. The helper column
    is named _capitals; an empty text stays empty, a null one null.
    """
    spark = texts.sparkSession
    nouns = spark.sparkContext.broadcast(frozenset(r["word"] for r in lexicon.where("is_noun").select("word").toLocalIterator()))

    @F.udf("string", useArrow=True)
    def cased(text: str | None) -> str | None:
        return None if text is None else _cased(text, nouns.value)

    return texts.withColumn("_capitals", F.upper("text")).withColumn("out", cased("_capitals")).drop("_capitals")


#: Fixed values of joining fragments: tokens, lengths, distance, ranks, price of a token that can't be read, gain of a join.
JOIN_TOKENS, JOIN_PART, FRAGMENT, UNKNOWN_FRAGMENT, JOINED = 5, 8, 2, 4, (5, 14)
JOIN_DISTANCE, PLAIN_RANK, SHORT_RANK, SHORT_JOIN, RAREST = 1.2, 5000, 3000, 7, 35000
UNREADABLE, JOIN_GAIN, LEAST_GAIN = 40.0, 0.3, 0.15
CHANGES = 20


def _joinable(parts: Column) -> Column:
    """Whether tokens may be tried as one word: by their lengths, one that looks torn, and not all of them words by themselves."""
    joined = F.array_join(F.transform(parts, lambda p: p["token"]), "")
    short = F.forall(parts, lambda p: F.length(p["token"]) <= JOIN_PART)
    return short & F.length(joined).between(*JOINED) & F.exists(parts, lambda p: p["torn"]) & ~F.forall(parts, lambda p: p["whole"])


def _facts(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, known, text, dist, rnk, own): of tokens that are words or can be corrected the text to read, its weighted
    distance, and rank and custom flag of its first word."""
    words = lexicon.select(F.col("word").alias("token"))
    fixed = correct_words(tokens.join(words, "token", "left_anti"), lexicon).select("token", F.col("cand").alias("text"))
    fixed = fixed.withColumn("head", F.element_at(F.split("text", " "), 1)).withColumn("tight", F.replace("text", F.lit(" "), F.lit("")))
    fixed = fixed.withColumn("dist", T.weighted_distance("token", "tight"))
    told = fixed.unionByName(tokens.join(words, "token", "left_semi").select("token", F.col("token").alias("text"), F.col("token").alias("head"), F.col("token").alias("tight"), F.lit(0.0).alias("dist")))
    heads = lexicon.select(F.col("word").alias("head"), "rnk", F.col("is_custom").alias("own"))
    return told.join(heads, "head", "left").select("token", (F.col("token") == F.col("text")).alias("known"), "text", "dist", F.coalesce("rnk", F.lit(UNKNOWN_RANK)).alias("rnk"), F.coalesce("own", F.lit(False)).alias("own"))


def _joins(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Runs of tokens of a line that make one word: (key, line, at, joins), joins sorted by their number n of tokens."""
    line = words.groupBy("key", "line").agg(F.array_sort(F.collect_list(F.struct("at", "token", "torn", "whole"))).alias("toks"))
    runs = F.expr(f"flatten(transform(sequence(2, {JOIN_TOKENS}), n -> if(size(toks) >= n, transform(sequence(1, size(toks) - n + 1), i -> slice(toks, i, n)), array())))")
    runs = line.select("key", "line", F.explode(runs).alias("parts")).where(_joinable(F.col("parts")))
    tried = runs.select("key", "line", F.col("parts")[0]["at"].alias("at"), F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda p: p["token"]), "").alias("token"), F.exists("parts", lambda p: F.length(p["token"]) == 1).alias("letter"))
    tried = materialize(tried, "token-runs")
    found = tried.join(_facts(tried.select("token").distinct(), lexicon), "token")
    common = (F.col("rnk") <= RAREST) | F.col("own")
    tiny = F.col("letter") & (F.length("token") < SHORT_JOIN) & (F.col("rnk") > SHORT_RANK)
    fit = found.where(F.col("known") | ((F.col("dist") <= JOIN_DISTANCE) & common & ~tiny))
    option = F.struct("n", "text", (F.col("dist") - JOIN_GAIN * (F.col("n") - 1)).alias("score"))
    return fit.groupBy("key", "line", "at").agg(F.array_sort(F.collect_list(option)).alias("joins"))


def repair_lines(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lines (key, line, tokens) -> key, line, words: corrected words, fragments of up to five tokens joined.

    Every token and every run of tokens that may be one word is corrected once, by joins; a fold over a line's tokens
    then takes, from left to right, the reading that is best at each place. key and line tell lines apart; a line
    without tokens has no words, one whose key or line is null keeps its tokens. A custom word may be rare.
    """
    words = materialize(lines.select("key", "line", F.posexplode("tokens").alias("at", "token")), "line-tokens")
    facts = _facts(words.select("token").distinct(), lexicon)
    size, known = F.length("token"), F.coalesce("known", F.lit(False))
    plain = F.coalesce(~F.col("text").contains(" ") & (F.col("rnk") < PLAIN_RANK), F.lit(False))
    words = words.join(facts, "token", "left").select(
        "key",
        "line",
        "at",
        "token",
        F.coalesce("text", "token").alias("text"),
        F.coalesce("dist", F.lit(UNREADABLE)).alias("score"),
        ((size <= FRAGMENT) | ((size <= UNKNOWN_FRAGMENT) & ~known)).alias("torn"),
        ((size > 1) & (known | plain)).alias("whole"),
    )
    words = materialize(words, "told-tokens")
    joins = _joins(words, lexicon)
    none = F.array().cast("array<struct<n: int, text: string, score: double>>")
    words = words.join(joins, ["key", "line", "at"], "left").withColumn("joins", F.coalesce("joins", none))
    toks = words.groupBy("key", "line").agg(F.array_sort(F.collect_list(F.struct("at", "text", "score", "joins"))).alias("toks"))
    best = f"aggregate(t.joins, named_struct('n', 1, 'text', t.text, 'score', t.score), (b, o) -> if(o.score < b.score - {LEAST_GAIN}D, o, b))"
    read = f"""aggregate(toks, named_struct('next', 0, 'words', cast(array() as array<string>)),
      (s, t) -> if(t.at < s.next, s, aggregate(array({best}), s, (_, b) -> named_struct('next', t.at + b.n, 'words', concat(s.words, split(b.text, ' '))))), s -> s.words)"""
    read = toks.select("key", "line", F.expr(read).alias("words"))
    return lines.select("key", "line", "tokens").join(read, ["key", "line"], "left").select(F.col("key").cast("string").alias("key"), "line", F.coalesce("words", "tokens").alias("words"))


def cased_lines(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Repaired lines (key, line, words) -> key, line, text: nouns and first words with a capital, all else lower."""
    nouns = lexicon.where("is_noun").select(F.col("word"), F.lit(True).alias("noun"))
    words = lines.select("key", "line", F.posexplode("words").alias("at", "word")).join(nouns, "word", "left")
    told = words.withColumn("out", T.format_word(F.col("word"), F.coalesce("noun", F.lit(False)), F.col("at") == 0))
    return told.groupBy("key", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), " ").alias("text"))


def changed_lines(before: DataFrame, after: DataFrame, limit: int = CHANGES) -> DataFrame:
    """(key, changes): the first lines of each text that changed, as before>after."""
    both = before.select("key", "line", F.array_join("tokens", " ").alias("a")).join(after.select("key", "line", F.array_join("words", " ").alias("b")), ["key", "line"]).where("a <> b")
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("line"))).where(F.col("_r") <= limit)
    return first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.concat("a", F.lit(">"), "b").alias("c")))), lambda x: x["c"]).alias("changes"))
