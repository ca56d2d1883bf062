"""Column functions on transcribed text: folding, error rates, weighted edit distance, casing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Ordered letter pairs that are easily mistaken, and the cost of taking one for the other.
CONFUSABLE = ("EU", "UE", "BH", "HB", "TQ", "QT", "LV", "VL", "WV", "VW", "BW", "WB")
CONFUSABLE_COST = 0.35


def _folded(s: Column) -> Column:
    s = F.upper(s)
    for a, b in (("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE"), ("ß", "SS"), ("ẞ", "SS")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def norm(s: Column) -> Column:
    """White space collapsed, trimmed, upper case."""
    return F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))


def translit(s: Column) -> Column:
    """Upper case A-Z only: umlauts spelled out, everything else deleted."""
    return F.regexp_replace(_folded(s), "[^A-Z]", "")


def translit_spaced(s: Column) -> Column:
    """As translit, but other characters become spaces; runs collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_folded(s), r"[^A-Z\s]", " "), r"\s+", " "))


def translit_kept(s: Column) -> Column:
    """As translit, but spaces stay."""
    return F.regexp_replace(_folded(s), "[^A-Z ]+", "")


def canonical(s: Column, twins: str, canon: str) -> Column:
    """Letters that look the same in an alphabet mapped to one of them."""
    return F.translate(s, twins, canon)


def cer(want: Column, got: Column) -> Column:
    """Character error rate: edit distance over the truth's length; 1 for an empty truth. May exceed 1."""
    return F.when(F.length(want) == 0, F.lit(1.0)).otherwise(F.levenshtein(want, got) / F.length(want))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def position_matches(a: Column, b: Column) -> Column:
    """Equal characters at equal positions."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, v: n + v)


def is_confusion_swap(a: Column, b: Column) -> Column:
    """Same length, exactly one position differs, and that pair is confusable."""
    pairs = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, F.concat(x, y))), lambda p: p.isNotNull())
    return (F.length(a) == F.length(b)) & (F.size(pairs) == 1) & F.coalesce(F.element_at(F.concat(pairs, F.array(F.lit(""))), 1).isin(*CONFUSABLE), F.lit(False))


def distance_limit(length: Column) -> Column:
    """Greatest edit distance allowed for a word length."""
    return F.when(length <= 4, 1).when(length <= 7, 2).when(length <= 11, 3).otherwise(4)


def weighted_distance(a: str, b: str) -> Column:
    """Levenshtein distance of columns named a and b where confusable substitutions cost less: an aggregate
    over the letters of a, each step an aggregate over the letters of b that builds the next row."""
    listed = ", ".join(f"'{p}'" for p in CONFUSABLE)
    return F.expr(
        f"""element_at(aggregate(split({a}, ''), transform(sequence(0, length({b})), j -> cast(j as double)),
          (prev, x) -> aggregate(sequence(1, length({b})), array(prev[0] + 1D),
            (cur, j) -> concat(cur, array(least(prev[j] + 1D, cur[j - 1] + 1D,
              prev[j - 1] + case when x = substr({b}, j, 1) then 0D when concat(x, substr({b}, j, 1)) in ({listed}) then {CONFUSABLE_COST}D else 1D end))))), -1)"""
    )


def format_word(word: Column, noun: Column, sentence_start: Column) -> Column:
    """Casing of an upper-case word: one letter unchanged, nouns capitalised, else lower; sentences start upper."""
    places = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    capital = F.concat(F.substring(word, 1, 1), F.lower(F.substring(word, 2, 1 << 30)))
    out = F.when(word.isin(*PLACES), F.try_element_at(places, word)).when(noun, capital).otherwise(F.lower(word))
    started = F.when(sentence_start, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))).otherwise(out)
    return F.when(F.length(word) <= 1, word).otherwise(started)


def marked(s: Column, marks: dict[str, str]) -> Column:
    """Each letter that has a mark replaced by it."""
    table = F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


#: Names of several words that are written as one in capitals.
PLACES = {
    "BADENWUERTTEMBERG": "Baden-Wuerttemberg",
    "MECKLENBURGVORPOMMERN": "Mecklenburg-Vorpommern",
    "NORDRHEINWESTFALEN": "Nordrhein-Westfalen",
    "RHEINLANDPFALZ": "Rheinland-Pfalz",
    "SACHSENANHALT": "Sachsen-Anhalt",
    "SCHLESWIGHOLSTEIN": "Schleswig-Holstein",
}
