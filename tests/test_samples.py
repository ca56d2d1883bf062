"""Dictionary acceptance and filled lines against plain Python; the watchdog as a stream that is stopped and started again."""

import hashlib
import json
import re
import time

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import lexicon as X
from palimpsest.streaming import progress

AFFIXES = """# an affix file
SET UTF-8
SFX A Y 2
SFX A 0 s [^s]
SFX A y ies [^aeiou]y
SFX N N 1
SFX N 0 n/A .
PFX U Y 1
PFX U 0 un .
PFX V N 1
PFX V a be a
"""
STEMS = [("Haus", "A"), ("city", "AU"), ("toy", "A"), ("glass", "A"), ("Tür", "N"), ("alt", "UV"), ("plain", None), ("über", ""), ("IT", "")]


def slow_forms():
    rules, crossed = [], {}
    for line in AFFIXES.splitlines():
        p = line.split()
        if p and p[0] in ("SFX", "PFX"):
            if len(p) == 4:
                crossed[p[0], p[1]] = p[2] == "Y"
            else:
                rules.append((p[0], p[1], "" if p[2] == "0" else p[2], "" if p[3] == "0" else p[3].split("/")[0], p[4]))
    out = set()

    def apply(kind, word, flags):
        for k, flag, strip, add, cond in rules:
            if k != kind or flag not in (flags or ""):
                continue
            if kind == "SFX" and re.search(f"(?:{cond})$", word) and word.endswith(strip):
                yield word[: len(word) - len(strip)] + add, crossed[k, flag]
            if kind == "PFX" and re.match(f"(?:{cond})", word) and word.startswith(strip):
                yield add + word[len(strip) :], crossed[k, flag]

    for stem, flags in STEMS:
        out.add(stem)
        for w, c in apply("SFX", stem, flags):
            out.add(w)
            out |= {v for v, also in apply("PFX", w, flags) if c and also}
        out |= {w for w, _ in apply("PFX", stem, flags)}
    return out


def test_forms_and_acceptance(spark):
    rules = X.affix_rules(spark.createDataFrame([(line,) for line in AFFIXES.splitlines()], "value string"))
    stems = spark.createDataFrame(STEMS, "stem string, flags string")
    forms = X.affixed_forms(stems, rules)
    assert {r.form for r in forms.collect()} == slow_forms() >= {"cities", "uncities", "uncity", "toys", "Türn", "unalt", "belt", "glass"}
    tried = ["cities", "Cities", "CITIES", "haus", "HAUS", "Hauss", "plain", "Plain", "it", "IT", "tür", "glasss", "belt", "Über", "zzz", ""]
    words = spark.createDataFrame([(w, 100 - i) for i, w in enumerate(tried)], "raw string, n long")
    known = slow_forms()
    want = {w for w in tried if {w, w.lower(), w[:1].upper() + w[1:].lower()} & known}
    assert {r.raw for r in X.accepted(words, forms).collect()} == want
    custom = spark.createDataFrame([("Xylo",), ("city",), ("rune",), ("Rune",), ("x",)], "word string")
    lex = {r.word: r for r in X.accepted_lexicon(words, stems, rules, custom, 5).collect()}
    # the five most frequent accepted words by folded spelling, then places, then the user's own
    assert [w for w, r in sorted(lex.items(), key=lambda x: x[1].rnk)] == ["CITIES", "HAUS", "PLAIN", "IT", "TUER", *sorted(T.PLACES), "CITY", "RUNE", "XYLO"]
    assert {w for w, r in lex.items() if r.is_noun} == {"HAUS", "IT", "TUER", *T.PLACES, "RUNE", "XYLO"} and {w for w, r in lex.items() if r.is_custom} == {"CITY", "RUNE", "XYLO"}
    assert sorted(r.rnk for r in lex.values()) == list(range(len(lex)))


def slow_line(key, words, seed):
    number = lambda s: int(hashlib.md5(f"{seed}/{key}/{s}".encode()).hexdigest()[:8], 16)
    most, chosen, slot = 18 + number("length") % 25, [], 0
    while len(" ".join(chosen)) < most:
        word = words[number(slot) % len(words)]
        slot += 1
        if len(" ".join([*chosen, word])) > most:
            if chosen:
                break
            word = word[:most]
        chosen.append(word)
    return " ".join(chosen)


def test_filled_lines_from_any_partitioning(spark):
    vocabulary = ["a", "io", "word", "longer", "x" * 60, "seven", "b"]
    words = spark.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, at long")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    want = {f"k{i}": slow_line(f"k{i}", vocabulary, "s") for i in range(300)}
    for parts in (1, 7):
        assert {r.key: r.text for r in X.filled_lines(keys.repartition(parts), words, "s").collect()} == want
    assert max(map(len, want.values())) <= 42 and {len(t) for t in want.values() if t.startswith("xxx")} <= set(range(18, 43))
    assert X.filled_lines(keys, words.limit(0), "s").count() == 0


def test_watchdog_survives_a_restart(spark, tmp_path):
    """Two jobs speak, the query stops, one speaks again after the restart: the silent one fires once."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def say(number, *jobs):
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps({"job": j}) for j in jobs))

    def told():
        try:
            return [tuple(r) for r in spark.read.schema(progress.FIRED).json(out).select("job", "messages", "fired").collect()]
        except Exception as e:  # nothing is written yet
            assert "PATH_NOT_FOUND" in str(e)
            return []

    def until(done, seconds=90):
        end = time.time() + seconds
        while not done(told()):
            assert time.time() < end and query.exception() is None, told()
            time.sleep(0.5)

    start = lambda: progress.run_watchdog(spark.readStream.schema("job string").json(source), out, checkpoint, seconds=20, every="500 milliseconds")
    say(1, "quiet", "busy", "quiet")
    query = start()
    until(lambda rows: ("quiet", 2, False) in rows and ("busy", 1, False) in rows)
    query.stop()
    assert not any(fired for _, _, fired in told())
    time.sleep(12)
    say(2, "busy")
    query = start()
    until(lambda rows: ("quiet", 2, True) in rows)
    assert ("busy", 2, False) in told()
    time.sleep(3)
    query.stop()
    rows = told()
    assert rows.count(("quiet", 2, True)) == 1 and ("busy", 1, True) not in rows
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_a_sharp_s_is_no_two_letters_when_its_word_begins_with_a_capital(spark):
    words = spark.createDataFrame([("ßö", 9), ("ßa", 4), ("haus", 2), ("öl", 1)], "raw string, n long")
    forms = spark.createDataFrame([("SSö",), ("ẞa",), ("Haus",), ("Öl",)], "form string")
    assert sorted(r.raw for r in X.accepted(words, forms).collect()) == ["haus", "ßa", "öl"]
