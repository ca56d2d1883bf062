"""Edit scripts, line finding, reading, line repair, sources and sinks against brute force on small inputs."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import evaluate, glyphs as G, lexicon, lines, pages, pixels, reading
from palimpsest.operators.alphabet import EM, GLYPH_SCHEMA, glyphs
from palimpsest.plans import catalogue
from palimpsest.sources import readers, sinks
from palimpsest.streaming import progress
from tests.conftest import SF_SMALL

ROOT = Path(__file__).resolve().parent.parent


def slow_script(want, got):
    table = [[i + j if not i or not j else 0 for j in range(len(want) + 1)] for i in range(len(got) + 1)]
    for i in range(1, len(got) + 1):
        for j in range(1, len(want) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (got[i - 1] != want[j - 1]))
    out, i, j = [], len(got), len(want)
    while (i, j) != (0, 0):
        if i and j and table[i][j] == table[i - 1][j - 1] + (got[i - 1] != want[j - 1]):
            i, j = i - 1, j - 1
            out.append(("eq" if got[i] == want[j] else "sub", want[j], got[i]))
        elif i and table[i][j] == table[i - 1][j] + 1:
            i -= 1
            out.append(("ins", "", got[i]))
        else:
            j -= 1
            out.append(("del", want[j], ""))
    return out[::-1]


def test_edit_scripts_against_the_whole_table():
    r = random.Random(1)
    pairs = [("", ""), ("A", ""), ("", "AB"), ("KITTEN", "SITTING")] + [("".join(r.choice("AB C") for _ in range(r.randint(0, 60))), "".join(r.choice("AB C") for _ in range(r.randint(0, 60)))) for _ in range(150)]
    for want, got in pairs:
        assert evaluate.script(want, got) == slow_script(want, got)


def test_edit_scripts_are_dealt_out_and_need_no_whole_table(spark, monkeypatch):
    from palimpsest.operators.pixels import LEAST_TASKS

    r = random.Random(2)
    made = [("".join(r.choice("ABÄ 𝔸") for _ in range(r.randint(0, 70))), "".join(r.choice("ABÄ 𝔸") for _ in range(r.randint(0, 70)))) for _ in range(60)]
    for bits in (1, 300, 1 << 28):  # rows of tables are kept one at a time, a few, all
        monkeypatch.setattr(evaluate, "TABLE_BITS", bits)
        assert [evaluate.script(want, got) for want, got in made] == [slow_script(want, got) for want, got in made]
    pairs = spark.createDataFrame([(f"{i}", want, got) for i, (want, got) in enumerate(made)], "key string, want_text string, got_text string").coalesce(1)
    edits = evaluate.edit_scripts(pairs)
    assert edits.rdd.getNumPartitions() >= LEAST_TASKS
    found = {(x.key, x.no): (x.op, x.want, x.got) for x in edits.collect()}
    assert found == {(f"{i}", no): edit for i, (want, got) in enumerate(made) for no, edit in enumerate(slow_script(want, got), 1)}


def test_context_only_errors_work_the_scripts_out_once(spark):
    pairs = spark.createDataFrame([("a", "THE CAT SAT", "TIE CAT SXT"), ("b", "HA", "HX"), ("c", "HA", "HX"), ("d", "AT", "AT")], "key string, want_text string, got_text string")
    edits = evaluate.edit_scripts(pairs).cache()
    tallied = evaluate.tallied_edits(pairs)
    told = [{tuple(x) for x in evaluate.context_only_errors(e, e.where(right), least=2).collect()} for e, right in ((edits, "no = 1 and op = 'eq'"), (tallied, "lead and op = 'eq'"))]
    assert told[0] == told[1] == {("A", 5, 3), ("H", 3, 1)}
    plan = catalogue.queries()["context_only_errors"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_recasing_moves_no_text(spark):
    lex = spark.createDataFrame([("HAUS", True), ("GEHT", False), ("UND", False)], "word string, is_noun boolean")
    texts = ["das HAUS geht. und geht!\nein haus, und x y", "1. haus ÜBER straße", "SACHSENANHALT und sachsenanhalt", "", None, "...", "a und 7und"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    told = lexicon.recased(docs, lex)
    assert told.columns == ["doc_id", "text", "out"]
    found = {r.doc_id: r.out for r in told.collect()}
    first = "Das Haus geht. Und geht!\nEin Haus, und X Y"
    assert found == {0: first, 1: "1. Haus Über strasse", 2: "Sachsen-Anhalt und Sachsen-Anhalt", 3: "", 4: None, 5: "...", 6: "A und 7und"}
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_candidates_meet_in_many_tasks(spark):
    tokens = spark.createDataFrame([("HAUZ",), ("MAUSS",), ("GEHT",)], "token string").coalesce(1)
    words = ["HAUS", "MAUS", "GEHT", "GEHE", "LAUS"]
    lex = spark.createDataFrame([(w, i, len(w), False, False) for i, w in enumerate(words)], "word string, rnk int, len int, is_custom boolean, is_noun boolean").coalesce(1)
    for near in (lexicon.candidates, lexicon.close_candidates):
        told = near(tokens, lex)
        assert f", {pixels.LEAST_TASKS}" in told._jdf.queryExecution().executedPlan().toString()
        assert {("HAUZ", "HAUS"), ("MAUSS", "MAUS"), ("GEHT", "GEHE")} <= {(r.token, r.cand) for r in told.collect()}


def test_rates_and_confusions(spark):
    pairs = spark.createDataFrame([("a", "THE CAT SAT", "TIE CAT SXT"), ("b", "LOVE", "LOLE"), ("c", "QUIT IT", "TUIT T"), ("d", None, "X")], "key string, want_text string, got_text string")
    edits = evaluate.edit_scripts(pairs).cache()
    twins = spark.createDataFrame([("L", "LV"), ("V", "LV"), ("Q", "QT"), ("T", "QT")], "ch string, grp string")
    found = {(r.want, r.got): (r.n, r.net) for r in evaluate.confusions(edits, twins).collect()}
    assert found == {("H", "I"): (1, 1), ("A", "X"): (1, 1), ("V", "L"): (1, 0), ("Q", "T"): (1, 0), ("I", "∅"): (1, 1), ("∅", "X"): (1, 1)}
    assert [(r.want, r.got) for r in evaluate.top_confusions(evaluate.confusions(edits, twins)).collect()] == [("H", "I"), ("A", "X"), ("I", "∅"), ("∅", "X")]
    assert {(r["first"], r.n, r.err) for r in evaluate.word_start_rates(edits).collect()} == {(True, 6, 2), (False, 13, 3)}
    assert {(r.want, r.n, r.err) for r in evaluate.letter_error_rates(edits, least=2).collect()} == {("I", 2, 1), ("A", 2, 1)}
    right = spark.createDataFrame([("A",), ("H",)], "want string")
    assert {(r.want, r.err) for r in evaluate.context_only_errors(edits, right, least=1).collect()} == {("A", 1), ("H", 1)}
    alone = spark.createDataFrame([("f", "L", "V"), ("f", "A", "A"), ("f", "B", ""), ("g", "L", "V")], "font string, want string, got string")
    own = spark.createDataFrame([("f", "L", "LV")], "font string, ch string, grp string")
    assert {tuple(r) for r in evaluate.isolated_accuracy(alone, own).collect()} == {("f", 3, 2, "B>∅ x1"), ("g", 1, 0, "L>V x1")}


def slow_lines(p, w):
    """Bands of a profile, step by step."""
    h, scale = len(p), max(1.0, max(w, len(p)) / 1100)
    px = lambda n: max(1, int(np.floor(n * scale + 0.5)))
    peak = max(p)
    if not peak:
        return "empty", []
    least = px(10) if scale > 1.02 else 8
    on = [v >= max(1, peak * 0.02) for v in p] + [False]
    bands, start = [], None
    for y, v in enumerate(on):
        if v and start is None:
            start = y
        if not v and start is not None:
            bands += [(start, y)] if y - start >= least else []
            start = None
    d = [0] + [p[y] - p[y - 1] for y in range(1, h)]
    lo, hi = px(12) if scale > 1.02 else px(9), min(px(80), h // 3)
    pitch = 0
    if h >= 30 and hi > lo + 1:
        s = {lag: sum(d[y] * d[y + lag] for y in range(1, h - lag)) / max(h - lag - 1, 1) for lag in range(lo, hi + 1)}
        tops = [lag for lag in range(lo + 1, hi) if s[lag] >= s[lag - 1] and s[lag] >= s[lag + 1] and s[lag] > 0]
        if tops:
            pitch = next(lag for lag in tops if s[lag] >= 0.5 * max(s[t] for t in tops))

    def sliced(found):
        out = []
        for a, b in found:
            n = 1 if b - a <= pitch * 1.55 else max(2, int(np.floor((b - a + 0.15 * pitch) / pitch + 0.5)))
            out += [(int(np.floor(a + i * (b - a) / n)), int(np.ceil(a + (i + 1) * (b - a) / n))) for i in range(n)] if n > 1 else [(a, b)]
        return out

    tallest = max((b - a for a, b in bands), default=0)
    if bands and tallest <= h * 0.18:
        cut = 3 <= len(bands) <= 12 and pitch >= px(7) and tallest > pitch * 1.55
        return ("slices", sliced(bands)) if cut else ("bands", bands)
    r, span = px(3), px(40)
    sm = [np.mean(p[max(0, y - r) : y + r + 1]) for y in range(h)]
    splits = [-1]
    for y in range(r, h - r):
        if sm[y] <= sm[y - 1] and sm[y] <= sm[y + 1]:
            side = min(max(sm[max(0, y - span) : y], default=0), max(sm[y + 1 : y + span + 1], default=0))
            if side >= peak * 0.18 and sm[y] / side <= 0.8 and sm[y] / peak < 0.55:
                splits.append(y)
    kept = []
    for s_ in [*splits, h]:
        if not kept or s_ - kept[-1] > px(2):
            kept.append(s_)
    found = [(a + 1, b) for a, b in zip(kept, kept[1:]) if b - a - 1 >= least and sum(p[a + 1 : b]) >= peak * 0.5]
    if len(found) > 1:
        target = sorted(b - a for a, b in found)[len(found) // 2]
        merged = [found[0]]
        for a, b in found[1:]:
            if a - merged[-1][1] <= px(3) and b - merged[-1][0] <= target * 1.65:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        found = merged
    if len(found) >= 3:
        middle = sorted(b - a for a, b in found)[len(found) // 2]
        found = [(a, b) for a, b in found if b - a <= middle * 2.4]
    return "valleys", sliced(found) if 3 <= len(found) <= 12 and pitch >= px(7) else found


def test_lines_against_brute_force(spark):
    r = random.Random(2)
    profiles = [[0.0] * 120, [5.0] * 90, []]
    for pitch, ink, gap, h in ((30, 18, 0.0, 400), (30, 18, 0.3, 420), (26, 20, 0.35, 300), (60, 30, 0.0, 1500), (14, 9, 0.0, 200), (40, 25, 0.5, 500), (20, 12, 0.01, 60)):
        profiles.append([float(int((r.uniform(80, 120) if y % pitch < ink else gap * r.uniform(80, 120)))) for y in range(h)])
    rows = [(str(i), 300, len(p), p) for i, p in enumerate(profiles) if p]
    got = {x.key: (x.way, [tuple(b) for b in x.found]) for x in lines.line_bands(spark.createDataFrame(rows, "key string, w int, h int, p array<double>")).collect()}
    assert got == {k: slow_lines(p, w) for k, w, _, p in rows}
    assert {w for w, _ in got.values()} >= {"empty", "bands", "valleys"}


def test_a_page_is_read_back(spark):
    atlas = {"one": [g | {"font": "one"} for g in glyphs(1)]}
    text = spark.createDataFrame([("p", "QUICK BROWN FOX JUMPS"), ("q", "OVER LAZY DOGS")], "key string, text string")
    wrapped = pages.wrapped(text, 11)
    assert [r.text for r in wrapped.orderBy("key", "line").collect()] == ["QUICK BROWN", "FOX JUMPS", "OVER LAZY", "DOGS"]
    ink, sizes = pages.drawn(wrapped, atlas["one"], 24)
    ink, sizes = ink.cache(), sizes.cache()
    bands = lines.line_bands(lines.page_profiles(ink, sizes))
    bounds = lines.bounded_lines(bands, ink)
    assert bounds.groupBy("key").count().orderBy("key").collect()[0]["count"] == 2
    cropped = lines.cropped_lines(bounds, ink, sizes)
    first = cropped.where("key = 'p' and line = 0").first()
    assert len(set(first.pixels)) == len(first.pixels) and max(first.pixels) < first.w * first.h and first.ink_top == lines.PAD
    rows = spark.createDataFrame([tuple(g.values()) for g in atlas["one"]], GLYPH_SCHEMA)
    fonts = G.extents(rows, EM).join(G.mean_advances(rows), "font")
    read = reading.page_readings(reading.read_lines(cropped.withColumn("font", F.lit("one")), fonts, atlas, EM))
    assert {r.key: r.text for r in read.collect()} == {"p": "QUICK BROWN\nFOX JUMPS", "q": "OVER LAZY\nDOGS"}
    assert reading.read_line(np.zeros((30, 40), np.uint8), reading.scaled(tuple(tuple(g.values())[1:] for g in atlas["one"]), EM, 20.0), 20.0, 20.0) == ("", 0.0, 0)


def test_overlaps_against_pixel_loops():
    shapes = reading.scaled(tuple(tuple(g.values())[1:] for g in glyphs(2)), EM, 17.0)
    ink = (np.random.default_rng(5).random((25, 40)) < 0.3).astype(float)
    for baseline in (20, 4, -3):
        got = reading.overlaps(ink, shapes, baseline, 1)
        for k in (0, 9, 25):
            x, y, w, h = (int(v[k]) for v in (shapes.dx, shapes.dy, shapes.w, shapes.h))
            mask = shapes.canvas[k][y - shapes.top :, x - shapes.left :][:h, :w]
            for p in range(0, 41, 3):
                best = 0.0
                for top in (baseline + y - 1, baseline + y, baseline + y + 1):
                    seen = [(r, c) for r in range(max(0, top), min(25, top + h)) for c in range(max(0, min(p, p + x)), min(40, max(p + x + w, p + int(shapes.base[k])))) if ink[r, c]]
                    both = sum(mask[r - top, c - p - x] for r, c in seen if 0 <= c - p - x < w)
                    best = max(best, 2 * both / (mask.sum() + len(seen)) if seen else 0.0)
                assert got[k, p] == pytest.approx(best)


LEXICON = [("HAUS", 0, False), ("BAUM", 1, False), ("GARTEN", 2, False), ("DER", 3, False), ("EXEMPLAR", 4000, False), ("LESEN", 5000, False), ("RUNE", 99999, True), ("BAT", 6000, False), ("HAT", 20, False)]


def lexicon_table(spark):
    return spark.createDataFrame([(w, r, len(w), c, w in ("HAUS", "GARTEN")) for w, r, c in LEXICON], "word string, rnk int, len int, is_custom boolean, is_noun boolean")


def test_lines_are_repaired(spark):
    texts = ["DER E XEMPLA R", "HAUSBAVM GARTEM", "QQQQQQ DER", "BAT RUNE", "GAR TEN HAUS", "L E S EN", ""]
    before = spark.createDataFrame([("t", i, t.split()) for i, t in enumerate(texts)], "key string, line int, tokens array<string>")
    after = lexicon.repair_lines(before, lexicon_table(spark)).cache()
    got = {r.line: " ".join(r.words) for r in after.collect()}
    assert got == {0: "DER EXEMPLAR", 1: "HAUS BAUM GARTEN", 2: "QQQQQQ DER", 3: "BAT RUNE", 4: "GARTEN HAUS", 5: "LESEN", 6: ""}
    cased = {r.line: r.text for r in lexicon.cased_lines(after, lexicon_table(spark)).collect()}
    assert cased[1] == "Haus baum Garten" and cased[0] == "Der exemplar" and cased[2] == "Qqqqqq der"
    changes = lexicon.changed_lines(before, after).first().changes
    assert changes == ["DER E XEMPLA R>DER EXEMPLAR", "HAUSBAVM GARTEM>HAUS BAUM GARTEN", "GAR TEN HAUS>GARTEN HAUS", "L E S EN>LESEN"]


def test_runs_mend_into_custom_words(spark):
    """Words of a user's own list have no rank; a join may still read as one, or begin with one."""
    words = [("HAUS", 0, False), ("BAUM", 1, False), ("GARTENHAUS", 99999, True), ("RUNEN", 99999, True), ("SELTENHEIT", 40000, False)]
    lex = spark.createDataFrame([(w, r, len(w), c, False) for w, r, c in words], "word string, rnk int, len int, is_custom boolean, is_noun boolean")
    texts = ["GA RTENHAVS", "GA RTENHAUS BAUM", "RVNE N", "SEL TENHEIB", "R UNEN", ""]
    before = spark.createDataFrame([("t", i, t.split()) for i, t in enumerate(texts)] + [(None, 9, ["GA", "RTENHAVS"])], "key string, line int, tokens array<string>")
    got = {(r.key, r.line): " ".join(r.words) for r in lexicon.repair_lines(before, lex).collect()}
    assert got == {("t", 0): "GARTENHAUS", ("t", 1): "GARTENHAUS BAUM", ("t", 2): "RVNE N", ("t", 3): "SEL TENHEIB", ("t", 4): "RUNEN", ("t", 5): "", (None, 9): "GA RTENHAVS"}


def test_repair_against_every_reading(spark):
    """Random torn lines: at each place, of all readings from there, the one that the rules prefer, worked out token by token."""
    r = random.Random(9)
    words = ["HAUS", "BAUM", "GARTEN", "DER", "EXEMPLAR", "LESEN", "BAT", "HAT", "RUNE", "NACHT", "WALD", "ES", "IN"]
    lex = spark.createDataFrame([(w, 99999 if w in ("RUNE", "WALD") else 700 * i, len(w), w in ("RUNE", "WALD"), False) for i, w in enumerate(words)], "word string, rnk int, len int, is_custom boolean, is_noun boolean")

    def torn(word):
        cut = r.randint(1, max(1, len(word) - 1))
        word = word if r.random() < 0.6 else word[:2] + r.choice("EVTXB") + word[3:]
        return [word[:cut], word[cut:]] if r.random() < 0.6 and word[cut:] else [word]

    lines = [[t for _ in range(r.randint(1, 5)) for t in torn(r.choice(words))] for _ in range(60)]
    before = spark.createDataFrame([("t", i, t) for i, t in enumerate(lines)], "key string, line int, tokens array<string>")
    runs = {"".join(t[i : i + n]) for t in lines for n in range(1, 6) for i in range(len(t) - n + 1)}
    fixed = lexicon.correct_words(spark.createDataFrame([(x,) for x in runs if x not in words], "token string"), lex)
    fixed = fixed.withColumn("tight", F.replace("cand", F.lit(" "), F.lit(""))).withColumn("d", T.weighted_distance("token", "tight"))
    mended = {x.token: (x.cand, x.d) for x in fixed.collect()}
    rank = {x.word: (x.rnk, x.is_custom) for x in lex.collect()}

    def reading(parts):
        """(text, distance) of tokens as one word, or None."""
        whole = "".join(parts)
        if len(parts) == 1:
            return (whole, 0.0) if whole in rank else mended.get(whole, (whole, 40.0))
        sound = [len(p) > 1 and (p in rank or (p in mended and " " not in mended[p][0] and rank[mended[p][0]][0] < 5000)) for p in parts]
        looks_torn = [len(p) <= 2 or (len(p) <= 4 and p not in rank) for p in parts]
        if max(map(len, parts)) > 8 or all(sound) or not any(looks_torn) or not 5 <= len(whole) <= 14:
            return None
        if whole in rank:
            return whole, 0.0
        text, far = mended.get(whole, ("", 99.0))
        if far > 1.2:
            return None
        place, own = rank[text.split()[0]]
        return None if (place > 35000 and not own) or (min(map(len, parts)) == 1 and len(whole) < 7 and place > 3000) else (text, far)

    want = []
    for t in lines:
        at, out = 0, []
        while at < len(t):
            ways = [(n, *w) for n in range(1, 6) if at + n <= len(t) and (w := reading(t[at : at + n]))]
            best = ways[0]
            for n, text, far in ways[1:]:  # a longer run must be better than what is held by more than a bit
                if far - 0.3 * (n - 1) < best[2] - 0.3 * (best[0] - 1) - 0.15:
                    best = (n, text, far)
            out += best[1].split()
            at += best[0]
        want.append(out)
    got = {x.line: x.words for x in lexicon.repair_lines(before, lex).collect()}
    assert [got[i] for i in range(len(lines))] == want and sum(len(w) < len(t) for w, t in zip(want, lines, strict=True)) > 20


def test_candidates_lose_none(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("EUBHTQLVWA") for _ in range(r.randint(2, 14))) for _ in range(250)})
    lex = spark.createDataFrame([(w, i, len(w), False, False) for i, w in enumerate(words)], "word string, rnk int, len int, is_custom boolean, is_noun boolean")
    tokens = spark.createDataFrame([(w[:-1] + "X" if i % 2 else w,) for i, w in enumerate(words[::3])], "token string")
    every = tokens.distinct().crossJoin(lex.select(F.col("word").alias("cand"))).where("cand <> token and length(token) >= 2")
    slack = F.when(F.length("token") >= 6, 2).otherwise(1)
    near = every.where((F.abs(F.length("token") - F.length("cand")) <= slack) & (F.levenshtein("token", "cand") * T.CONFUSABLE_COST <= T.distance_limit(F.length("token"))))
    want = near.where(T.weighted_distance("token", "cand") <= T.distance_limit(F.length("token"))).select("token", "cand").collect()
    got = lexicon.candidates(tokens, lex).where(T.weighted_distance("token", "cand") <= T.distance_limit(F.length("token"))).select("token", "cand").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_skew(spark):
    r = np.random.default_rng(4)
    shape = np.zeros((60, 90), int)
    for base in (12, 28, 44):
        for x in range(90):
            shape[base + int(np.floor((x - 45) * np.tan(np.deg2rad(-3.25)) + 0.5)), x] = 1
    shape[r.random(shape.shape) < 0.02] = 1
    ink = spark.createDataFrame([(0, 90, 60, int(y), int(x), 1) for y, x in zip(*np.nonzero(shape))], "img int, w int, h int, y int, x int, ink int")
    assert pixels.estimated_skew(ink).first().deg == pytest.approx(3.25, abs=0.3)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "words.json").write_text('["und", "der"]')
    assert [(r.word, r.ord) for r in readers.frequency_words(spark, str(tmp_path / "words.json")).collect()] == [("und", 0), ("der", 1)]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "A1.txt").write_text("ein\n  Wort ")
    assert readers.truths(spark, str(tmp_path / "truth")).collect()[0][:] == ("A1", "EIN WORT")
    (tmp_path / "img").mkdir()
    tag = b"\xff\xd8\xff\xe1xxExif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0"
    (tmp_path / "img" / "a.jpg").write_bytes(tag)
    (tmp_path / "img" / "b.jpg").write_bytes(b"\xff\xd8\xff\xe1\0\x22Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x08\0\0\0")
    (tmp_path / "img" / "c.jpg").write_bytes(b"abc")
    (tmp_path / "img" / "d.jpg").write_bytes(b"\xff\xd8 no tag")
    usable, rejected = readers.image_files(spark, str(tmp_path / "img"))
    assert [r.orientation for r in usable.orderBy("path").collect()] == [6, 8, 1] and [r.length for r in rejected.collect()] == [3]
    (tmp_path / "My-Font One.ttf").write_bytes(b"x")
    assert readers.font_files(spark, str(tmp_path), "My-").first().key == "Font One"
    (tmp_path / "log.txt").write_text("start\nCER: 0.25\n  lines = 12 \n")
    assert {tuple(r) for r in readers.run_figures(spark, str(tmp_path / "log.txt")).collect()} == {("CER", 0.25), ("lines", 12.0)}
    page = spark.createDataFrame([("x.raw", 2, 1, bytearray(b"\x01\x02"))], "file string, w int, h int, gray binary")
    sinks.write_pages(page, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/index")).count() == 1
    assert bytes(page.select(sinks.gray_image(F.col("w"), F.col("h"), F.col("gray")).alias("p")).first().p) == b"P5\n2 1\n255\n\x01\x02"
    sinks.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "i int, line string"), str(tmp_path / "report"), ["i"])
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]
    told = sinks.messages(spark.createDataFrame([("j", None, None, 1, 3), ("j", "done", None, 3, 3), ("k", None, "bad", 0, 3)], "job string, text string, error string, i int, total int"))
    assert {tuple(r) for r in told.collect()} == {("j", "progress", "1/3"), ("j", "result", "done"), ("k", "error", "bad")}


def test_watchdog_and_phases(spark):
    class State:
        exists, hasTimedOut, value = False, False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):  # noqa: N802  the name is Spark's
            self.ms = ms

    state = State()
    assert next(progress.watch(("j",), iter([[1, 2], [3]]), state)).values.tolist() == [["j", 3, False]] and state.ms == 120_000
    assert next(progress.watch(("j",), iter([[4]]), state)).values.tolist() == [["j", 4, False]]
    state.hasTimedOut = True
    assert next(progress.watch(("j",), iter([]), state)).values.tolist() == [["j", 4, True]] and not state.exists
    stream = spark.readStream.format("rate").load().select(F.lit("j").alias("job"))
    assert progress.watchdog(stream).isStreaming
    rows = progress.phases(spark.createDataFrame([("a", 0), ("a", 3)], "job string, line int")).orderBy("seq").collect()
    assert [(r.phase, r.i, r.total) for r in rows] == [("prepare", 0, 2), ("lines", 0, 2), ("line", 1, 2), ("line", 2, 2)]


def test_everything_else_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    told = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy, capture_output=True, text=True)
    assert told.returncode == 0, told.stdout[-2000:]
