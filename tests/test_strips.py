"""The second reader: correlation maps, the recurrence, lines by growth and the two passes against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import lines, pages, strips as S
from palimpsest.operators.alphabet import EM, glyphs


def test_maps_against_direct_overlaps():
    r = np.random.default_rng(1)
    strip = (r.random((14, 40)) < 0.4).astype(float)
    shapes = tuple(r.random(s) for s in ((5, 6), (14, 40), (1, 1), (15, 3)))
    for mask, got in zip(shapes, S.dice_maps(strip, shapes), strict=True):
        th, tw = mask.shape
        if th > 14:
            assert got.tolist() == [[0.0]]
            continue
        for y in range(14 - th + 1):
            for x in range(40 - tw + 1):
                part = strip[y : y + th, x : x + tw]
                assert got[y, x] == pytest.approx(2 * (part * mask).sum() / (part.sum() + mask.sum()), abs=1e-8)


def every_row(width, pieces):
    """All rows of pieces (advance, letter) that end within a width, as lists of (start, advance, letter)."""

    def more(at):
        yield at, []
        for a, k in pieces:
            if at + a <= width:
                for end, rest in more(at + a):
                    yield end, [(at, a, k), *rest]

    return more(0)


@pytest.mark.parametrize("seed", range(4))
def test_recurrence_against_all_rows(seed):
    r = np.random.default_rng(seed)
    width, em, space = 21, 12.0, 0.4
    masks = S.Masks(("A", "B"), (np.ones((4, 5)), np.ones((4, 7))), (5, 7), (0, 0), (0, 0))
    strip, scores = (r.random((6, width)) < 0.25).astype(float), np.round(r.random((2, width)), 3)
    wide, play = 5, 1
    pieces = [(wide, -1), (wide + play, -1)] + [(a + d, k) for k, a in enumerate(masks.adv) for d in (-play, 0, play)]
    best = {}
    for end, row in every_row(width, pieces):
        gain = 0.0
        for at, a, k in row:
            gain += a * (0.55 - 6 * strip[:, at : at + a].sum() / (a * 6) - 0.3) if k < 0 else a * (scores[k, at] - 0.3) if scores[k, at] >= 0.3 else -np.inf
        best[end] = max(best.get(end, -np.inf), gain)
    read = S.decoded(strip, scores, masks, em, space)
    assert read.gain == pytest.approx(max(v for e, v in best.items() if e >= width - 2 * wide))
    at = 0
    for start, _, _ in read.trace:
        assert start >= at
        at = start
    assert read.score == pytest.approx(np.mean([s for _, c, s in read.trace if c != " "] or [0.0]))
    assert S.decoded(np.zeros((6, 3)), np.zeros((2, 3)), masks, em, space).text == ""


def slow_lines(profile, least, share, core):
    """Lines by definition: sets of rows, grown from the densest."""
    n = len(profile)
    k = max(3, n // 400)
    smooth = [sum(profile[j] for j in range(y - k // 2, y + (k - 1) // 2 + 1) if 0 <= j < n) / k for y in range(n)]
    inked = [y for y in range(n) if smooth[y] > max(smooth) * share]
    out = []
    for first in (y for y in inked if y - 1 not in inked):
        last = next(y for y in range(first, n) if y in inked and y + 1 not in inked)
        if last - first + 1 < least:
            continue
        band = range(first, last + 1)
        most = max(profile[y] for y in band)
        dense = {y for y in band if profile[y] > most * core}
        own = {next(y for y in band if profile[y] == most)} if most else set()
        while grown := {y + d for y in own for d in (-1, 1) if y + d in dense} - own:
            own |= grown
        if own:
            out.append((min(own), max(own) + 1))
    return out


def test_growth_against_sets(spark):
    r = np.random.default_rng(7)
    rows = [[float(v) for v in np.maximum(0, r.integers(-6, 12, n))] for n in (1, 5, 40, 90, 1300)] + [[0.0] * 9, [0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 1.0, 8.0, 8.0, 1.0]]
    frame = spark.createDataFrame([(i, len(p), p) for i, p in enumerate(rows)], "key int, h int, p array<double>")
    for least, share, core in ((1, 0.04, 0.05), (3, 0.5, 0.4), (2, 0.3, 0.9)):
        got = {}
        for row in S.grown_bands(frame, least, share, core).collect():
            got.setdefault(row.key, []).append((row.y0, row.y1))
        assert {k: sorted(v) for k, v in got.items()} == {i: w for i, p in enumerate(rows) if (w := slow_lines(p, least, share, core) if max(p) else [])}


def test_pages_are_read_in_two_passes(spark):
    """A page drawn too narrow: its longest line tells the stretch, all its lines are read with it."""
    rows = [g | {"font": "one"} for g in glyphs(1)]
    text = spark.createDataFrame([("p", "QUICK BROWN JUMPS"), ("q", "LAZY DOGS")], "key string, text string")
    ink, sizes = pages.drawn(pages.wrapped(text, 11), rows, 32)
    narrow = F.when(F.col("key") == "p", F.floor(F.col("x") / 1.25)).otherwise(F.col("x"))
    ink = ink.withColumn("x", narrow.cast("int")).distinct().cache()
    bank = S.Bank.of(rows, EM, 0.5)
    assert bank.extent == pytest.approx(26 / EM)
    fonts = spark.createDataFrame([("p", "one"), ("q", "one")], "key string, font string")
    got = {r.key: r for r in S.read_pages(ink, lines.page_profiles(ink, sizes), fonts, {"one": bank}).collect()}
    assert {k: r.n_lines for k, r in got.items()} == {"p": 2, "q": 1}
    # a full line of this alphabet is 26 of 32 pixels high, so at the right size the letters' own widths are met at stretch 1
    assert got["q"].stretch == 1.0 and 1.12 <= got["p"].stretch <= 1.40
    assert got["q"].text.replace(" ", "") == "LAZYDOGS" and got["q"].confidence > 0.8
    near = sum(a == b for a, b in zip(got["p"].text.replace(" ", "").replace("\n", ""), "QUICKBROWNJUMPS", strict=False))
    assert near >= 10
