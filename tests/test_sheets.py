"""Sheets and other images for looking at against plain arrays; answers, chosen parts and sinks on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import requests
from palimpsest.operators import evaluate, glyphs, sheets
from palimpsest.sources import readers, sinks

PX = "img long, w int, h int, y int, x int, v int"


def pixels(spark, images):
    rows = [(i, a.shape[1], a.shape[0], y, x, int(a[y, x])) for i, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PX)


def arrays(px):
    return {r.img: np.frombuffer(bytes(r.gray), np.uint8).reshape(r.h, r.w) for r in sheets.packed(px).collect()}


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(5)
    return {i: r.integers(0, 256, (h, w)) for i, (h, w) in enumerate([(3, 4), (1, 7), (5, 2), (2, 2), (6, 6)])}


def same(got, want):
    assert got.keys() == want.keys()
    for i, a in want.items():
        assert np.array_equal(got[i], a), i


def test_packed_is_a_round_trip(spark, images):
    px = pixels(spark, images)
    same(arrays(px), images)
    made = sheets.packed(px).where("img = 0").select(sinks.gray_image(F.col("w"), F.col("h"), F.col("gray")).alias("file")).first().file
    assert bytes(made) == b"P5\n4 3\n255\n" + images[0].astype(np.uint8).tobytes()
    assert arrays(spark.createDataFrame([(0, 2, 1, 0, 0, 300), (0, 2, 1, 0, 1, -4)], PX))[0].tolist() == [[255, 0]]


@pytest.mark.parametrize("around", [True, False])
def test_stacked(spark, images, around):
    places = spark.createDataFrame([(0, 10, 2), (1, 10, 1), (2, 11, 0), (4, 10, 1)], "img long, sheet long, no int")
    want = {}
    for sheet, order in ((10, (1, 4, 0)), (11, (2,))):
        wide, gap = max(images[i].shape[1] for i in order), np.full((3, 1), 9)
        rows = [np.pad(images[i], ((0, 0), (0, wide - images[i].shape[1])), constant_values=9) for i in order]
        bar = np.repeat(gap, wide, 1)
        parts = [bar] * around + [p for r in rows for p in (r, bar)]
        want[sheet] = np.vstack(parts if around else parts[:-1])
    same(arrays(sheets.stacked(pixels(spark, images), places, 3, 9, around)), want)


def test_contact_sheets(spark, images):
    places = spark.createDataFrame([(0, 7, 0), (3, 7, 4), (4, 8, 1)], "img long, sheet long, place int")
    got = arrays(sheets.contact_sheets(pixels(spark, images), places, 10, 3, 3, 1))
    assert {i: a.shape for i, a in got.items()} == {7: (20, 30), 8: (10, 30)}
    frame = np.full((10, 10), 255)
    frame[1:9, 1:9] = 180
    frame[2:8, 2:8] = 255
    want = np.full((20, 30), 255)
    want[:10, :10] = want[10:, 10:20] = frame
    want[3:6, 3:7] = images[0]
    want[14:16, 14:16] = images[3]
    assert np.array_equal(got[7], want)
    small = np.zeros((4, 4))
    for y, x in np.ndindex(4, 4):  # 6 pixels to 4: each covers one and a half a side
        share = [np.clip(np.minimum(np.arange(1, 7), (k + 1) * 1.5) - np.maximum(np.arange(6), k * 1.5), 0, None) for k in (y, x)]
        small[y, x] = np.floor((np.outer(*share) * images[4]).sum() / 2.25 + 0.5)
    want = np.full((10, 30), 255)
    want[:, 10:20] = frame
    want[3:7, 13:17] = small
    assert np.array_equal(got[8], want)


def test_overlaid(spark):
    r = np.random.default_rng(6)
    ink = {i: r.integers(0, 2, (9, 11)) for i in range(3)}
    boxes = [(0, 1, 9, 2, 8), (0, 8, 14, -3, 4), (1, 3, 3, 0, 5), (1, 4, 5, 4, 5), (5, 0, 4, 0, 4)]
    want = {i: np.where(a == 1, 0, 255) for i, a in ink.items()}
    for i, x0, x1, y0, y1 in boxes:
        for y in range(max(y0, 0), min(y1, 9)):
            for x in range(max(x0, 0), min(x1, 11)):
                if i in want and (min(x - x0, x1 - 1 - x) < 2 or min(y - y0, y1 - 1 - y) < 2):
                    want[i][y, x] = 128
    px = pixels(spark, ink).withColumnRenamed("v", "ink")
    df = spark.createDataFrame(boxes, "img long, x0 int, x1 int, y0 int, y1 int")
    same(arrays(sheets.overlaid(px, df, 2)), want)


def test_parts_and_strips(spark, images):
    px = pixels(spark, images)
    boxes = spark.createDataFrame([(0, 1, 9, -1, 2), (1, 7, 9, 0, 1), (2, 0, 2, 3, 3), (4, 2, 5, 1, 6)], "img long, x0 int, x1 int, y0 int, y1 int")
    same(arrays(sheets.cropped(px, boxes)), {0: images[0][:2, 1:], 4: images[4][1:6, 2:5]})
    same(arrays(sheets.enlarged(px, 3)), {i: a.repeat(3, 0).repeat(3, 1) for i, a in images.items()})
    pairs = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 2, 0)], "img long, sheet long, no int")
    both = np.full((3 + 16 + 1, 7), 255)
    both[:3, :4], both[19:] = images[0], images[1]
    want = {1: both[:, :5].repeat(2, 0).repeat(2, 1), 2: images[2].repeat(2, 0).repeat(2, 1)}
    same(arrays(sheets.compared(px, pairs, 5, 2)), want)


def test_nothing_to_look_at(spark):
    none = spark.createDataFrame([], PX)
    places = spark.createDataFrame([], "img long, sheet long, no int, place int")
    boxes = spark.createDataFrame([], "img long, x0 int, x1 int, y0 int, y1 int")
    ink = none.withColumnRenamed("v", "ink")
    for df in (sheets.packed(none), sheets.stacked(none, places), sheets.contact_sheets(none, places, 10, 3, 3), sheets.overlaid(ink, boxes), sheets.cropped(none, boxes)):
        assert df.count() == 0


def test_glyphs_read_alone(spark):
    cross, bar = [(0, 0), (0, 1), (1, 0), (1, 1)], [(0, 0), (0, 1)]
    dark = lambda marks: {(y, x): 0 if (y, x) in marks else 255 for y in range(2) for x in range(2)}
    drawn = [(letter, y, x, v) for letter, marks in (("B", cross), ("A", cross), ("C", bar)) for (y, x), v in dark(marks).items()]
    templates = glyphs.shape_sums(spark.createDataFrame(drawn, "letter string, y int, x int, v int"))
    ink = [(i, y, x, int((y, x) in marks)) for i, marks in enumerate((cross, bar, [])) for y in range(2) for x in range(2)]
    got = {r.img: (r.got, r.dice) for r in glyphs.read_alone(spark.createDataFrame(ink, "img long, y int, x int, ink int"), templates).collect()}
    assert got == {0: ("A", 1.0), 1: ("C", 1.0), 2: ("", 0.0)}


def test_line_similarity(spark):
    pairs = [("a", "HAUS\nBAUM", "HAUS\nBAUN\nTOR"), ("b", "X", ""), ("c", None, "AB"), ("d", "A", None), ("e", " HAUS ", "\n\nHAUS")]
    got = {r.key: (r.lines, round(r.similarity, 6)) for r in evaluate.line_similarity(spark.createDataFrame(pairs, "key string, want_text string, got_text string")).collect()}
    assert got == {"a": (3, round(1.75 / 3, 6)), "b": (0, 0.0), "c": (1, 0.0), "d": (0, 0.0), "e": (1, 0.0)}


def test_answers(spark):
    rows = [(None, ["A", "L/V", "Q/T", "L/V"], False, 0.857, 3, 1240), (None, ["A"], True, 0.5, 0, None), ("gone", ["A"], False, 1.0, 1, 10), (None, [" "], True, 1.0, 1, 10), (None, None, True, None, None, None)]
    df = spark.createDataFrame(rows, "error string, cells array<string>, neural boolean, confidence double, lines int, ms long")
    c = F.col
    told = requests.answer(c("error"), c("cells"), F.lit("Old Hand"), c("neural"), c("confidence"), c("lines"), c("ms"))
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in told.items()]).collect()]
    assert got == [
        ("ok", "Old Hand, confidence 86 %, 3 lines, 1.2 s", "A[L/V][Q/T][L/V]", "L/V, Q/T", True),
        ("ok", "Old Hand, fast reader", "A", None, False),
        ("error", None, "gone", None, False),
        ("empty", None, " ", None, False),
        ("empty", None, None, None, False),
    ]


def test_chosen_part(spark):
    v = [F.lit(n) for n in (10.0, 20.0, 300.0, 150.0, 4.0, 500.0, 1100)]
    part = requests.chosen_part(*v)
    got = spark.range(1).select(*[c.alias(k) for k, c in part.items()]).first()
    assert tuple(got) == (40.0, 80.0, 1240.0, 680.0, 1100, 550, 1.0)


def test_sinks_and_unknown_fonts(spark, tmp_path):
    results = spark.createDataFrame([("a", 0.5), ("b", None)], "file string, cer double")
    sinks.write_results(results, str(tmp_path / "results"))
    assert sorted((r.file, r.cer) for r in spark.read.schema("file string, cer double").json(str(tmp_path / "results")).collect()) == [("a", 0.5), ("b", None)]
    sinks.write_reference_tables(str(tmp_path / "tables"), results=results, words=results.select("file"))
    assert spark.read.parquet(str(tmp_path / "tables" / "words")).count() == spark.read.parquet(str(tmp_path / "tables" / "results")).count() == 2
    named = spark.createDataFrame([("f", "1.jpg"), ("g", "2.jpg")], "font string, file string")
    known = spark.createDataFrame([("f", "A")], "font string, ch string")
    assert [r.font for r in readers.unknown_fonts(named, known).collect()] == ["g"]
