"""Registered relational queries against their DuckDB SQL, and sources and decoder on small inputs."""

import base64
import json

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from palimpsest.functions import text as T
from palimpsest.operators import lexicon, profiles
from palimpsest.sources import readers
from tests.conftest import SF_SMALL

NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return con


def told(v):
    """A value as text, so that whole numbers of any type are equal and so are all kinds of nothing."""
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "-"
    return f"{round(float(v), 4) + 0:.4f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(told, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_folds_on_bands(spark):
    bands = spark.createDataFrame([("a", 0, 10), ("a", 11, 14), ("a", 40, 52)], "key string, y0 int, y1 int")
    assert sorted(map(tuple, profiles.merge_thin(bands).collect())) == [("a", 0, 14), ("a", 40, 52)]


def test_split_words(spark):
    words = [("HAUS", 0, False), ("BAUM", 1, False), ("GARTEN", 2, False), ("RUNE", 99999, True), ("SELTEN", 9000, False)]
    lex = spark.createDataFrame([(w, r, len(w), c, False) for w, r, c in words], "word string, rnk int, len int, is_custom boolean, is_noun boolean")
    tokens = spark.createDataFrame([(t,) for t in ("HAUSBAUM", "HAUSRUNE", "HAUSSELTEN", "HAUSBAVM", "GARTEM", "GARTEN", "RUNE", "X", "QQQQQQQQ", "HBUSBHUM")], "token string")
    got = {r.token: (r.cand, r.dist) for r in lexicon.split_words(tokens, lex).collect()}
    assert got == {"HAUSBAUM": ("HAUS BAUM", 0.0), "HAUSRUNE": ("HAUS RUNE", 0.0), "HAUSBAVM": ("HAUS BAUM", 1.0)}
    both = {r.token: r.cand for r in lexicon.correct_words(tokens, lex).collect()}
    assert both == {"HAUSBAUM": "HAUS BAUM", "HAUSRUNE": "HAUS RUNE", "HAUSBAVM": "HAUS BAUM", "GARTEM": "GARTEN"}


def test_close_candidates_lose_none(spark):
    r = np.random.default_rng(3)
    words = sorted({"".join(r.choice(list("EUBHTQLVW"), r.integers(2, 6))) for _ in range(150)})
    lex = spark.createDataFrame([(w, i, len(w), False, False) for i, w in enumerate(words)], "word string, rnk int, len int, is_custom boolean, is_noun boolean")
    tokens = spark.createDataFrame([(w,) for w in words[::3]], "token string")
    within = [df.withColumn("dist", T.weighted_distance("token", "cand")).where("dist <= 1").select("token", "cand") for df in (lexicon.candidates(tokens, lex), lexicon.close_candidates(tokens, lex))]
    a, b = (sorted(map(tuple, df.collect())) for df in within)
    assert a and a == b


def test_sources(spark, tmp_path):
    (tmp_path / "0.raw").write_bytes(bytes(range(6)))
    page = {"file": "0.raw", "w": 3, "h": 2, "font": "x", "level": "clean", "size": 1, "text": "A"}
    (tmp_path / "index.json").write_text(json.dumps([page, page | {"file": "1.raw", "level": "bad"}]))
    cat = readers.catalog(spark, str(tmp_path / "index.json"), ("x", "clean"))
    assert cat.count() == 1
    assert bytes(readers.raw_pages(spark, str(tmp_path), cat).first().gray) == bytes(range(6))
    glyph = {"adv": 1.0, "x0": 0.0, "y0": 0.0, "w": 1, "h": 2, "bitmap": base64.b64encode(b"\x01\x02").decode()}
    (tmp_path / "atlas.json").write_text(json.dumps({"emPx": 64, "alphabet": "A", "fonts": {"f": {"letters": {"A": glyph}, "ambiguous": ["AB"]}}}))
    table, twins = readers.atlas(spark, str(tmp_path / "atlas.json"))
    assert bytes(table.first().bitmap) == b"\x01\x02" and twins.first().grp == "AB"
    (tmp_path / "w.txt").write_text("# no\n\n Haus \n")
    assert [r.word for r in readers.custom_words(spark, str(tmp_path / "w.txt")).collect()] == ["Haus"]
    (tmp_path / "d.dic").write_text("2\nHaus/ab\nx1/c\nBaum/oz\n")
    assert [r.stem for r in readers.dictionary_stems(spark, str(tmp_path / "d.dic"), ("oz",)).collect()] == ["Haus"]


def test_streamed_counts(spark, tmp_path):
    from palimpsest.streaming.progress import for_each_batch, read_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    q = for_each_batch(read_arriving(spark, str(tmp_path / "in")), lambda df: df.select("length"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [r.length for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]
