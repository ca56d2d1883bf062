"""Each stage of the pipeline, and all of them in sequence, on nulls, empty tables, repeated rows and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import KEY, SCHEMA, prose, table_rows

CLASHING = ["__x", "slots", "slot", "period", "before", "n_docs", "nth", "quality", "kept", "component_id", "text_key", "item_id", "spans", "host", "rep", "bucket"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder of documents and benchmark."""
    at = str(tmp_path_factory.mktemp("data"))
    rows = table_rows() + [(100 + i, prose(60, 4000 + i), "en", "s1", 5, "b", 1, "h", "r") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, prose(60, 4003)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_run(spark, folder, docs):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*docs.columns, "mix_slot"]
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    assert 103 not in ids and 102 in ids  # a benchmark item, and its neighbour
    assert 0 in ids and 1 not in ids  # copies: the least id stays
    assert 6 not in ids and 7 not in ids and not any(r.text is None for r in rows)  # without words: rejected
    assert not any(KEY in r.text for r in rows)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_and_survives(spark, folder, docs, name, stage):
    wide = docs
    for c in CLASHING:
        if c not in wide.columns:
            wide = wide.withColumn(c, F.lit(7))
    before = {(r.doc_id, r.text): r for r in wide.collect()}
    got = stage(spark, wide, folder)
    extra = ["mix_slot"] if name == "source_mixing" else []
    assert got.columns == [*wide.columns, *extra]
    rows = got.collect()
    same = [c for c in wide.columns if c not in ("text", "n_chars")]
    ids = {k[0]: r for k, r in before.items() if k[0] is not None}
    assert rows and all(all(r[c] == ids[r.doc_id][c] for c in same) for r in rows if r.doc_id is not None)
    assert stage(spark, wide.limit(0), folder).count() == 0
    null = spark.createDataFrame([(None,) * 9] * 3, SCHEMA)
    assert stage(spark, null, folder).count() == (0 if name == "quality_classifier" else 3)


def test_stages_one_by_one_are_the_run(spark, folder, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
