"""A training-data pipeline over `documents`: STAGES in order, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back
as the next stage's docs. All but the last return the columns of documents; the last adds mix_slot and lays
the rows out in the order of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.decontamination import drop_contaminated
from palimpsest.llm.minhash_dedup import near_duplicates
from palimpsest.llm.mixing import mixed_order
from palimpsest.llm.quality_classifier import keep_good
from palimpsest.llm.secret_scan import redact_secrets
from palimpsest.tables import materialize, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label quality classifier rejects go.

    Rows whose text is null or has no words are rejected; repeated rows and equal texts stay or go together; null
    doc_ids are judged like others; an empty table stays empty; further columns are kept and not read.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Groups are by five-word shingles and a similarity of 0.8. Rows that repeat a doc_id are one document and
    stay or go together; rows without a doc_id and texts without words stay; an empty table stays empty. The helper
    column is named __gone_id, and docs may have no column of that name.
    """
    grouped = near_duplicates(docs)
    gone = materialize(grouped.where("not kept").select(grouped["doc_id"].alias("__gone_id")).distinct(), "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go.

    Rows are matched by doc_id and text, so a null doc_id goes with its own text only; null and empty texts overlap
    with nothing and stay; null items are not searched for; empty tables on either side remove nothing. Helper
    columns are named __bad_*, and docs may have no columns of such names.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows the text. No row goes.

    A null text stays null and keeps its n_chars; repeated rows are changed alike; without any credential in the
    table only the base patterns are replaced; an empty table stays empty; other columns are kept.
    """
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights. No row goes; mix_slot is added, rows are laid out by it.

    A null source is the source ''; null doc_ids are spread by a hash of their row; equal rows stand next to each
    other; an empty table stays empty. Helper columns are named __mix_*, and docs may have no columns of such names.
    """
    return mixed_order(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", redact),
    ("source_mixing", mix_sources),
]

#: SQL can't express the trained classifier and the inferred automata.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote on its way goes once its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
