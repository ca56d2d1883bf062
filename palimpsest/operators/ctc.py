"""Greedy CTC reading of logits in rows (key, t, c, v): class 0 is blank, 1 a space, 2.. letters A.."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ALPHABET = " ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def greedy(logits: DataFrame) -> DataFrame:
    """(key, text, confidence): best class per step, repeats and blanks dropped, spaces collapsed, trimmed.

    Confidence is the mean over steps of the logistic of the margin between the best two values.
    """
    ranked = logits.withColumn("r", F.row_number().over(Window.partitionBy("key", "t").orderBy(F.desc("v"), "c"))).where("r <= 2")
    steps = ranked.groupBy("key", "t").agg(F.max(F.when(F.col("r") == 1, F.col("c"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("v"))).alias("v1"), F.max(F.when(F.col("r") == 2, F.col("v"))).alias("v2"))
    seen = steps.withColumn("before", F.lag("best", 1, -1).over(Window.partitionBy("key").orderBy("t")))
    letter = F.when((F.col("best") != 0) & (F.col("best") != F.col("before")), F.substring(F.lit(ALPHABET), F.col("best"), F.lit(1))).otherwise("")
    told = seen.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", letter.alias("ch")))), lambda s: s["ch"]), "").alias("raw"),
        F.avg(1 / (1 + F.exp(-(F.col("v1") - F.col("v2"))))).alias("confidence"),
    )
    return told.select("key", F.trim(F.regexp_replace("raw", " +", " ")).alias("text"), "confidence")
