"""Sinks: pages with their catalog, reports, results, images for looking at, reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages (file, w, h, gray bytes and anything else) as Parquet, and their catalog without the bytes as JSON."""
    pages.write.mode("overwrite").parquet(f"{folder}/pages")
    pages.drop("gray").write.mode("overwrite").json(f"{folder}/index")


def write_report(lines: DataFrame, folder: str, order: list[str]) -> None:
    """Text lines (line, and the columns of order) in order; a report is short and becomes one file."""
    lines.orderBy(*order).coalesce(1).select("line").write.mode("overwrite").text(folder)


def write_results(results: DataFrame, folder: str) -> None:
    """Result rows as JSON."""
    results.write.mode("overwrite").json(folder)


def write_reference_tables(folder: str, **tables: DataFrame) -> None:
    """Alphabets, lexicons and the like, each as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def gray_image(w: Column, h: Column, gray: Column) -> Column:
    """Gray bytes as a binary image file (PGM)."""
    header = F.encode(F.format_string("P5\n%d %d\n255\n", w, h), "US-ASCII")
    return F.concat(header, gray)


def messages(results: DataFrame) -> DataFrame:
    """Answers (job, text, error, i, total) as messages: job, kind (error, progress or result), body."""
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("i") < F.col("total"), "progress").otherwise("result")
    body = F.when(kind == "progress", F.concat(F.col("i").cast("string"), F.lit("/"), F.col("total").cast("string")))
    return results.select("job", kind.alias("kind"), F.coalesce(F.col("error"), body, "text").alias("body"))
