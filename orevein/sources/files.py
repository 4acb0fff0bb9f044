"""Text-file sources and sinks: seeds, frontier log, stop words, stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import file_key, normalize


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """``(url, depth)`` from lines of an address, one space and a depth."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("url"), F.try_to_number(parts[1], F.lit("999999999")).cast("int").alias("depth")).where("depth is not null")


def frontier_log(spark: SparkSession, path: str) -> DataFrame:
    """``(status, url, depth, ord)`` from lines such as ``U_http://example.com 0``; U is pending, V visited; bad lines are passed over.

    ``ord`` grows with the place in the log (files in the order of their names), so the oldest entry has the least.
    """
    part = lambda i: F.regexp_extract("value", r"^([UV])_(.*) (\d+)$", i)
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    return lines.select(part(1).alias("status"), normalize(part(2)).alias("url"), part(3).cast("int").alias("depth"), "ord").where("status <> '' and url is not null")


def write_frontier(frontier: DataFrame, path: str) -> None:
    rows = frontier.orderBy("ord") if "ord" in frontier.columns else frontier
    rows.select(F.concat(F.col("status"), F.lit("_"), F.col("url"), F.lit(" "), F.col("depth"))).write.mode("overwrite").text(path)


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """The words of a file, one in a line; a missing file is an error. Lists of words are bounded by the language, so they are collected."""
    return sorted({r[0].strip() for r in spark.read.text(path).where(F.trim("value") != "").collect()})


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, html)`` of stored HTML files, one row per file; empty files give none."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("html"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages as a table keyed by the name that their url gives; ``file_path`` is where a file of that name would stand."""
    keyed = pages.withColumn("file_key", file_key(F.col("url")))
    keyed.withColumn("file_path", F.concat(F.lit(path.rstrip("/") + "/"), "file_key", F.lit(".html"))).write.mode("overwrite").parquet(path)
