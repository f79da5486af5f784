"""Readers of crawl tables and inline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """(id, draft): each Markdown file of a folder as one row, named by its file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("id"), F.col("value").alias("draft"))


def results(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Results of an earlier run, by their columns; what a row lacks is NULL."""
    return spark.read.schema(columns).json(path)


#: Bytes of the files of pages that a task should have at most: reading what a page says takes far longer than dealing it out.
SHARE = 8 << 20


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, dealt anew where their files are fewer than the cores, or than shares of SHARE.

    A file is split by its groups of rows alone, so a large one would be a few long tasks; what is dealt is a part of the
    table's size, and taking the pages apart takes seconds for each of its megabytes.
    """
    found = table(spark, sf_dir, "pages")
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files, as the scan knows it
    shares = max(spark.sparkContext.defaultParallelism, -(-size // SHARE))
    return found.repartition(shares) if len(found.inputFiles()) < shares else found


# Statuses of a site that is up and turned this request away.
BLOCKED_STATUS = (401, 403, 429, 451)


def reach(status: Column) -> Column:
    """ok, blocked, dead or unknown; a missing status is a failed connection, which says nothing of the site."""
    return F.when(status.isNull(), "unknown").when(status.between(200, 299), "ok").when(status.isin(*BLOCKED_STATUS), "blocked").when((status == 404) | (status >= 500), "dead").otherwise("unknown")
