"""Page tables in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """A parquet table as it lies, or hashed by ``key`` into ``partitions``.

    Parsing is the costly step, so a table of few files is worth spreading ahead of it; how far is the
    caller's choice and does not depend on the data.
    """
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions, key)


def newest(pages: DataFrame, at: str = "fetched_at") -> DataFrame:
    """The newest version of every page of a table that was fetched more than once.

    The newest is found on times and a hash of the content, and only its row is kept for the parse; of versions of one time
    that with the greater hash stays, a null time is the oldest, and equal rows count once.
    """
    mark = F.xxhash64("url", "html")
    last = pages.select("page_id", at, mark.alias("_mark")).groupBy("page_id").agg(F.max(F.struct(at, "_mark")).alias("_last"))
    last = last.select(F.col("page_id").alias("_page"), F.col(f"_last.{at}").alias("_at"), F.col("_last._mark").alias("_of"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & F.col(at).eqNullSafe(F.col("_at")) & (mark == F.col("_of"))
    return pages.join(last, same, "left_semi").dropDuplicates(["page_id"])


def read_pages(spark: SparkSession, path: str, partitions: int | None = None, at: str | None = None) -> DataFrame:
    """Crawled pages ``(page_id, url, html)``; with ``at``, the newest version of each by that column."""
    if at is None:
        return read_table(spark, path, "page_id", partitions).select("page_id", "url", "html")
    pages = newest(read_table(spark, path), at)
    return (pages if partitions is None else pages.repartition(partitions, "page_id")).select("page_id", "url", "html")
