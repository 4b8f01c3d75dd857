"""Sources: Parquet tables of a folder, and files as (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, *paths: str, glob: str | None = None) -> DataFrame:
    """(path, content) of text files below paths; files that are not UTF-8 are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (read.option("pathGlobFilter", glob) if glob else read).load(list(paths))
    return rows.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"))
