"""Readers of the parquet tables. Ids are unique after reading with ``keyed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(spark: SparkSession, folder: str, name: str, key: str, *columns: str) -> DataFrame:
    """The named columns with one row per key; rows delivered twice count once.

    Copies have equal content, so whichever of them stays makes no difference. Columns are
    pruned before the shuffle that removes copies.
    """
    df = table(spark, folder, name)
    return df.select(key, *columns).dropDuplicates([key])
