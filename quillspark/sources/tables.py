"""Readers for the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(table_path(sf_dir, name))
