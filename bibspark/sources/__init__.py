"""Scans and sinks: parquet tables, the derived BibTeX corpus, chat and HTML sources, file and report sinks."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
