"""Reading evaluation rows from Parquet, JSON arrays and YAML specs, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreframe.sources.json_array import read_json_array, write_json_array

__all__ = ["CASE_METADATA", "QA_CORPUS", "read_json_array", "read_parquet", "shared_folder", "write_json", "write_json_array"]

QA_CORPUS = "source string, story string, questions array<string>, answers struct<input_text: array<string>, answer_start: array<bigint>, answer_end: array<bigint>>"
CASE_METADATA = f"struct<{QA_CORPUS.replace(' string', ': string').replace(' array', ': array').replace(' struct', ': struct')}>"


def read_parquet(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A Parquet table, or its first rows."""
    df = spark.read.parquet(path)
    return df if limit is None else df.limit(limit)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or below the warehouse where that is unset."""
    context = spark.sparkContext
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
