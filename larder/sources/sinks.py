"""Writing results: plain, split by key, resumable, in batches and chunks; saving models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from larder.operators.ordering import in_batches
from larder.operators.relational import anti


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def write_split(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder per key value; a large value is spread over several files by its own tasks."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def _completed(path: str) -> str:
    return f"{path.rstrip('/')}/_complete"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def pending(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose partition has not been marked as complete."""
    done = _completed(path)
    if not _exists(df.sparkSession, done):
        return df
    return anti(df, df.sparkSession.read.schema(df.select(*keys).schema).parquet(done).distinct(), keys)


def write_pending(df: DataFrame, path: str, keys: list[str]) -> None:
    """Resume: write only partitions that are not complete; what a failed run left of them is replaced.

    A partition counts as complete once its key is in the marker table, which is written after the rows.
    """
    rows = pending(df, path, keys)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    rows.select(*keys).distinct().write.mode("append").parquet(_completed(path))


def write_batches(df: DataFrame, path: str, keys: list[str], size: int = 500, seed: int = 42) -> None:
    """Shuffled batches of ``size`` rows, a folder each."""
    in_batches(df, keys, size, seed).write.mode("overwrite").partitionBy("batch").parquet(path)


def write_chunks(df: DataFrame, path: str, rows: int = 10000) -> None:
    """Files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().session(spark).load(path)
