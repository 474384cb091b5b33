"""Tables a library stores, written once and read many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bookloom.session import path_exists, scratch_path


class TableStore:
    """Named tables built on first use and kept as files in the shared folder.

    A table that survives as files costs nothing to lose an executor over, and every later question
    starts from a column-pruned scan of it rather than from the raw texts.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[str, str] = {}

    def get(self, name: str, build: Callable[[], DataFrame], **options: str) -> DataFrame:
        """The table, built first if there is none; ``options`` are those of its files."""
        path = self._paths.get(name)
        if path is None or not path_exists(self._spark, f"{path}/_SUCCESS"):
            path = scratch_path(self._spark, name)
            build().write.mode("overwrite").options(**options).parquet(path)
            self._paths[name] = path
        return self._spark.read.parquet(path)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows to a stored table, e.g. the reorganisation log."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its id: a replayed batch replaces itself instead of adding rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All micro-batches written so far; an empty table before the first."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)
