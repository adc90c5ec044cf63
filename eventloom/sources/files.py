"""Folders of partitioned Parquet tables: what is there, replacing and removing partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _handle(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _handle(spark, path)
    return fs.exists(folder)


def make(spark: SparkSession, path: str) -> None:
    folder, fs = _handle(spark, path)
    fs.mkdirs(folder)


def remove(spark: SparkSession, path: str) -> bool:
    folder, fs = _handle(spark, path)
    return fs.delete(folder, True)


def unescaped(spark: SparkSession, name: str) -> str:
    """The partition value that a folder name stands for."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none if it is not there."""
    folder, fs = _handle(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def replace_partitions(df: DataFrame, path: str, keys: tuple[str, ...], **options: str) -> None:
    """Write ``df``, replacing exactly the partitions it has rows for.

    The rebalance hint merges small partitions and splits a hot one over several tasks,
    which a plain ``repartition`` on the keys would write from a single task.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .options(**options)
        .partitionBy(*keys)
        .parquet(path)
    )


def remove_partitions(spark: SparkSession, path: str, partitions: DataFrame) -> int:
    """Remove the folders named by rows of partition values, in the order of the columns."""
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    columns, removed = partitions.columns, 0
    for row in partitions.toLocalIterator():
        parts = [f"{c}={NULL_PARTITION if v is None else escape(str(v))}" for c, v in zip(columns, row)]
        removed += remove(spark, "/".join([path, *parts]))
    return removed
