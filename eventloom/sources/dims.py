"""Dimension tables: small next to events, but never assumed small.

No join here forces a broadcast. Spark broadcasts a side whose size it has measured below
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution repeats that check on the
real size at run time; a dimension that outgrows it is joined by shuffle with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = (
    "tenants", "tracking_urls", "filter_rules", "webhooks", "webhook_deliveries",
    "ingest_tokens", "api_keys",
)
FLAGS = {"active", "revoked"}


def _typed(df: DataFrame) -> DataFrame:
    """0/1 flags as booleans, JSON type lists as arrays."""
    for name in FLAGS.intersection(df.columns):
        if dict(df.dtypes)[name] != "boolean":
            df = df.withColumn(name, F.col(name) == 1)
    if dict(df.dtypes).get("event_types") == "string":
        df = df.withColumn("event_types", F.from_json("event_types", "array<string>"))
    return df


def load_parquet(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The dimension folders found under ``base``, by name."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {
        name: _typed(spark.read.parquet(f"{base}/{name}"))
        for name in DIMENSIONS
        if fs.exists(jvm.org.apache.hadoop.fs.Path(root, name))
    }


def load_jdbc(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The same tables from a relational database, one scan each."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    return {name: _typed(reader.option("dbtable", name).load()) for name in DIMENSIONS}
