"""Session settings every job relies on, and the shared folder for written intermediates."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings that change results, so they are set on whatever session a caller brings.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated query-string key keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # `hour=07` must stay the string '07' when read back.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Rewrites replace only the partitions present in the new data.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

# Settings that only change speed; a cluster's own choice wins over them.
TUNING_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings whose absence would change results."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "eventloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter builds its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in {**SEMANTIC_CONF, **TUNING_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder all executors can reach for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``; ``fallback`` is used only when
    that is unset, which is the case in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named
