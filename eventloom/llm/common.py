"""What the operators of this package share: tables, written intermediates, worker state."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the word rule `[^\x20\x09-\x0D]+`.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[\\x20\\x09-\\x0D]+"

BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches. Where none is named, one machine alone makes its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, executors may be lost.
    ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers 8 MB at a time, however long texts are, where the session names no
    size of its own. Both sides of the pipe hold a batch at once, for each task of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def per_worker(key: str, build: Callable):
    """One object per Python worker process, kept from task to task.

    Functions travel by value, so their modules' globals are new in every task.
    """
    store = sys.modules.setdefault("_eventloom_worker", types.ModuleType("_eventloom_worker")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def forget() -> None:
    """Drops what ``per_worker`` kept for the operators before this one, whose tasks are over."""
    sys.modules.pop("_eventloom_worker", None)


def give_back() -> None:
    """Hands what this Python worker has freed back to the system. A worker lives from task to task,
    and an executor holds what its workers keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, by built-in functions; null and empty give none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


def spare_name(df: DataFrame, base: str, taken: Iterable[str] = ()) -> str:
    """A column name that ``df`` does not have yet, whatever extra columns it came with."""
    used = {c.lower() for c in [*df.columns, *taken]}
    while base.lower() in used:
        base = f"_{base}"
    return base
