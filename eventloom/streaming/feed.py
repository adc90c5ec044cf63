"""A feed that keeps its newest batches, and tells a reader that fell behind how much it missed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.filters import live_feed
from eventloom.sources import files
from eventloom.streaming.sinks import SILVER_DDL, Sink, rows_sink


@dataclass(frozen=True)
class Feed:
    """The newest ``keep`` batches of rows at ``path``; the size of every batch is kept for good."""

    path: str
    keep: int = 100

    def _batches(self, spark: SparkSession, name: str) -> list[int]:
        return sorted(int(n[6:]) for n in files.names(spark, f"{self.path}/{name}") if n.startswith("batch="))

    def sink(self) -> Sink:
        rows, sizes = rows_sink(f"{self.path}/rows"), rows_sink(f"{self.path}/sizes")

        def write(df: DataFrame, batch_id: int) -> None:
            spark = df.sparkSession
            rows(df, batch_id)
            stored = spark.read.schema(df.schema).parquet(f"{self.path}/rows/batch={batch_id}")
            # The size comes last: a batch without one has not been offered yet.
            sizes(stored.agg(F.count("*").alias("n")), batch_id)
            for old in self._batches(spark, "rows"):
                if old <= batch_id - self.keep:
                    files.remove(spark, f"{self.path}/rows/batch={old}")

        return write

    def read(self, spark: SparkSession, after: int = -1, **filters) -> tuple[DataFrame, int, int]:
        """Rows of the batches after ``after`` that pass ``filters``, the position to go on from, and
        ``missed``: how many events of those batches, of any kind, are no longer kept."""
        offered = [b for b in self._batches(spark, "sizes") if b > after]
        if not offered:
            return spark.createDataFrame([], SILVER_DDL), after, 0
        newest = offered[-1]
        kept = [b for b in offered if b > newest - self.keep]
        gone = [b for b in offered if b <= newest - self.keep]
        missed = 0
        if gone:
            sizes = spark.read.schema("n long").parquet(*[f"{self.path}/sizes/batch={b}" for b in gone])
            missed = sizes.agg(F.sum("n")).head()[0]
        rows = spark.read.schema(SILVER_DDL).parquet(*[f"{self.path}/rows/batch={b}" for b in kept])
        return live_feed(rows, **filters), newest, missed
