"""Counts and keys as append-only logs: every batch adds a folder of its own, readers merge.

Nothing is rewritten in place, so neither the order of batches nor a repeated one changes what is
read, and a job that stops anywhere leaves a readable log. From time to time the folders of
finished batches are folded into one (``base=1``), which takes effect folder by folder as it
appears; what it replaces is removed later, when no reader can still hold it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import files


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> Column:
    """Equality of the named columns, nulls equal."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


@dataclass(frozen=True)
class CountLog:
    """Sums of ``count`` per ``keys`` (name: type), kept in folders by ``parts`` (names among them)."""

    path: str
    keys: tuple[tuple[str, str], ...]
    parts: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.keys]

    @property
    def _folders(self) -> tuple[str, ...]:
        return (*self.parts, "base", "batch")

    def _schema(self) -> str:
        data = [f"{n} {t}" for n, t in self.keys if n not in self.parts]
        return ", ".join([*data, "count long", *[f"{p} string" for p in self._folders]])

    def _rows(self, spark: SparkSession, within: Column | None, skip_unreadable: bool) -> DataFrame:
        if not files.exists(spark, self.path):
            return spark.createDataFrame([], self._schema()).withColumn("batch", F.col("batch").cast("long"))
        reader = spark.read.schema(self._schema()).option("ignoreCorruptFiles", str(skip_unreadable).lower())
        rows = reader.parquet(self.path)
        rows = rows if within is None else rows.where(within)
        return rows.withColumn("batch", F.col("batch").cast("long"))

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows that count: of each folder the newest fold and the batches after it."""
        cuts = rows.where("base = '1'").groupBy(*self.parts).agg(F.max("batch").alias("_cut"))
        cuts = cuts.toDF(*[f"_{p}" for p in self.parts], "_cut")
        same = reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.parts])
        cut = F.coalesce("_cut", F.lit(-1))
        return rows.join(cuts, same, "left").where(
            ((F.col("base") == "1") & (F.col("batch") == cut)) | ((F.col("base") == "0") & (F.col("batch") > cut))
        )

    def _merged(self, rows: DataFrame) -> DataFrame:
        return self._current(rows).groupBy(*self.names).agg(F.sum("count").alias("count"))

    def _write(self, counts: DataFrame, base: int, batch: int) -> None:
        labelled = counts.select(*self.names, "count").withColumns(
            {"base": F.lit(str(base)), "batch": F.lit(str(batch))}
        )
        files.replace_partitions(labelled, self.path, self._folders)

    def add(self, counts: DataFrame, batch: int) -> None:
        """One batch's counts; a repeated batch replaces its own folders and no others."""
        self._write(counts, 0, batch)

    def read(
        self, spark: SparkSession, within: Column | None = None, skip_unreadable: bool = False, but: int | None = None
    ) -> DataFrame:
        """The counts. ``within``, a condition on ``parts``, prunes folders.

        ``but`` leaves out one batch: a batch that is delivered again must not see its own counts.
        """
        rows = self._rows(spark, within, skip_unreadable)
        if but is not None:
            rows = rows.where((F.col("base") == "1") | (F.col("batch") != but))
        return self._merged(rows).where("count <> 0")

    def newest(self, spark: SparkSession) -> int:
        """Number of the newest batch, -1 in an empty log."""
        found = self._rows(spark, None, False).agg(F.max("batch")).head()[0]
        return -1 if found is None else found

    def fold(self, spark: SparkSession, upto: int, within: Column | None = None) -> None:
        """Merge the batches up to ``upto``, which must be finished, into one folder each.

        Folders that need no merging are left alone, so a second call does nothing.
        """
        rows = self._rows(spark, within, False).where(F.col("batch") <= upto)
        folded = F.max(F.when(F.col("base") == "1", F.col("batch")))
        many = (
            rows.select(*self._folders).distinct().groupBy(*self.parts)
            .agg(F.count("*").alias("n"), F.coalesce(folded, F.lit(-1)).alias("folded"), F.max("batch").alias("last"))
            .where("n > 1 and last > folded")
            .select(*self.parts)
        )
        many = many.toDF(*many.columns)
        self._write(self._merged(rows.join(many, _same(rows, many, self.parts), "left_semi")), 1, upto)

    def replace(self, counts: DataFrame, upto: int, within: Column) -> None:
        """Put recomputed counts in the place of all batches up to ``upto`` where ``within`` holds."""
        spark = counts.sparkSession
        held = self._rows(spark, within, False).where(F.col("batch") <= upto)
        # A count that vanished is written as zero, so that its folder is replaced too.
        gone = held.select(*self.names).distinct().withColumn("count", F.lit(0).cast("long"))
        both = counts.select(*self.names, "count").unionByName(gone)
        self._write(both.groupBy(*self.names).agg(F.sum("count").alias("count")), 1, upto)

    def expire(self, spark: SparkSession, before: int) -> int:
        """Remove folders that a fold of batch ``before`` or earlier has replaced; returns how many."""
        rows = self._rows(spark, None, False)
        folders = rows.select(*self._folders).distinct()
        old = folders.where((F.col("base") == "0") | (F.col("batch") <= before))
        cuts = folders.where((F.col("base") == "1") & (F.col("batch") <= before)).groupBy(*self.parts).agg(F.max("batch").alias("cut"))
        cuts = cuts.toDF(*[f"_{p}" for p in self.parts], "cut")
        same = reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.parts])
        dead = old.join(cuts, same).where(
            ((F.col("base") == "0") & (F.col("batch") <= F.col("cut"))) | ((F.col("base") == "1") & (F.col("batch") < F.col("cut")))
        )
        return files.remove_partitions(spark, self.path, dead.select(*self._folders))


@dataclass(frozen=True)
class KeyLog:
    """Keys seen so far, dealt into a fixed number of buckets by hash, never looked back by date.

    A lookup reads the key column of the buckets it needs and nothing else; a Bloom filter in
    every file answers point reads.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").cast("string")

    def _rows(self, spark: SparkSession) -> DataFrame:
        schema = ", ".join([*[f"{k} string" for k in self.keys], "bucket string", "batch string"])
        if not files.exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path)

    def unseen(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose key no earlier batch has; the batch's own keys do not count."""
        spark = rows.sparkSession
        keyed = rows.withColumn("bucket", self._bucket())
        wanted = keyed.select(*self.keys, "bucket")
        # At most ``buckets`` values: a small batch reads a few folders only.
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
        held = self._rows(spark).where(F.col("bucket").isin(touched) & (F.col("batch") != str(batch)))
        # Only ids of the batch leave the scan; the history itself is not shuffled as a whole.
        on = ["bucket", *self.keys]
        seen = held.select(*on).join(wanted, on, "left_semi")
        return keyed.join(seen, on, "left_anti").drop("bucket")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Record the keys of a batch; a repeated batch replaces its own."""
        labelled = rows.select(*self.keys).withColumns({"bucket": self._bucket(), "batch": F.lit(str(batch))})
        files.replace_partitions(labelled, self.path, ("bucket", "batch"), **self._filters())

    def fold(self, spark: SparkSession, upto: int) -> None:
        """Merge finished batches into one folder a bucket; keys standing twice meanwhile do no harm.

        Folds are numbered below zero, so that no batch is taken for one.
        """
        label = f"-{upto + 2}"
        number = F.col("batch").cast("long")
        old = self._rows(spark).where((number <= upto) & (F.col("batch") != label))
        dead = [tuple(r) for r in old.select("bucket", "batch").distinct().toLocalIterator()]
        if dead:
            merged = old.select(*self.keys, "bucket").distinct().withColumn("batch", F.lit(label))
            files.replace_partitions(merged, self.path, ("bucket", "batch"), **self._filters())
            files.remove_partitions(spark, self.path, spark.createDataFrame(dead, "bucket string, batch string"))

    def _filters(self) -> dict[str, str]:
        return {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}
