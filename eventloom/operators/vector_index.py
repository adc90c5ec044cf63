"""A stored vector index: an inverted file that grows by appends and answers many queries at once.

Centres are fitted on a bounded sample, every vector is indexed under its nearest centre. A search
probes the nearest cells of each query; cells and queries meet in blocks of bounded size, so a crowded
cell or a popular one spreads over tasks. Each cell keeps its radius: by the triangle inequality a
cell farther than a query's k-th distance plus its radius holds nothing nearer, and ``exact``
probes just the cells that this cannot rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators.similar import TOP_K
from eventloom.sources import files

# Rows the centres are fitted on, at most.
SAMPLE_ROWS = 100_000
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 1_024
SLACK = 1e-9


def _grid(column, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of every row of ``x`` from every centre."""
    square = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _block(size: int, k: int, skip_same: bool):
    """The ``k`` nearest vectors of a block for each query of a block."""

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(queries) and len(vectors):
            x, ids = _grid(vectors["vector"], size), np.array(vectors["id"].to_pylist(), dtype=object)
            rank = np.argsort(ids, kind="stable")
            x, ids = x[rank], ids[rank]
            for name, q in zip(queries["query_id"].to_pylist(), _grid(queries["vector"], size)):
                far = np.sqrt(((x - q) ** 2).sum(axis=1))
                if skip_same:
                    far = np.where(ids == name, np.inf, far)
                # Equal distances keep the order of ids.
                best = np.argsort(far, kind="stable")[:k]
                best = best[np.isfinite(far[best])]
                out[0].extend([name] * len(best))
                out[1].extend(ids[best].tolist())
                out[2].extend(far[best].tolist())
        kinds = (queries.schema.field("query_id").type, vectors.schema.field("id").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "id", "distance"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    """The index at ``path``; ``id_type`` is the type of its ids."""

    path: str
    id_type: str = "string"

    @classmethod
    def create(
        cls, vectors: DataFrame, path: str, cells: int, id_col: str = "event_id", vector_col: str = "vector",
        sample_rows: int = SAMPLE_ROWS, seed: int = 7,
    ) -> VectorIndex:
        """An empty index whose centres fit ``sample_rows`` rows, chosen by a hash of the id."""
        named = vectors.select(F.xxhash64(id_col).alias("h"), F.col(vector_col).alias("v")).where("v is not null")
        sample = named.orderBy("h").limit(sample_rows).select(array_to_vector("v").alias("features"))
        model = KMeans(k=cells, seed=seed, initMode="random", maxIter=8).fit(sample)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        spark = vectors.sparkSession
        spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(f"{path}/centres")
        return cls(path, vectors.schema[id_col].dataType.simpleString())

    def centres(self, spark: SparkSession) -> np.ndarray:
        """One row per cell: as many as the index was made with."""
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows])

    def add(self, vectors: DataFrame, batch: int, id_col: str = "event_id", vector_col: str = "vector") -> None:
        """Index a batch; a repeated batch replaces its own. Null vectors and such of another length
        than the centres are left out."""
        spark = vectors.sparkSession
        centres = self.centres(spark)
        size = centres.shape[1]

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                table = pa.Table.from_batches([part])
                gaps = _gaps(_grid(table["vector"], size), centres)
                cell = gaps.argmin(axis=1) if len(gaps) else np.zeros(0, int)
                far = gaps[np.arange(len(gaps)), cell]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*part.schema.names, "cell", "gap"]
                )

        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        rows = rows.where((F.size("vector") == size) & F.forall("vector", lambda v: v.isNotNull()))
        placed = rows.mapInArrow(nearest, f"id {self.id_type}, vector array<float>, cell int, gap double")
        files.replace_partitions(placed.withColumn("batch", F.lit(str(batch))), f"{self.path}/cells", ("cell", "batch"))

    def _vectors(self, spark: SparkSession) -> DataFrame:
        schema = f"id {self.id_type}, vector array<float>, gap double, cell int, batch string"
        return spark.read.schema(schema).parquet(f"{self.path}/cells")

    def cells(self, spark: SparkSession) -> DataFrame:
        """(cell, n, radius): as many rows as the index has cells with vectors."""
        return self._vectors(spark).groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))

    def _meet(self, probes: DataFrame, k: int, size: int, skip_same: bool) -> DataFrame:
        """Nearest vectors of (query_id, vector, cell) rows, each query against its cells."""
        spark = probes.sparkSession
        asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q_blocks"))
        sizes = self.cells(spark).join(asked, "cell").select(
            "cell", F.ceil(F.col("n") / BLOCK_VECTORS).cast("int").alias("v_blocks"), "q_blocks"
        )
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        left = probes.join(sizes, "cell").select(
            "cell", dealt("query_id", "q_blocks").alias("q"), each("v_blocks").alias("v"), "query_id", "vector"
        )
        right = self._vectors(spark).join(sizes, "cell").select(
            "cell", each("q_blocks").alias("q"), dealt("id", "v_blocks").alias("v"), "id", "vector"
        )
        right = right.toDF(*right.columns)
        kind = dict(probes.dtypes)["query_id"]
        key = ["cell", "q", "v"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            _block(size, k, skip_same), f"query_id {kind}, id {self.id_type}, distance double"
        )
        return self._best(found, k)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        nearest = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    def search(
        self, queries: DataFrame, k: int = TOP_K, nprobe: int = 8, exact: bool = False, scratch: str | None = None,
        skip_same: bool = True,
    ) -> DataFrame:
        """(query_id, id, distance, rank) for each row (query_id, vector) of ``queries``.

        The nearest ``nprobe`` cells are probed. With ``exact``, first results are written to
        ``scratch``, and every further cell that could hold something nearer is probed too.
        ``skip_same`` leaves out the vector whose id is the query's. Distinct query ids are expected;
        queries of another length than the centres have no rows.
        """
        spark = queries.sparkSession
        centres = self.centres(spark)
        size = centres.shape[1]
        kind = dict(queries.dtypes)["query_id"]
        rows = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where(
            (F.size("vector") == size) & F.forall("vector", lambda v: v.isNotNull())
        )
        radius = {r["cell"]: r["radius"] for r in self.cells(spark).collect()}
        held = np.array([radius.get(c, -np.inf) for c in range(len(centres))])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                gaps = np.where(np.isneginf(held), np.inf, _gaps(_grid(pa.Table.from_batches([part])["vector"], size), centres))
                order = np.argsort(gaps, axis=1, kind="stable")
                first = np.zeros(gaps.shape, bool)
                np.put_along_axis(first, order[:, :nprobe], True, axis=1)
                # The least distance that anything in the cell can have.
                least = np.maximum(gaps - np.where(np.isneginf(held), 0, held), 0)
                row, cell = np.nonzero(np.isfinite(gaps) & (first | exact))
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(pa.array(row)) for c in part.columns], pa.array(cell, pa.int32()), pa.array(first[row, cell]), pa.array(least[row, cell])],
                    [*part.schema.names, "cell", "first", "least"],
                )

        probes = rows.mapInArrow(probe, f"query_id {kind}, vector array<float>, cell int, first boolean, least double")
        near = self._meet(probes.where("first").select("query_id", "vector", "cell"), k, size, skip_same)
        if not exact:
            return near.select("query_id", "id", "distance", "rank")
        near.drop("rank").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(scratch)
        first = spark.read.schema(f"query_id {kind}, id {self.id_type}, distance double").parquet(scratch)
        bound = first.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("bound")
        )
        more = probes.where("not first").join(bound, "query_id", "left").where(
            F.col("least") * (1 - SLACK) <= F.coalesce("bound", F.lit(float("inf"))) + SLACK
        )
        rest = self._meet(more.select("query_id", "vector", "cell"), k, size, skip_same).drop("rank")
        return self._best(first.unionByName(rest), k).select("query_id", "id", "distance", "rank")
