"""Similar events: exact nearest vectors, and hashing buckets. ``vector_index`` holds a stored index."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.columns import canonical_params

EMBEDDING_DIM = 384
TOP_K = 10

# The placeholder embedding's byte and position factors.
BYTE_FACTOR = 0.00784
POSITION_FACTOR = 0.001


def event_text(params: Column | None = None) -> Column:
    """The text an event is embedded by."""
    return F.format_string(
        "event_type:%s ip:%s user_agent:%s params:%s",
        "event_type", "ip", "user_agent",
        canonical_params(F.col("params")) if params is None else params,
    )


#: Texts embedded at once: a worker's memory hangs on this and not on the Arrow batch.
EMBEDDED_AT_ONCE = 512


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _embed(texts: pa.Array) -> pa.Array:
    """A matrix of each text's bytes, repeated to 384 places, a slice of the Arrow batch at a time."""
    data = [t.encode() if t else b"" for t in texts.to_pylist()]
    sizes = np.fromiter((len(d) for d in data), dtype=np.int64, count=len(data))
    starts = np.r_[0, np.cumsum(sizes)[:-1]] if len(data) else sizes
    kept = np.flatnonzero(sizes)
    places = np.arange(EMBEDDING_DIM)
    letters = np.frombuffer(b"".join(data), dtype=np.uint8)
    vectors = np.empty((len(kept), EMBEDDING_DIM), np.float32)
    for at in range(0, len(kept), EMBEDDED_AT_ONCE):
        some = kept[at : at + EMBEDDED_AT_ONCE]
        grid = letters[starts[some, None] + places % sizes[some, None]].astype(np.float64)
        v = np.sin(grid * BYTE_FACTOR + places * POSITION_FACTOR)
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), np.finfo(np.float32).tiny)[:, None]
        vectors[at : at + len(some)] = v
    ends = np.r_[0, np.cumsum(np.where(sizes > 0, EMBEDDING_DIM, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()), mask=pa.array(sizes == 0))


def embedding(text: Column) -> Column:
    """Deterministic 384-dimension unit vector of a text's bytes; NULL for empty text."""
    return _embed(text)


def vector_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the vector table; events with an empty text have no vector."""
    return (
        events.select("event_id", "tenant_id", "event_type", "timestamp_ms", event_text().alias("text"))
        # Only an empty text has no vector; asked of the vector, each text would be embedded twice.
        .where("text <> ''")
        .withColumn("vector", embedding(F.col("text")))
    )


def l2_squared(vector: Column, query: list[float]) -> Column:
    """Squared distance to a fixed vector; one of another length, or with a null, has none (NULL)."""
    wanted = F.lit([float(x) for x in query])
    gaps = F.zip_with(vector, wanted, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.when(F.size(vector) == len(query), F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap))


def similar_exact(
    vectors: DataFrame, query: list[float], tenant: str | None = None, k: int = TOP_K,
    id_col: str = "event_id", vector_col: str = "vector",
) -> DataFrame:
    """The ``k`` nearest vectors of a tenant by L2 distance. Each task keeps its own ``k``."""
    if tenant is not None:
        vectors = vectors.where(F.col("tenant_id") == tenant)
    return (
        vectors.withColumn("distance", F.sqrt(l2_squared(F.col(vector_col), query)))
        .where("distance is not null")
        .drop(vector_col)
        .orderBy("distance", id_col)
        .limit(k)
    )


# --- approximate ------------------------------------------------------------------------


def similar_lsh(
    vectors: DataFrame, query: list[float], tenant: str | None = None, k: int = TOP_K,
    id_col: str = "event_id", vector_col: str = "vector", bucket: float = 0.5, tables: int = 8,
    seed: int = 7,
) -> DataFrame:
    """The nearest vectors by random projections, none lost.

    Rows that share a bucket with the query bound the k-th distance. A projection on a unit vector
    never stretches a distance, so whatever lies within that bound differs in each table by no
    more buckets than the bound spans; those rows, and no others, are compared exactly. Where
    fewer than ``k`` rows share a bucket, all are.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    if tenant is not None:
        vectors = vectors.where(F.col("tenant_id") == tenant)
    vectors = vectors.where((F.size(vector_col) == len(query)) & F.forall(vector_col, lambda v: v.isNotNull()))
    hasher = BucketedRandomProjectionLSH(
        inputCol="_features", outputCol="_hashes", bucketLength=bucket, numHashTables=tables, seed=seed
    )
    spark = vectors.sparkSession
    features = vectors.withColumn("_features", array_to_vector(vector_col))
    model = hasher.fit(spark.createDataFrame([(Vectors.dense(query),)], ["_features"]))
    probe = spark.createDataFrame([(Vectors.dense(query),)], ["_features"])
    hashes = [float(h[0]) for h in model.transform(probe).head()["_hashes"]]
    hashed = model.transform(features)
    apart = [F.abs(vector_to_array(F.col("_hashes")[i])[0] - h) for i, h in enumerate(hashes)]
    shared = reduce(lambda a, b: a | b, [gap == 0 for gap in apart])
    near = similar_exact(hashed.where(shared).drop("_features", "_hashes"), query, None, k, id_col, vector_col)
    found, bound = near.agg(F.count("*"), F.max("distance")).head()
    if found < k:
        return similar_exact(vectors, query, None, k, id_col, vector_col)
    within = reduce(lambda a, b: a & b, [gap <= bound / bucket + 1 for gap in apart])
    return similar_exact(hashed.where(within).drop("_features", "_hashes"), query, None, k, id_col, vector_col)
