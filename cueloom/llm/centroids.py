"""Centroid clustering in exact integers by an incremental distance matrix.

Each vector keeps its exact dot products with all centroids. |x - c|^2 = |x|^2 - 2 x.c + |c|^2, so a round needs the dot products
only, and these change only where a centroid's component did: dot += x[j] * change[j] over the nonzero changes. A round is one
pass over the written state of the round before: it updates the products, takes the nearest centroid and writes the new state.
New centroids come from sums by cluster that tasks add up first; CENTROIDS x DIM numbers reach the driver, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

DIM, CENTROIDS, ROUNDS = 64, 16, 3
#: Components are multiples of 1 / SCALE, rounded down.
SCALE = 64
#: Components saturate here: below, every squared distance fits a long.
MOST = 1 << 27
LONGEST = (1 << 63) - 1

_STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def integers(table: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, x) of (vec_id, embedding): vectors of `dim` components, none null or not finite, as floor(SCALE * component)."""
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter((F.size("v") == dim) & good)
    whole = lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")
    return own.select("vec_id", F.transform("v", whole).alias("x"))


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1), kind))


def _round(state: DataFrame, centres: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """_STATE with products and clusters for `centres`; before: the centres that the products of `state` belong to, None for none."""
    changes = [(k, np.flatnonzero(centres[k] - (0 if before is None else before[k]))) for k in range(len(centres))]
    changes = [(k, at, (centres[k] - (0 if before is None else before[k]))[at]) for k, at in changes if len(at)]
    squares = (centres * centres).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), centres.shape[1], np.int64)
            dots = np.zeros((len(x), len(centres)), np.int64) if before is None else _matrix(batch.column("dots"), len(centres), np.int64)
            for k, at, change in changes:
                dots[:, k] += x[:, at] @ change
            distances = (x * x).sum(1)[:, None] - 2 * dots + squares
            cluster = distances.argmin(1)  # the smaller number of equals
            nearest = distances[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(nearest, pa.int64())], ["vec_id", "x", "dots", "cluster", "distance"]
            )

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, sums): vectors and componentwise sums of each cluster; a task sends a row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((CENTROIDS, dim), object), np.zeros(CENTROIDS, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, cluster = _matrix(batch.column("x"), dim, np.int64), batch.column("cluster").to_numpy()
                for k in np.unique(cluster):
                    sums[k] += x[cluster == k].sum(0)
                    counts[k] += int((cluster == k).sum())
        some = np.flatnonzero(counts)
        columns = [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array([sums[k].tolist() for k in some], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    partial = state.select("x", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    return partial.groupBy("cluster").agg(F.sum("n").alias("n"), *whole)


def cluster(table: DataFrame, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows of (vec_id, embedding).

    Null vectors, other lengths and null or non-finite components are left out; other columns too. Rows that share a vec_id are
    vectors of their own and have a row each; a null vec_id counts as an empty one in the hash and stays null. Ties go to the
    smaller number; equal hashes to the smaller vector. With fewer than CENTROIDS vectors there are as many centroids as vectors;
    an empty table gives no rows. Components saturate at MOST, sums of distances at the largest long; below that all is exact.
    """
    spark = table.sparkSession
    state = textkit.written(integers(table, dim), "vectors")
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("h"), "vec_id", "x").orderBy("h", "x").limit(CENTROIDS).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres, before = np.array([r["x"] for r in first], np.int64), None
    for r in range(rounds + 1):
        older = state
        state = textkit.written(_round(older, centres, before), f"round-{r}")
        textkit.discard(older)
        before = centres
        if r < rounds:
            centres = before.copy()
            for row in _sums(state, dim).collect():  # a row a cluster
                centres[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dim)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    whole = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
    sums = state.groupBy("cluster").agg(whole("distance").alias("s")).collect()  # a row a cluster
    own = {r["cluster"]: int(r["s"]) for r in sums}
    known = spark.createDataFrame([(k, own[k], min(LONGEST, sum(own.values())), digests[k]) for k in sorted(own)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cluster` of the whole table embeddings."""
    return cluster(textkit.table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT"
    steps = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        "v AS (SELECT row_number() OVER () AS r, vec_id, x FROM kept)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < 16)",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS (SELECT v.r, v.vec_id, v.x, min_by(c.k, (d, c.k)) AS k, min(d) AS d FROM (SELECT v.r, v.vec_id, v.x, c.k, {apart} AS d FROM v CROSS JOIN c{n} c) t(r, vec_id, x, k, d) JOIN v ON v.r = t.r JOIN c{n} c ON c.k = t.k GROUP BY v.r, v.vec_id, v.x)")
        if n < ROUNDS:
            steps.append(f"m{n} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) AS m FROM (SELECT k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) g(i) GROUP BY k, i)) GROUP BY k)")
            steps.append(f"c{n + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k)")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"
    )


OP12_SQL = _sql()
