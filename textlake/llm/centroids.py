"""Operator 13, centroid clustering with an incremental distance matrix in whole numbers.

A vector's components become whole numbers, and the squared distance to a centroid is
``x.x - 2 x.c + c.c``.  The dot products with all centroids are stored with each vector as exact 64-bit
numbers; a round adds, for each centroid, only the components that changed, times their change, and
takes the argmin again.  Rounds are written, so a lost executor costs a re-read of one round.

Centroids follow from sums by cluster.  Only vectors that moved enter them after the first round: they
leave one cluster's sum and enter another's.  The driver sees k rows of sums a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm.common import discard, free_name, materialize, table

DIM, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Whole components lie in [-LIMIT, LIMIT], so a squared distance in 64 components fits 64 bits.
LIMIT = 1 << 27
_STATE = "id long, x array<int>, dots array<long>, cluster int, was int, distance long"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, x array<int>): vectors of ``dim`` finite components, each floor(scale * component)."""
    v = F.col(vec_col)
    good = (F.size(v) == dim) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = lambda e: F.least(F.greatest(F.floor(e.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("x"))


def _assign(delta: np.ndarray, squares: np.ndarray):
    """Adds ``delta`` [k, dim], the change of each centroid, to the stored dot products, and assigns."""
    moved = [np.flatnonzero(d) for d in delta]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(n, -1)
            dots = batch.column(2).flatten().to_numpy().reshape(n, -1).copy() if batch.num_columns > 2 else np.zeros((n, len(delta)), np.int64)
            for k, at in enumerate(moved):
                if len(at):
                    dots[:, k] += x[:, at].astype(np.int64) @ delta[k, at]
            far = squares - 2 * dots
            cluster = far.argmin(axis=1)  # of equal distances the smaller number
            distance = np.einsum("ij,ij->i", x, x, dtype=np.int64) + far[np.arange(n), cluster]
            was = batch.column(3) if batch.num_columns > 2 else pa.nulls(n, pa.int32())
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x, pa.int32()), lists(dots, pa.int64()), pa.array(cluster, pa.int32()), was, pa.array(distance, pa.int64())], names=["id", "x", "dots", "cluster", "was", "distance"])

    return run


def _sums(state: DataFrame, dim: int, k: int) -> np.ndarray:
    """[k, 1 + dim]: what is to be added to each cluster's count and sums of components."""
    moved = state.where("was is null or cluster <> was").select(F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))).alias("m"), "x")
    sums = [F.sum(F.col("m.sign") * F.get("x", F.lit(j)).cast("long")).alias(f"s{j}") for j in range(dim)]
    out = np.zeros((k, 1 + dim), np.int64)
    for row in moved.where("m.c is not null").groupBy("m.c").agg(F.sum("m.sign").alias("n"), *sums).collect():  # k rows
        out[row[0]] = row[1:]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """A row for each vector kept (id, cluster int, distance long), and the final centroids [k, dim].

    Vectors that are null, of another length, or with null or non-finite components are left out;
    components beyond LIMIT / scale count as that.  The first centroids are the k vectors of the least
    sha256 of ``<salt>:<id>``, null ids last and equal ids by their components; with fewer vectors there
    are fewer centroids.  Of equal distances the smaller centroid wins; a centroid without vectors
    stays.  Repeated ids are vectors of their own.  An empty table gives an empty one and no centroid.
    """
    start = materialize(whole_vectors(vectors, id_col, vec_col, dim, scale), "vectors")
    first = start.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dim)
    state, delta, totals = start, centroids, np.zeros((len(first), 1 + dim), np.int64)
    for turn in range(rounds + 1 if len(first) else 0):
        squares = (centroids * centroids).sum(axis=1)
        known = state.select("id", "x", "dots", "cluster") if turn else state
        new = materialize(known.mapInArrow(_assign(delta, squares), _STATE), f"round{turn}")
        discard(state)
        state = new
        if turn < rounds:
            totals += _sums(state, dim, len(first))
            full = totals[:, 0] > 0
            delta = np.zeros_like(centroids)
            delta[full] = totals[full, 1:] // totals[full, :1] - centroids[full]
            centroids = centroids + delta
    if not len(first):
        return start.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    return state.select(F.col("id").alias(id_col), "cluster", "distance"), centroids


def described(clusters: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clusters`` with cluster_inertia, inertia (long) and centroid_sha256; k rows are broadcast."""
    inertia = {r[0]: r[1] for r in clusters.groupBy("cluster").agg(F.sum("distance")).collect()}
    hashed = [sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = free_name(clusters, "_of")
    rows = [(c, x, sum(inertia.values()), hashed[c]) for c, x in sorted(inertia.items())]
    about = clusters.sparkSession.createDataFrame(rows, f"{of} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clusters.join(F.broadcast(about), F.col("cluster") == F.col(of)).drop(of)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    far = "CAST(list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT)"
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x AS c FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {CLUSTERS})),"""
    for t in range(ROUNDS + 1):
        out += f"""
a{t} AS MATERIALIZED (SELECT r, vec_id, x, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (SELECT r, vec_id, x, k, {far} AS d FROM v, c{t}) GROUP BY r, vec_id, x),"""
        if t < ROUNDS:
            sums = ", ".join(f"CAST(floor(CAST(sum(x[{j}]) AS BIGINT) / count(*)) AS BIGINT)" for j in range(1, DIM + 1))
            out += f"""
c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(m, c) AS c FROM c{t} LEFT JOIN (SELECT k, [{sums}] AS m FROM a{t} GROUP BY k) USING (k)),"""
    return out + f"""
i AS (SELECT k, CAST(sum(d) AS BIGINT) AS own FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, own AS cluster_inertia, CAST((SELECT sum(d) FROM a{ROUNDS}) AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN i USING (k) JOIN c{ROUNDS} USING (k)"""


OP13_SQL = _sql()
