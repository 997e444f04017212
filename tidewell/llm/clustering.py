"""Centroid clustering over integers, with candidates from an annulus of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, spread

#: Scaled components are below this, so that squared distances fit 64 bits.
COMPONENT = 1 << 27


def annulus_nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of integers, and the squared distance; of equal ones the smaller number.

    Centroids are sorted by norm. The one whose norm is next to a vector's gives an upper bound u of its distance; no centroid
    whose norm differs from the vector's by more than u can be as near, so a binary search on both sides finds all that can,
    and these are compared by exact distances. Norms are doubles: the annulus is wider by more than their error, so that
    centroids on its edge are among the candidates.
    """
    norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((np.arange(len(norm)), norm))
    norm = norm[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    right = np.minimum(np.searchsorted(norm, own), len(norm) - 1)
    left = np.maximum(right - 1, 0)
    first = np.where(np.abs(norm[left] - own) < np.abs(norm[right] - own), left, right)

    def squared(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x[rows] - c
        return np.einsum("ij,ij->i", d, d)

    label = order[first]
    best = squared(np.arange(len(x)), centroids[label])
    reach = np.sqrt(best.astype(np.float64))
    reach += 1e-9 * (own + reach) + 1e-6
    low, high = np.searchsorted(norm, own - reach, side="left"), np.searchsorted(norm, own + reach, side="right")
    for k in range(int(low.min(initial=len(norm))), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= k) & (k < high) & (first != k))
        d, number = squared(rows, centroids[order[k]]), order[k]
        nearer = (d < best[rows]) | ((d == best[rows]) & (number < label[rows]))
        best[rows[nearer]], label[rows[nearer]] = d[nearer], number
    return label, best


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: number and sum by cluster."""
    n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            label, _ = annulus_nearest(x, centroids)
            n += np.bincount(label, minlength=len(n))
            for k in np.unique(label):
                total[k] += x[label == k].sum(axis=0)
    some = np.flatnonzero(n)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])


def _labels(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            label, distance = annulus_nearest(_matrix(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(label, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])


def integer_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id and v, the components as floor(scale * x)."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double") * scale)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < COMPONENT))
    rows = vectors.filter((F.size("embedding") == dimensions) & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e).cast("int")).alias("v"))


def cluster(vectors: DataFrame, *, clusters: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Vectors of `vectors` (vec_id, embedding) are kept if they have exactly `dimensions` components, none null or non-finite; so
    are they not if a scaled component is COMPONENT or more, whose distances would not fit a long. Components become
    floor(scale * x). Centroids start as the `clusters` vectors with the smallest sha256 of "seed:vec_id" (fewer, if fewer
    are kept); each round assigns all vectors and replaces every centroid that has some by the floor of their mean. Then all are
    assigned once more. Equal distances go to the smaller number. Repeated rows count each; a vector without a vec_id is
    clustered, but no first centroid; of equal vec_ids the one with the smaller components starts first. No rows give no
    rows; other columns are ignored.

    Vectors are written once as integers. A round is one pass in which a task adds up its vectors by cluster, and one
    aggregate of clusters * dimensions rows; the driver holds the centroids alone.
    """
    spark = vectors.sparkSession
    kept = keep(integer_vectors(spread(vectors), dimensions, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").orderBy(key, "v").limit(clusters).collect()
    if not first:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").filter("false")
    centroids = np.array([r.v for r in first], dtype=np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, total array<long>")
        sums = sums.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in sums.collect():
            centroids[r.cluster, r.pos] = int(r.s) // r.n
    labelled = keep(kept.mapInArrow(partial(_labels, centroids=centroids), "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, s, sum(inertia.values()), digest[k]) for k, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labelled.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """One assignment and one replacement of centroids a round, written out."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, min_by(c, d * {clusters} + c) AS cluster, min(d) AS distance FROM (SELECT vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id, v)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dimensions})) AS pos FROM a{r}) GROUP BY 1, 2)")
            steps.append(f"n{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS m FROM s{r} GROUP BY 1)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN n{r} n ON n.cluster = o.c)")
    last = "SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256"
    return "WITH " + ",\n".join(steps) + f"\n{last} FROM a{rounds} JOIN c{rounds} ON c = cluster"
