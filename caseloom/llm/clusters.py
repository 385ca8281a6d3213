"""Centroid clustering in whole numbers, each vector assigned by a bisector tournament.

A component x counts as floor(64 * x).  For two centroids a < b the points as
near to a as to b lie on a hyperplane: with the normal 2 * (b - a) and the
threshold |b|^2 - |a|^2, a vector v is nearer to b exactly when v . normal
exceeds the threshold, and zero difference favours the smaller number.  Normals
and thresholds of all pairs are precomputed for a round; a vector then meets the
centroids in their order, one sign test each, and the loser drops out, so k - 1
tests name the nearest.  Only the winner's distance is computed, exactly.

The first centroids are the vectors with the smallest sha256 of ``1:<id>``.  A
round sends k sums per task, which Spark adds up; the driver sees k centroids.

Defined cases: vectors of another length, null vectors and vectors with a null or
non-finite component are left out; a null id hashes as empty; of equal ids the
vector with the smaller components comes first as a centroid; repeated rows
count each; fewer vectors than clusters give as many clusters as vectors; an
empty table gives an empty result; other columns are left out.  Whole numbers
are clamped at 2^62, and a distance or sum beyond a long is the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import land, table

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Below this bound every product and sum of the tests fits 64 bits; beyond it Python's integers are used.
SAFE = 1 << 27
CLAMP, LARGEST = 1 << 62, (1 << 63) - 1
#: Vectors tested together.
STEP = 4096


def whole_numbers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * float(scale)), -float(CLAMP), float(CLAMP)).astype(np.int64)


class Tournament:
    """Pairwise bisectors of centroids (k x d whole numbers)."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.narrow = all(abs(x) < SAFE for c in centroids for x in c)
        self.tables = {dtype: self._bisectors(dtype) for dtype in ([np.int64, object] if self.narrow else [object])}

    def _bisectors(self, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = np.array(self.centroids, dtype=dtype)
        square = (c * c).sum(axis=1)
        return c, 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(cluster, squared distance) of each row of ``v``."""
        dtype = np.int64 if self.narrow and (not v.size or np.abs(v).max() < SAFE) else object
        c, normal, threshold = self.tables[dtype]
        clusters, distances = [], []
        for at in range(0, len(v), STEP):
            some = v[at : at + STEP].astype(dtype)
            best = np.zeros(len(some), np.int64)
            for other in range(1, len(c)):
                beyond = (some * normal[best, other]).sum(axis=1) > threshold[best, other]
                best[beyond] = other
            apart = some - c[best]
            clusters.append(best)
            distances += [min(int(d), LARGEST) for d in (apart * apart).sum(axis=1)]
        return np.concatenate(clusters) if clusters else np.zeros(0, np.int64), distances


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of ``dim`` finite components, as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).filter((F.size(v) == dim) & finite)


def first_key(id_col: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)


def _rows(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    return whole_numbers(batch.column("v").flatten().to_numpy().reshape(-1, dim), scale)


def round_sums(kept: DataFrame, centroids: list[list[int]], dim: int, scale: int) -> dict[int, list[int]]:
    """New centroids of the non-empty clusters."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game, k = Tournament(centroids), len(centroids)
        total, count = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            v = _rows(batch, dim, scale)
            cluster, _ = game.nearest(v)
            small = not v.size or np.abs(v).max() < SAFE
            for c in np.unique(cluster):
                mine = v[cluster == c]
                total[c] += (mine if small else mine.astype(object)).sum(axis=0).astype(object)
                count[c] += len(mine)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(some, dim), pa.int32()), "dim": pa.array(np.tile(np.arange(dim), len(some)), pa.int32()),
            "total": pa.array([Decimal(int(x)) for c in some for x in total[c]], pa.decimal128(38, 0)),
            "n": pa.array(np.repeat(count[some], dim), pa.int64()),
        })

    parts = kept.select("v").mapInArrow(sums, "cluster int, dim int, total decimal(38,0), n long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k x dim rows
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], [0] * dim)[r["dim"]] = int(r["total"]) // r["n"]
    return found


def fit(kept: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over vectors (id, v)."""
    first = kept.orderBy(first_key(F.col("id")), "v").limit(clusters).collect()
    centroids = [whole_numbers(np.array(r["v"], float), scale).tolist() for r in first]
    for _ in range(rounds if centroids else 0):
        moved = round_sums(kept, centroids, dim, scale)
        centroids = [moved.get(i, c) for i, c in enumerate(centroids)]
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance) of every vector (id, v)."""
    kind = kept.schema["id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        game = Tournament(centroids)
        for batch in batches:
            cluster, distance = game.nearest(_rows(batch, dim, scale))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"]
            )

    return kept.mapInArrow(nearest, f"id {kind}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector."""
    kept = usable(vectors, id_col, vector_col, dim)
    centroids = fit(kept, dim, clusters, rounds, scale)
    placed = land(assign(kept, centroids, dim, scale), "clusters")
    within = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    everything = min(sum(within.values()), LARGEST)
    facts = [
        (i, min(within.get(i, 0), LARGEST), everything, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids)
    ]
    of = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(of), "cluster").select(  # one row per cluster
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def sql(dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same result by comparing every vector with every centroid."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v"
        f" FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim} AND len(embedding) = {dim})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM"
        f" (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, b.d AS d, b.c AS c FROM (SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,"
                     f" min({{'d': {square}, 'c': c.c}}) AS b FROM kept k, c{i} c GROUP BY k.r))")
        if i < rounds:
            steps.append(
                f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j),"
                f" m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c),"
                f" c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m{i}.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} ON o.c = m{i}.c)"
            )
    return (
        "WITH " + ", ".join(steps) + f" SELECT a.vec_id, CAST(a.c AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance,"
        f" CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"
    )
