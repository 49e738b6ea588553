"""Centroid clustering on whole numbers, with a kept matrix of dot products that only changed components update."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, table
from palimpsest.llm.registry import query
from palimpsest.session import stage

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Components up to this size keep squared distances of 64 components, and the terms they are made of, within 64 bits.
LARGEST = 1 << 26


def whole_vectors(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of every vector of just so many components, none of them null or not finite.

    Other vectors are left out. A component beyond LARGEST is an error: its distance would not fit a long.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    fits = F.forall(x, lambda c: F.abs(c * scale) < LARGEST)
    whole = F.when(fits, F.transform(x, lambda c: F.floor(c * scale).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>"))
    kept = embeddings.filter((F.size("embedding") == components) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The k vectors of the smallest SHA-256 of ``seed:vec_id`` (a null id is empty), ties by their components."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r[0] for r in vectors.select("v", h.alias("h")).orderBy("h", "v").limit(k).select("v").collect()], np.int64)


def assign(state: DataFrame, before: np.ndarray | None, centroids: np.ndarray) -> DataFrame:
    """vec_id, v, dots, cluster and distance for new ``centroids``.

    ``dots`` are the exact dot products with the centroids ``before`` (none: no products yet). Of each centroid only the
    components that differ from before are multiplied; then the nearest centroid is read from |v|^2 - 2 dot + |c|^2.
    """
    change = centroids if before is None else centroids - before
    changed = [(c, np.flatnonzero(row), row[row != 0]) for c, row in enumerate(change) if row.any()]
    norms, (k, width) = (centroids * centroids).sum(axis=1), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = np.asarray(batch.column(1).flatten(), np.int64).reshape(n, width)
            dots = np.zeros((n, k), np.int64) if before is None else np.array(batch.column(2).flatten(), np.int64).reshape(n, k)
            for c, at, by in changed:
                dots[:, c] += v[:, at] @ by
            far = norms - 2 * dots  # the vector's own norm is the same for all centroids
            nearest = far.argmin(axis=1)  # the smaller number of equals
            distance = far[np.arange(n), nearest] + (v * v).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(dots.reshape(-1))),
                 pa.array(nearest.astype(np.int32)), pa.array(distance)], ["vec_id", "v", "dots", "cluster", "distance"])

    columns = ["vec_id", "v"] + ([] if before is None else ["dots"])
    return state.select(*columns).mapInArrow(run, "vec_id long, v array<int>, dots array<long>, cluster int, distance long")


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster's vectors; a cluster without vectors keeps its centroid.

    Sums are made in the tasks first; what is collected is one row for each cluster, whatever the input's size.
    """
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (vec_id, v) with dots, cluster and distance after ``rounds`` rounds and a last assignment; the last centroids.

    Each round writes vectors and dot products side by side and reads them again: rows never move, repeated ids are rows of
    their own, and a lost executor costs a re-read. There are fewer centroids if there are fewer vectors.
    """
    bound_batches(vectors.sparkSession, 10_000)
    vectors = stage(vectors)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", "v", F.array().cast("array<long>").alias("dots"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = stage(assign(vectors, None, centroids))
    for _ in range(rounds):
        moved = means(state, centroids)
        state, centroids = stage(assign(state, centroids, moved)), moved
    return state, centroids


def clustered_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, of another length, or with a component that is null or not finite are left out; repeated rows
    stay; no vectors give no rows. Other columns of ``embeddings`` are not looked at.
    """
    state, centroids = cluster(whole_vectors(embeddings))
    found = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster")).alias("value")

    return state.select(
        "vec_id", "cluster", "distance",
        of_cluster([found.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(found.values())).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"))


def _oracle() -> str:
    def assigned(k: int) -> str:
        return f"""a{k} as materialized (select rn, arg_min(c, d) as c, min(d) as d from (
          select rn, c, 0::bigint + ((vn - 2 * list_inner_product(v.v, c{k}.v) + list_inner_product(c{k}.v, c{k}.v)) * 1000 + c)::bigint as d
          from v, c{k}) group by rn)"""

    def moved(k: int) -> str:
        return f"""c{k} as materialized (select c{k - 1}.c, coalesce(m.v, c{k - 1}.v) as v from c{k - 1} left join (
          select c, list(((s - ((s % n) + n) % n) // n)::double order by i) as v from (
            select c, i, sum(x)::bigint as s, count(*) as n from (
              select a.c, unnest(v.v)::bigint as x, generate_subscripts(v.v, 1) as i from a{k - 1} a join v using (rn)) group by c, i) group by c) m using (c))"""

    steps = ", ".join(s for k in range(1, ROUNDS + 1) for s in (moved(k), assigned(k)))
    return f"""
with v as materialized (select *, list_inner_product(v, v) as vn from (
  select row_number() over () as rn, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where len(embedding) = {COMPONENTS} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as c, v from v
  order by sha256('{SEED}:' || vec_id), v limit {CLUSTERS}), {assigned(0)}, {steps},
r as (select vec_id, a.c, (a.d - a.c) // 1000 as d from a{ROUNDS} a join v using (rn))
select vec_id, r.c::int as cluster, d as distance, (sum(d) over (partition by r.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(k.v, lambda x: x::bigint), ',')) as centroid_sha256 from r join c{ROUNDS} k on r.c = k.c"""


@query("op12_dot_clusters", _oracle())
def op12_dot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_embeddings(table(spark, sf_dir, "embeddings"))
