"""Delta Lloyd: k-means whose rounds look only at what has changed.

Assignments, distances and the sums of every cluster are kept between rounds.  A
vector whose own centroid stood still is compared with the centroids that moved
only; a vector whose own centroid moved is compared with all.  The sums are never
made anew: vectors that change their owner are taken from the old owner's sum and
added to the new one's, as signed integers, so that all sums stay exact.

Null, short, long or non-finite vectors are left out; null and repeated ids are rows
like others (a null id is never a first centroid before all others; of equal hashes
the smaller vector comes first).  Components beyond +-2^27 count as +-2^27, as a
distance must fit a long.  Fewer vectors than clusters give fewer clusters, no
vectors an empty result.  Extra columns are not read; there is no text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwise.llm import _store

SCALE, LIMIT = 1024, 1 << 27
#: Vectors compared at once inside a task.
BLOCK = 4096

_STATE = "vec_id long, v array<int>, cluster int, distance long"


def scaled(embedding: Column) -> Column:
    """floor(1024 * x) of each component as int, held within +-2^27."""
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return F.transform(embedding, whole)


def kept_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and v (scaled integers) of the vectors of exactly `size` finite
    components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = (F.size("embedding") == size) & F.forall("embedding", finite)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `salt`, a colon and the id."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select("v", by.alias("by")).orderBy(F.col("by").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


@dataclass
class Clustering:
    """assigned: vec_id, cluster, distance (a written table, at `path`); the final
    centroids; moved: how many vectors changed their owner in each round; compared:
    how many distances each round took."""

    assigned: DataFrame
    path: str
    centroids: np.ndarray
    moved: list[int]
    compared: list[int]


def _vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.int64)


def _nearest(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owner and distance of each vector.  `distance` is that to the owner where
    the owner has not changed; ties go to the smaller number."""
    cluster, distance = cluster.copy(), distance.copy()
    owner_changed = (cluster < 0) | changed[np.maximum(cluster, 0)]
    compared = 0
    for rows, against in ((np.flatnonzero(owner_changed), np.arange(len(centroids))), (np.flatnonzero(~owner_changed), np.flatnonzero(changed))):
        best, to = (cluster[rows], distance[rows]) if len(against) < len(centroids) else (np.full(len(rows), len(centroids), np.int32), np.full(len(rows), np.iinfo(np.int64).max))
        for c in against if len(rows) else ():
            d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
            nearer = (d < to) | ((d == to) & (c < best))
            best, to = np.where(nearer, c, best).astype(np.int32), np.where(nearer, d, to)
            compared += len(rows)
        cluster[rows], distance[rows] = best, to
    return cluster, distance, compared


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state after one assignment, with the owner before."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                was = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int32)
                cluster, distance, n = _nearest(_vectors(batch, "v"), was, batch.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
                compared = np.zeros(batch.num_rows, np.int64)
                compared[:1] = n
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(distance), pa.array(was), pa.array(compared)], names=["vec_id", "v", "cluster", "distance", "was", "compared"])

    return state.mapInArrow(step, _STATE + ", was int, compared long")


def _transfers(moved: DataFrame, k: int) -> DataFrame:
    """Per cluster the signed sums and count that the moved vectors bring, one row
    for each partition and cluster."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, to = _vectors(batch, "v"), batch.column("cluster").to_numpy(zero_copy_only=False)
            came = batch.column("was").to_numpy(zero_copy_only=False)
            sums = np.zeros((k, v.shape[1]), np.int64) if sums is None else sums
            np.add.at(sums, to, v)
            np.add.at(counts, to, 1)
            old = came >= 0
            np.subtract.at(sums, came[old], v[old])
            np.subtract.at(counts, came[old], 1)
        if sums is not None:
            used = np.flatnonzero(sums.any(axis=1) | (counts != 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(sums[used]), pa.list_(pa.int64())), pa.array(counts[used])], names=["cluster", "sums", "n"])

    return moved.select("v", "cluster", "was").mapInArrow(step, "cluster int, sums array<long>, n long")


def delta_lloyd(kept: DataFrame, centroids: np.ndarray, rounds: int) -> Clustering:
    """`rounds` rounds of assignment and exact floor(sum / count), then a last
    assignment, over `kept(vec_id, v)`.  Each round reads the state once, writes it
    once and sends one row for each partition and cluster that vectors left or
    joined; rounds that change nothing end the search, as all later ones would."""
    spark, k = kept.sparkSession, len(centroids)
    sums, counts = np.zeros(centroids.shape, dtype=object), np.zeros(k, dtype=object)
    state, path = _store.written(kept.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")), "vectors")
    changed, moves, compared = np.ones(k, dtype=bool), [], []
    for turn in range(rounds + 1):
        after, fresh = _store.written(_assigned(state, centroids, changed), "assigned")
        _store.drop(spark, path)
        path, state = fresh, after
        seen = after.agg(F.sum("compared").alias("compared"), F.count_if(F.col("was") != F.col("cluster")).alias("moved")).first()
        compared.append(seen.compared or 0)
        moves.append(seen.moved)
        if turn == rounds:
            break
        moved = after.where("was <> cluster")
        parts = _transfers(moved, k).select("cluster", "n", F.posexplode("sums").alias("i", "x"))
        totals = parts.groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
        for row in totals:  # k rows for each component
            sums[row.cluster, row.i] += int(row.x)
            if row.i == 0:
                counts[row.cluster] += row.n
        new = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)], dtype=np.int64)
        changed = (new != centroids).any(axis=1)
        centroids = new
        if not changed.any():
            break
    return Clustering(state.select("vec_id", "cluster", "distance"), path, centroids, moves, compared)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 finite components: eight centroids, ten rounds."""
    with _store.arrow_bytes(spark):
        kept = kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
        first = first_centroids(kept, 8, "3")
        if not len(first):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        found = delta_lloyd(kept, first, 10)
    per = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    inertia = {r.cluster: int(r.d) for r in per.collect()}  # a row for each cluster
    long = lambda x: min(x, (1 << 63) - 1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    rows = [(c, long(d), long(sum(inertia.values())), digest[c]) for c, d in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Ten rounds written out; sums of longs are exact."""
    steps = [
        """kept as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        """c0 as materialized (select row_number() over (order by sha256('3:' || vec_id), v) - 1 c, v from (select vec_id, v from kept order by sha256('3:' || vec_id), v limit 8))""",
    ]
    for r in range(11):
        near = f"select vec_id, kept.v, list_aggregate(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')::bigint d, c from kept, c{r}"
        steps.append(f"a{r} as materialized (select vec_id, v, min(d) d, arg_min(c, (d, c)) c from ({near}) group by vec_id, v)")
        if r < 10:
            new = f"select c, list(m order by i) v from (select c, i, floor(sum(x)::hugeint / count(*))::bigint m from (select c, unnest(v) x, generate_subscripts(v, 1) i from a{r}) group by c, i) group by c"
            new = new.replace("floor(sum(x)::hugeint / count(*))::bigint", "(sum(x)::hugeint - ((sum(x)::hugeint % count(*)) + count(*)) % count(*)) // count(*)")
            steps.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(n.v, c{r}.v) v from c{r} left join ({new}) n on n.c = c{r}.c)")
    return "with " + ",\n".join(steps) + """
select vec_id, c::integer as cluster, d as distance, sum(d) over (partition by c)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(c10.v, ',')) centroid_sha256
from a10 join c10 using (c)"""


ORACLE = _oracle()
