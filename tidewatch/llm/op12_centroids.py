"""Exact Lloyd rounds on integer vectors, with distance bounds that spare most scans.

A vector takes part if it has exactly `dims` components, none null or non-finite; each component x
becomes floor(scale * x). All distances, sums and centroids are integers. A round assigns every
vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and moves
each centroid that has vectors to the componentwise floor of their mean; after the last round
vectors are assigned once more.

What a vector carries from one assignment to the next is its cluster, an upper bound u of the
distance to its own centroid and a lower bound l of the distance to any other. When the centroids
move, u grows by the own centroid's drift. l need not shrink by the largest drift of the others:
all vectors of cluster i lie in the sphere around its old centroid with radius max u, and for a
centroid that moves from a to b the difference |x - a| - |x - b| over a sphere is bounded in the
plane of a, b and the sphere's centre (`sphere_drift`). While u < l the assignment stands without
a look at the vector; else u is made exact, and what is still ambiguous is scanned against all
centroids in integers.

Bounds and clusters are written after each assignment, the vectors packed as the narrowest integers
they fit. Sums are kept as totals to which only the vectors that changed their cluster are added.
A cluster's sphere, sums and centroid are `k` rows whatever the table; only these reach the driver.

Null vectors and those of other lengths are left out, as are vectors with an integer beyond
2 ** 27 in size, whose squared distances need more than 64 bits. Repeated rows and ids are vectors of
their own; a null id counts as the empty string when centroids are chosen, equal digests go by
the vector. Fewer vectors than `k` give as many centroids; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.registry import register
from tidewatch.session import cut_lineage

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Largest component whose squared distances fit 64 bits, and whose products are exact in doubles.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Bounds give way by this share, more than the rounding errors of doubles.
SLACK = 1e-9
#: Vectors that are unpacked at a time.
ROWS = 4096


def packed(vectors: np.ndarray) -> pa.Array:
    """Each row as little-endian integers of 1, 2 or 4 bytes, the fewest that hold it."""
    high = np.abs(vectors).max(axis=1, initial=0)
    width = np.where(high < 1 << 7, 1, np.where(high < 1 << 15, 2, 4))
    narrow = {w: vectors.astype(f"<i{w}") for w in np.unique(width).tolist()}
    return pa.array([narrow[w][k].tobytes() for k, w in enumerate(width.tolist())], pa.binary())


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(column), dims), dtype=np.int64)
    rows = column.to_pylist()
    width = np.array([len(r) for r in rows], dtype=np.int64) // dims
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(rows[k] for k in at.tolist()), dtype=f"<i{w}").reshape(len(at), dims)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, in doubles where these are exact."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid."""
    v, c = (vectors * vectors).sum(axis=1), (centroids * centroids).sum(axis=1)
    return v[:, None] + c[None, :] - 2 * products(vectors, centroids)


def squared_own(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = vectors - centroids[cluster]
    return (gap * gap).sum(axis=1)


def scanned(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower): the nearest centroid, the smaller number among equals, and exact bounds."""
    d = squared(vectors, centroids)
    cluster = d.argmin(axis=1)
    rows = np.arange(len(d))
    near = d[rows, cluster]
    d[rows, cluster] = np.iinfo(np.int64).max
    other = d.min(axis=1, initial=np.iinfo(np.int64).max)
    return cluster, np.sqrt(near.astype(np.float64)), np.where(other == np.iinfo(np.int64).max, np.inf, np.sqrt(other.astype(np.float64)))


def sphere_drift(centre: np.ndarray, radius: float, a: np.ndarray, b: np.ndarray) -> float:
    """An upper bound of |x - a| - |x - b| over all x within `radius` of `centre`.

    On a ray from a the difference rises towards D cos(angle to b - a), with D = |b - a|; so it does
    on a ray from the midpoint that leans towards b, and where the ray leans away it is
    negative. The sphere lies in a cone around the line to its centre whose half angle has the
    sine radius / distance; the least angle in that cone gives the bound.
    """
    d = float(np.linalg.norm(b - a))
    if d == 0:
        return 0.0
    best = d
    for origin, halfway in ((a, False), ((a + b) / 2, True)):
        line = centre - origin
        far = float(np.linalg.norm(line))
        if far <= radius:
            continue  # the sphere holds the origin: no cone
        angle = np.arccos(np.clip(line @ (b - a) / (far * d), -1, 1)) - np.arcsin(min(1.0, radius / far))
        # The angle gives way a little: arc functions are steep near their ends.
        cone = d * float(np.cos(max(0.0, angle - 1e-6)))
        best = min(best, max(cone, 0.0) if halfway else cone)
    return best


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster: its centroid's drift, and by how much the lower bounds of its vectors shrink."""
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    shrink = np.full(len(old), 0.0)
    for i in range(len(old)):
        if not np.isnan(radius[i]):
            r = radius[i] * (1 + SLACK)
            shrink[i] = max((sphere_drift(old[i], r, old[j], new[j]) for j in range(len(old)) if j != i), default=0.0)
    return drift, shrink


def prepared(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, vector) of the vectors that take part, as packed integers."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    usable = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LARGEST))
    given = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), whole.alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([batch.column("id"), packed(flat)], ["id", "vector"])

    return given.mapInArrow(run, given.select("id").schema.add("vector", "binary"))


def first_centroids(rows: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors with the least digests of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(digest, "vector").limit(k).select("vector").collect()
    return unpacked(pa.array([bytes(r["vector"]) for r in found], pa.binary()), dims)


def assigned(rows: DataFrame, centroids: np.ndarray, moves: tuple[np.ndarray, np.ndarray] | None, dims: int, exact: bool = False) -> DataFrame:
    """id, vector, cluster, was (the cluster before), upper, lower; with `exact` a distance too.

    `rows` has them from the last assignment, unless there was none (`moves` is None).
    """
    schema = rows.select("id", "vector").schema
    for name, kind in (("cluster", "integer"), ("was", "integer"), ("upper", "double"), ("lower", "double")):
        schema = schema.add(name, kind)
    if exact:
        schema = schema.add("distance", "long")

    def bounded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cluster, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
        drift, shrink = moves
        upper += drift[cluster] + SLACK * (1 + upper)
        lower -= shrink[cluster] + SLACK * (1 + np.abs(np.where(np.isinf(lower), 0, lower)))
        open_ = np.flatnonzero(upper >= lower)
        if len(open_):
            vectors = unpacked(batch.column("vector").take(pa.array(open_)), dims)
            upper[open_] = np.sqrt(squared_own(vectors, centroids, cluster[open_]).astype(np.float64))
            left = upper[open_] * (1 + SLACK) >= lower[open_]
            open_ = open_[left]
            cluster[open_], upper[open_], lower[open_] = scanned(vectors[left], centroids)
        return cluster, upper, lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                if moves is None:
                    cluster, upper, lower = scanned(unpacked(batch.column("vector"), dims), centroids)
                    was = np.full(len(cluster), -1)
                else:
                    was = batch.column("cluster").to_numpy(zero_copy_only=False)
                    cluster, upper, lower = bounded(batch)
                out = [batch.column("id"), batch.column("vector"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), pa.array(lower)]
                if exact:
                    out.append(pa.array(squared_own(unpacked(batch.column("vector"), dims), centroids, cluster)))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)


def changes(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to each cluster's count and sums.

    Every task sends one row per cluster and component at most; the sums have 128 bits on the way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                vectors = np.concatenate([np.ones((batch.num_rows, 1), dtype=np.int64), unpacked(batch.column("vector"), dims)], axis=1)
                for column, sign in (("cluster", 1), ("was", -1)):
                    cluster = batch.column(column).to_numpy(zero_copy_only=False)
                    for c in np.unique(cluster[cluster >= 0]).tolist():
                        total[c] += sign * vectors[cluster == c].sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], ["place", "n"])

    parts = rows.where("cluster != was").select("vector", "cluster", "was").mapInArrow(run, "place long, n long")
    total = np.zeros(k * (dims + 1), dtype=object)
    for row in parts.groupBy("place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        total[row["place"]] = int(row["n"])
    total = total.reshape(k, dims + 1)
    return total[:, 0], total[:, 1:]


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE,
    k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance (squared) of every vector that takes part; the centroids)."""
    rows = cut_lineage(prepared(vectors, id_col, vector_col, dims, scale), "centroids-vectors")
    centroids = first_centroids(rows, k, dims, seed)
    count, sums = np.zeros(len(centroids), dtype=object), np.zeros((len(centroids), dims), dtype=object)
    moves = None
    for number in range(rounds):
        rows = cut_lineage(assigned(rows, centroids, moves, dims), f"centroids-round-{number}")
        more, add = changes(rows, len(centroids), dims)
        count, sums = count + more, sums + add
        new = centroids.copy()
        for c in range(len(centroids)):
            if count[c]:
                new[c] = [s // count[c] for s in sums[c]]
        radius = np.full(len(centroids), np.nan)
        for row in rows.groupBy("cluster").agg(F.max("upper").alias("radius")).collect():
            radius[row["cluster"]] = row["radius"]
        moves, centroids = loosening(centroids.astype(np.float64), new.astype(np.float64), radius), new
    rows = cut_lineage(assigned(rows, centroids, moves, dims, exact=True).select("id", "cluster", "distance"), "centroids-final")
    return rows.withColumnRenamed("id", id_col), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of the squared distances, per cluster and of all, and the centroid's digest."""
    per = cut_lineage(rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")), "centroids-inertia")  # one row per cluster
    total = per.agg(F.sum("cluster_inertia")).first()[0]
    names = F.array(*(F.lit(digest(c)) for c in centroids)) if len(centroids) else F.array().cast("array<string>")
    known = per.withColumn("inertia", F.lit(total).cast("long")).withColumn("centroid_sha256", F.get(names, F.col("cluster")))
    return rows.join(F.broadcast(known), "cluster")


def rounds_sql(rounds: int) -> str:
    """The rounds one after another: scan all centroids, then floor the means."""
    floor_mean = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS (
    SELECT n, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT n, vec_id, k.q, c, list_sum(list_transform(list_zip(k.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{r} m)
    GROUP BY n, vec_id, q),""")
        if r < rounds:
            out.append(f"""
m{r} AS (
    SELECT c, list(v ORDER BY i) AS q FROM (
        SELECT c, i, {floor_mean} AS v FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (c)),""")
    return "".join(out)


SQL = f"""
WITH kept AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS c, q FROM kept ORDER BY c LIMIT {CLUSTERS}),{rounds_sql(ROUNDS)}
s AS (SELECT c, sum(d) AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, cluster_inertia::BIGINT AS cluster_inertia, (SELECT sum(d) FROM a{ROUNDS})::BIGINT AS inertia,
    sha256(array_to_string(c{ROUNDS}.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN s USING (c) JOIN c{ROUNDS} USING (c)
"""


@register("op12_centroids", SQL)
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(rows, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
