"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that holds all members. After the centroids have moved, a member of cluster i
can only belong to a cluster j whose centroid is nearer than twice the radius: the neighbours of the ball. The halves of the distances to
the neighbours, in ascending order, cut the ball into a stable core and annuli. A member of the core is nearer to its own
centroid than to any other and stays without a comparison; one in the a-th annulus is compared with the a nearest neighbours only.

The radius needs no pass of its own: a member's distance to the moved centroid is at most its distance before the move plus
the move. Annuli are cut by each member's exact distance. All distances are squares of integers, so every test above is exact:
a neighbour at squared distance g is left out for a member at squared distance d only if 4 d < g, which leaves ties in.

One pass per round reads the vectors with their clusters and writes them with the new ones; nothing is shuffled but one
row per cluster and task (counts, sums, radii), so the size of a cluster does not matter. The driver holds k centroids and, for
each, the order of its neighbours: at most MOST_CENTROIDS * MOST_CENTROIDS numbers.

Cases: vectors that are null, of another length, or that have null or non-finite components take no part, nor do those with a component whose
integer is beyond +-MOST (2 to the 26th): squares of their distances need not fit a long. Repeated rows each get their row.
Null ids are kept; they start no centroid unless ids run out. With fewer vectors than k each is a centroid, repeated ones more than once; without any the result is empty.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, through_disk

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SALT = 40, 5, 64, 256, "2:"
MOST = 1 << 26
MOST_CENTROIDS = 4096


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id and v, the components as integers, of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    fits = F.coalesce((F.size(x) == components) & F.forall(x, lambda c: F.coalesce(F.abs(c) * scale < MOST, F.lit(False))), F.lit(False))  # NaN and infinity are not below
    return vectors.where(fits).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = SALT) -> np.ndarray:
    """The k vectors (id, v) with the smallest SHA-256 of salt and id, in that order; ties by the vector."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b, exact."""
    top = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
    if 4 * a.shape[1] * top * top < 1 << 53:  # every sum below is a whole number that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def neighbours(centroids: np.ndarray, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball: the centroids within twice its radius, nearest first, and their squared distances."""
    out = []
    for i, reach in enumerate(radius):
        gap = squares(centroids[i : i + 1], centroids)[0]
        own = np.flatnonzero((gap <= 4.0 * reach * reach * (1 + 1e-9) + 1) & (np.arange(len(gap)) != i))
        own = own[np.argsort(gap[own], kind="stable")]
        out.append((own.astype(np.int32), gap[own]))
    return out


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties: the smaller number), its squared distance, and the number of comparisons."""
    d = squares(v, centroids)
    to = d.argmin(1)
    return to.astype(np.int32), d[np.arange(len(v)), to], d.size


def reassign(v: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """As nearest(), for rows that were members of `cluster` before the centroids moved; only annuli are compared."""
    to, compared = cluster.astype(np.int32), len(v)
    best = ((v - centroids[cluster]) ** 2).sum(1)
    by_cluster = np.argsort(cluster, kind="stable")
    for rows in np.split(by_cluster, np.flatnonzero(np.diff(cluster[by_cluster])) + 1) if len(v) else ():
        i = int(cluster[rows[0]])
        order, gap = near[i]
        annulus = np.searchsorted(gap, 4 * best[rows], "right")  # neighbours that may be as near as the own centroid
        for a in np.unique(annulus[annulus > 0]).tolist():
            own, others = rows[annulus == a], order[:a]
            d = squares(v[own], centroids[others])
            compared += d.size
            least = np.minimum(d.min(1), best[own])
            number = np.where(d == least[:, None], others[None, :], np.iinfo(np.int32).max).min(1)
            to[own] = np.minimum(number, np.where(best[own] == least, i, np.iinfo(np.int32).max))
            best[own] = least
    return to, best, compared


def _assigned(state: DataFrame, centroids: np.ndarray, near: list | None) -> DataFrame:
    """state (id, v, cluster) with the new cluster, the squared distance and the number of comparisons of its batch (in its first row)."""
    schema = state.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("compared")).schema
    sent = state.sparkSession.sparkContext.broadcast((centroids, near))

    def run(batches):
        centroids, near = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            to, d, compared = nearest(v, centroids) if near is None else reassign(v, batch.column("cluster").to_numpy(), centroids, near)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(to, pa.int32()), pa.array(d), pa.array(np.r_[compared, np.zeros(batch.num_rows - 1, np.int64)])], ["id", "v", "cluster", "distance", "compared"])

    return through_disk(state.mapInArrow(run, schema))


def _moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list]:
    """The centroids after floor(sum / count) of their members, and the neighbours of their balls."""
    sums = [F.sum(F.element_at("v", i + 1).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows
        i = r["cluster"]
        new[i] = [r[f"s{j}"] // r["n"] for j in range(centroids.shape[1])]
        radius[i] = math.sqrt(r["far"]) + math.sqrt(float(((new[i] - centroids[i]) ** 2).sum()))
    return new, neighbours(new, radius)


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(id, v, cluster, distance, compared) of every vector that takes part, and the centroids (k rows of integers)."""
    if k > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids")
    state = through_disk(integer_vectors(vectors, id_col, vector_col, components, scale))
    centroids, near = first_centroids(state, k, salt), None
    state = state.withColumn("cluster", F.lit(None).cast("int"))
    if not len(centroids):
        return state.withColumn("distance", F.lit(None).cast("long")).withColumn("compared", F.lit(None).cast("long")), centroids
    for _ in range(rounds):
        state = _assigned(state, centroids, near)
        centroids, near = _moved(state, centroids)
    return _assigned(state, centroids, near), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = ball_kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    inertia = sum(r["cluster_inertia"] for r in each)
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, centroid_digest(centroids[r["cluster"]])) for r in each], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.v, c.v)])::BIGINT"
    out = ["""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)""",
           "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM kept ORDER BY sha256('2:' || vec_id), v LIMIT 40)"]
    for i in range(ROUNDS + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, best[2] AS cluster, best[1] AS distance FROM (SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, min([{distance}, c.cluster]) AS best FROM kept v CROSS JOIN c{i} c GROUP BY r))")
        if i < ROUNDS:
            floor = "(s - mod(mod(s, n) + n, n)) // n"
            out.append(f"m{i} AS MATERIALIZED (SELECT cluster, list({floor} ORDER BY pos) AS v FROM (SELECT cluster, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY cluster, pos) GROUP BY cluster)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)")
    return "WITH " + ",\n".join(out) + f"""
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster"""


ORACLE = _oracle()
