"""Exact k-means over integer vectors, with bounds and a ball search that shrinks as it finds closer centroids.

Each vector carries its centroid, the second nearest of its last search, an upper
bound of the distance to the first and a lower bound of that to all others. After
centroids moved, bounds widen by the moves; where they still part, the vector
keeps its centroid without any distance. Otherwise the distances to both
remembered centroids are taken, the closer of them is the start, and the other
centroids are met in the order of their distance from the start. The search ends
where that distance exceeds the vector's distance to the start plus that to the
second nearest so far, which shrinks with every closer centroid. What the ball
leaves is compared by squared distances in integers, ties by the smaller number.

Kept are vectors with exactly `dims` components, none null, NaN or infinite. A
component x becomes floor(scale * x). Integers of 2^27 or more are an error,
since squared distances would leave 64 bits. Centroids start as the vectors with
the smallest hashes of `seed:id` (a null id has no hash and comes last; equal
ids by their integers); with fewer vectors there are fewer centroids. Repeated
rows and null ids are vectors like others. An empty table gives an empty result.
Columns other than id and vector are ignored."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, stash, table

LIMIT = 1 << 27
#: Relative allowance for rounding in bounds, far above that of double arithmetic.
SLACK = 1e-9
STATE = ("vec_id long, vector binary, first int, second int, upper double, lower double, "
         "n long, sums array<long>")


def _integers(dims, scale):
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def run(batches):
        for b in cut(batches, None, rows=4096):
            x = np.floor(scale * b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            if (np.abs(x) >= LIMIT).any():
                raise ValueError(f"components of {LIMIT / scale:g} or more are too large for exact distances")
            yield table(schema, vec_id=b.column("vec_id"), vector=[r.tobytes() for r in x.astype("<i4")])
    return run


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and little-endian 32-bit integers of the vectors that are kept."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("v").isNotNull() & fine).mapInArrow(_integers(dims, scale), "vec_id long, vector binary")


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Places:
    """What a pass needs to know of the centroids: each one's others, by distance, and how far they moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now, k = now, len(now)
        gaps = np.sqrt(np.stack([squared(now, c) for c in now]).astype(float)) if k else np.zeros((0, 0))
        self.gaps = gaps * (1 - SLACK)
        self.near = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (gaps[i, j], j)) for i in range(k)]
        self.moved = None
        if before is not None:
            self.moved = np.sqrt(np.einsum("ij,ij->i", now - before, now - before).astype(float)) * (1 + SLACK)
            # The largest move of any other centroid.
            self.others = np.array([max((m for j, m in enumerate(self.moved) if j != i), default=0) for i in range(k)])


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, places: Places):
    """Nearest and second nearest centroid of each row with their squared distances, from two remembered ones."""
    now = places.now
    a, b = (np.einsum("ij,ij->i", d, d) for d in (x - now[first], x - now[second]))
    swap = (b < a) | ((b == a) & (second < first))
    best, next_ = np.where(swap, second, first), np.where(swap, first, second)
    d_best, d_next = np.where(swap, b, a), np.where(swap, a, b)
    if len(now) == 1:
        return best, best, d_best, d_next
    start, d_start = best.copy(), np.sqrt(d_best.astype(float))
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        for j in places.near[c]:
            # Neighbours come by distance, so a row that the ball leaves out stays out.
            ball = (d_start[rows] + np.sqrt(d_next[rows].astype(float))) * (1 + SLACK)
            rows = rows[places.gaps[c, j] <= ball]
            if not len(rows):
                break
            known = rows[(best[rows] != j) & (next_[rows] != j)]
            d = squared(x[known], now[j])
            nearer = (d < d_best[known]) | ((d == d_best[known]) & (j < best[known]))
            between = ~nearer & ((d < d_next[known]) | ((d == d_next[known]) & (j < next_[known])))
            up, mid = known[nearer], known[between]
            next_[up], d_next[up] = best[up], d_best[up]
            best[up], d_best[up] = j, d[nearer]
            next_[mid], d_next[mid] = j, d[between]
    return best, next_, d_best, d_next


def step(x: np.ndarray, first, second, upper, lower, places: Places):
    """One assignment of a batch; rows whose bounds part are not touched."""
    k = len(places.now)
    if places.moved is None:
        first, second = np.zeros(len(x), np.int32), np.full(len(x), min(1, k - 1), np.int32)
        open_ = np.arange(len(x))
        upper, lower = np.zeros(len(x)), np.zeros(len(x))
    else:
        first, second = first.copy(), second.copy()
        upper, lower = upper + places.moved[first], lower - places.others[first]
        open_ = np.flatnonzero(upper >= lower)
        # The upper bound made exact settles some more.
        exact = np.sqrt(np.einsum("ij,ij->i", *[x[open_] - places.now[first[open_]]] * 2).astype(float)) * (1 + SLACK)
        upper[open_] = exact
        open_ = open_[exact >= lower[open_]]
    if len(open_):
        p, q, dp, dq = search(x[open_], first[open_], second[open_], places)
        first[open_], second[open_] = p, q
        upper[open_] = np.sqrt(dp.astype(float)) * (1 + SLACK)
        lower[open_] = np.sqrt(dq.astype(float)) * (1 - SLACK) if k > 1 else np.inf
    return first, second, upper, lower


def _matrix(column, dims):
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _columns(b, places):
    if places.moved is None:
        return [None] * 4
    return [b.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "upper", "lower")]


def _assign(places, dims):
    """State rows of all vectors, and at the end of a task one row with count and sums for each centroid."""
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary()), ("first", pa.int32()), ("second", pa.int32()),
                        ("upper", pa.float64()), ("lower", pa.float64()), ("n", pa.int64()),
                        ("sums", pa.list_(pa.int64()))])

    def run(batches):
        at = places.value
        k = len(at.now)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in cut(batches, None, rows=4096):
            x = _matrix(b.column("vector"), dims)
            first, second, upper, lower = step(x, *_columns(b, at), at)
            for c in np.unique(first):
                inside = first == c
                n[c] += inside.sum()
                sums[c] += x[inside].sum(axis=0)
            none = pa.nulls(len(x), pa.int64())
            yield table(schema, vec_id=b.column("vec_id"), vector=b.column("vector"), first=first, second=second,
                        upper=upper, lower=lower, n=none, sums=pa.nulls(len(x), pa.list_(pa.int64())))
        some = np.flatnonzero(n)
        null = [None] * len(some)
        yield table(schema, vec_id=null, vector=null, first=some.astype(np.int32), second=null, upper=null, lower=null,
                    n=n[some], sums=sums[some].tolist())
    return run


def _final(places, dims):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        at = places.value
        for b in cut(batches, None, rows=4096):
            x = _matrix(b.column("vector"), dims)
            first = step(x, *_columns(b, at), at)[0]
            d = x - at.now[first]
            yield table(schema, vec_id=b.column("vec_id"), cluster=first.astype(np.int32),
                        distance=np.einsum("ij,ij->i", d, d))
    return run


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (integers) for every kept vector.

    A round writes the vectors with their bounds once and drops the table of the
    round before; only k sums a task leave the executors, and only k centroids
    reach the driver."""
    spark = vectors.sparkSession
    state = stash(integer_vectors(vectors, dims, scale, id_col, vector_col), "vectors")
    start = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(),
                          "vector").limit(k).select("vector").collect()
    now = np.array([np.frombuffer(r[0], "<i4") for r in start], np.int64).reshape(-1, dims)
    places = Places(now)
    for _ in range(rounds if len(now) else 0):
        shared = spark.sparkContext.broadcast(places)
        done = stash(state.mapInArrow(_assign(shared, dims), STATE), "assigned")
        release(state)
        sums = done.filter("n IS NOT NULL").select("first", "n", F.posexplode("sums").alias("i", "s")).groupBy(
            "first", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        moved = now.copy()
        for r in sums.collect():  # at most k times dims rows
            moved[r["first"], r["i"]] = int(r["s"]) // r["n"]
        shared.destroy()
        places, now = Places(moved, now), moved
        state = done.filter("n IS NULL")
        state.stash_path = done.stash_path
    shared = spark.sparkContext.broadcast(places)
    found = stash(state.mapInArrow(_final(shared, dims), "vec_id long, cluster int, distance long"), "clusters")
    release(state)
    shared.destroy()
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    total = sum(r["s"] for r in sums)
    # One row per centroid, so its bound is k.
    known = spark.createDataFrame([(r["cluster"], r["s"], total, now[r["cluster"]].tolist()) for r in sums],
                                  "_c int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), F.col("cluster") == F.col("_c")).drop("_c")


def centroid_digest(centroid):
    """Lower-case hex digest of a centroid's integers in decimal, joined by commas."""
    return F.sha2(F.concat_ws(",", F.transform(centroid, lambda x: x.cast("string"))), 256)
