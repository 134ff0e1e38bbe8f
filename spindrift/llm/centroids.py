"""Centroid clustering by annulus search, in exact integers.

A component x becomes floor(scale * x). Centroids start as the vectors whose
hashed ids come first; each round assigns every vector to its nearest centroid
(squared Euclidean distance, ties to the smaller number) and moves every
non-empty centroid to the floor of its vectors' mean.

Search: by the triangle inequality a centroid nearer than u has a norm within u
of the vector's. Centroids are sorted by norm; a vector's upper bound u is its
distance to the centroid whose norm is next to its own (binary search), two more
binary searches give the annulus, and its members are compared exactly. The
bounds are widened by more than floating point can err, so that a centroid on
the edge, which may tie, is always a member.

Plan: a round is one scan; each task sends its sums by cluster and component, in
limbs of 40 bits so that Spark's sums of longs are exact, and the driver gets
clusters * (components + 2) sums. Vectors never move and nothing is kept between
rounds; a lost task is run again from the input.

Vectors of another length, null, or with a null or non-finite component are left
out. Null ids hash as the empty text; vectors of equal hash go by components.
Repeated rows are vectors of their own. Fewer vectors than centroids: as many
centroids as vectors. An empty table gives no rows. A distance or sum that
passes 64 bits is null; components of any size are compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

LIMB = 40
LONGEST = (1 << 63) - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly for a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale


@dataclass
class Model:
    """Centroids by number, and what the last assignment sums: vectors and distances by cluster."""

    centroids: list[list[int]]
    scale: int
    counts: list[int]
    inertias: list[int]

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[j])).encode()).hexdigest()


class Annulus:
    """Centroids sorted by norm; ``nearest`` finds each row's centroid and counts comparisons."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.scale, self.compared = scale, 0
        squares = [sum(v * v for v in c) for c in centroids]
        self.order = sorted(range(len(centroids)), key=lambda j: (squares[j], j))
        self.rows = [centroids[j] for j in self.order]
        self.norms = np.array([math.sqrt(squares[j]) for j in self.order])
        self.most = max((abs(v) for c in centroids for v in c), default=0)
        self.number = np.array(self.order)

    def integers(self, x: np.ndarray) -> np.ndarray:
        """The rows as integers: doubles where every distance stays under 2**53, else Python's integers."""
        top = max(float(np.abs(x).max(initial=0)) * self.scale + 1, float(self.most))
        if 4 * x.shape[1] * top * top < 2.0**53:
            return np.floor(x * self.scale)
        return np.array([[whole(v, self.scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) for each row of integers."""
        c = np.array(self.rows, dtype=object).astype(x.dtype)
        cc, xx = (c * c).sum(axis=1), (x * x).sum(axis=1)
        radius = np.sqrt(xx.astype(np.float64))
        at = np.clip(np.searchsorted(self.norms, radius), 1, max(len(c) - 1, 1))
        left = np.minimum(at - 1, len(c) - 1)
        right = np.minimum(at, len(c) - 1)
        pilot = np.where(radius - self.norms[left] <= self.norms[right] - radius, left, right)
        best = xx + cc[pilot] - 2 * (x * c[pilot]).sum(axis=1)
        place = self.number[pilot]
        margin = 1 + 1e-9 * (radius + self.norms[-1])
        bound = np.sqrt(np.maximum(best, 0).astype(np.float64)) + margin
        first, end = np.searchsorted(self.norms, radius - bound, "left"), np.searchsorted(self.norms, radius + bound, "right")
        self.compared += int((end - first).sum())
        for j in range(len(c)):
            rows = np.flatnonzero((first <= j) & (j < end))
            d = xx[rows] + cc[j] - 2 * (x[rows] @ c[j])
            closer = (d < best[rows]) | ((d == best[rows]) & (self.number[j] < place[rows]))
            best[rows[closer]], place[rows[closer]] = d[closer], self.number[j]
        return place, best


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


SUMS = "cluster int, part int, limb int, value bigint"


def _sums(centroids: list[list[int]], scale: int, dims: int):
    """Task function: sums of components (parts 0, 1, ...), of distances (part dims) and of vectors (part dims + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total = Annulus(centroids, scale), defaultdict(int)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = search.integers(_vectors(batch, dims))
            place, best = search.nearest(x)
            for j in np.unique(place):
                mine = place == j
                for part, v in enumerate(x[mine].sum(axis=0)):
                    total[j, part] += int(v)
                total[j, dims] += int(best[mine].sum())
                total[j, dims + 1] += int(mine.sum())
        rows = []
        for (j, part), v in total.items():
            limb = 0
            while v not in (0, -1):
                rows.append((int(j), part, limb, v & ((1 << LIMB) - 1)))
                v, limb = v >> LIMB, limb + 1
            if v:
                rows.append((int(j), part, limb, -1))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "part", "limb", "value"])

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(v array<double>, id) of the vectors that take part."""
    out = vectors.select(F.col(vector_col).cast("array<double>").alias("v"), F.col(id_col).alias("id"))
    return out.where((F.size("v") == dims) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> Model | None:
    """The centroids after ``rounds`` rounds; None without vectors."""
    kept = _kept(vectors, id_col, vector_col, dims)
    key = F.sha2(F.encode(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), "UTF-8"), 256)
    centroids = [[whole(x, scale) for x in r.v] for r in kept.orderBy(key, "v").limit(clusters).select("v").collect()]
    if not centroids:
        return None
    for last in [False] * rounds + [True]:
        sums = defaultdict(int)
        for r in kept.select("v").mapInArrow(_sums(centroids, scale, dims), SUMS).groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
            sums[r.cluster, r.part] += r.value << (LIMB * r.limb)
        counts = [sums[j, dims + 1] for j in range(len(centroids))]
        if not last:
            centroids = [[sums[j, i] // n for i in range(dims)] if (n := counts[j]) else c for j, c in enumerate(centroids)]
    return Model(centroids, scale, counts, [sums[j, dims] for j in range(len(centroids))])


def assign(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """Columns ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row a vector that takes part."""
    kept = _kept(vectors, id_col, vector_col, dims)
    schema = StructType([StructField("id", kept.schema["id"].dataType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    if model is None:
        found = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False))
        centroids, own, every, digests = [[0] * dims], [0], 0, [""]
    else:
        centroids, scale = model.centroids, model.scale
        own, every, digests = model.inertias, sum(model.inertias), [model.digest(j) for j in range(len(centroids))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Annulus(centroids, scale)
            for batch in batches:
                if batch.num_rows:
                    place, best = search.nearest(search.integers(_vectors(batch, dims)))
                    far = pa.array([int(d) if d <= LONGEST else None for d in best], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(place, pa.int32()), far], ["id", "cluster", "distance"])

        found = kept.mapInArrow(run, schema)
    long = lambda v: F.lit(v if v <= LONGEST else None).cast(LongType())
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    return found.select(F.col("id").alias(id_col), "cluster", "distance", of([long(v) for v in own]).alias("cluster_inertia"), long(every).alias("inertia"), of([F.lit(d).cast(StringType()) for d in digests]).alias("centroid_sha256"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """``fit`` and ``assign`` in one."""
    return assign(vectors, fit(vectors, id_col, vector_col, dims, clusters, rounds, scale, seed), id_col, vector_col, dims)
