"""Centroid clustering of whole-number vectors by ball-tree filtering.

Each task builds metric trees over blocks of its own vectors, once; they are stored with the vectors and
serve all rounds. A round sends the centroids to the trees, which send back a count and a sum per
centroid and task; no vector is ever shuffled, so it doesn't matter how many are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ball_tree import BallTree, build, gathered, labels
from .scratch import spread, staged

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
#: Vectors of one tree.
BLOCK = 2048
#: Components must stay under this, so that squared distances and their sums over a vector fit a long.
LIMIT = 1 << 19

TREE = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("points", "lo", "hi", "child", "square", "sums")]])
TREE_DDL = "ids array<long>, points binary, lo binary, hi binary, child binary, square binary, sums binary"
KINDS = {"points": "<i4", "lo": "<i4", "hi": "<i4", "child": "<i4", "square": "<i8", "sums": "<i8"}


def whole_numbers(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector of another size or with a component that is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    floors = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) < LIMIT, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more"))).cast("int"))
    return F.when((F.size(vector) == size) & F.coalesce(finite, F.lit(False)), floors)


def forest(rows: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """A row per tree, of (vec_id, v): a task's vectors in blocks of `block`, the last one smaller."""

    def planted(parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        tree, order = build(np.concatenate([v for _, v in parts]).astype(np.int64))
        ids = pa.concat_arrays([i for i, _ in parts]).take(pa.array(order))
        cells = [pa.array([getattr(tree, c).astype(kind).tobytes()], pa.binary()) for c, kind in KINDS.items()]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], ids), *cells], schema=TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, np.ndarray]] = []
        held = 0
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            at = 0
            while at < len(vectors):
                n = min(block - held, len(vectors) - at)
                parts.append((batch.column(0).slice(at, n), vectors[at : at + n]))
                at, held = at + n, held + n
                if held == block:
                    yield planted(parts)
                    parts, held = [], 0
        if parts:
            yield planted(parts)

    return rows.mapInArrow(run, TREE_DDL)


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for k in range(batch.num_rows):
        row = {c: np.frombuffer(batch.column(c)[k].as_py(), dtype=kind).astype(np.int64) for c, kind in KINDS.items()}
        yield batch.column("ids")[k].values, BallTree(row["points"].reshape(-1, size), row["lo"], row["hi"], row["child"], row["square"], row["sums"].reshape(-1, size))


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. The driver gets a count and a sum for each of them."""
    size = centroids.shape[1]
    names = ["cluster", "n", *[f"s{k}" for k in range(size)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            for _, tree in _trees(batch, size):
                n, s = gathered(tree, centroids)
                counts += n
                sums += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centroids))), pa.array(counts), *[pa.array(c) for c in sums.T]], names=names)

    found = trees.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]]).filter("n > 0").collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept vector.

    Kept are vectors of `size` finite components; a component of LIMIT or more is an error. The k vectors whose ids
    have the smallest hashes start; rows that repeat an id stand there by their components, a missing id
    never starts. With fewer vectors there are fewer centroids; without any id at all the columns behind
    vec_id are null. Of equally near centroids the smaller number counts. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), size, scale).alias("v")).filter("v IS NOT NULL")
    first = rows.filter("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "v").limit(k).select("v").collect()
    if not first:
        none = F.lit(None)
        return rows.select("vec_id", none.cast("int").alias("cluster"), none.cast("long").alias("distance"), none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    trees = staged(forest(spread(rows), size, block), "ball-trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch, size):
                of, apart = labels(tree, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(of.astype(np.int32)), pa.array(apart)], names=["vec_id", "cluster", "distance"])

    found = staged(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    sums = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    known = spark.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each centroid
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
