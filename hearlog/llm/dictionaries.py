"""Centroid clustering over dictionaries of distinct subvectors (operator 12)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearlog.llm.vectors import BLOCK, blocks, digest, finite, packed, scaled, summed, total, unpacked
from hearlog.session import durable

#: Components per subvector. Short ones repeat more often.
WIDTH = 2


def dictionaries(rows: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, code per row) of each run of ``width`` components; lossless."""
    found = []
    for at in range(0, rows.shape[1], width):
        distinct, codes = np.unique(rows[:, at:at + width], axis=0, return_inverse=True)
        found.append((distinct, codes.ravel()))
    return found


def nearest(encoded: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) per row; ties to the first.

    Distances are computed once per distinct subvector, and added up by code.
    """
    apart, at = 0, 0
    for distinct, codes in encoded:
        piece = centroids[:, at:at + distinct.shape[1]]
        apart = apart + ((distinct[:, None, :] - piece[None]) ** 2).sum(axis=2)[codes]
        at += distinct.shape[1]
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(best)), best]


def sums(encoded: list[tuple[np.ndarray, np.ndarray]], cluster: np.ndarray, clusters: int) -> np.ndarray:
    """Sums of components per cluster: how often it has a code, times the code's subvector."""
    found = []
    for distinct, codes in encoded:
        often = np.bincount(cluster * len(distinct) + codes, minlength=clusters * len(distinct))
        found.append(often.reshape(clusters, -1) @ distinct)
    return np.concatenate(found, axis=1)


def _stored(size: int, scale: int, block: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in blocks(batches, size, scale, block):
            arrays = {}
            for number, (distinct, codes) in enumerate(dictionaries(rows, width)):
                arrays[f"{number}.distinct"] = distinct.astype(np.int32)
                arrays[f"{number}.codes"] = codes.astype(np.min_scalar_type(len(distinct)))
            ids = pa.array([table.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.record_batch([ids, pa.array([packed(arrays)], pa.binary())], names=["id", "subvectors"])

    return run


def _read(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    arrays = unpacked(data)
    return [(arrays[f"{n}.distinct"].astype(np.int64), arrays[f"{n}.codes"].astype(np.int64)) for n in range(len(arrays) // 2)]


def _round(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for data in batch.column(0):
                encoded = _read(data.as_py())
                cluster, _ = nearest(encoded, centroids)
                moved += sums(encoded, cluster, len(centroids))
                counts += np.bincount(cluster, minlength=len(centroids))
        cluster, place = (axis.ravel() for axis in np.indices(centroids.shape))
        used = counts[cluster] > 0
        columns = [cluster.astype(np.int32), place.astype(np.int32), moved.ravel(), counts[cluster]]
        yield pa.record_batch([pa.array(c[used]) for c in columns], names=["cluster", "place", "sum", "n"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                cluster, distance = nearest(_read(data.as_py()), centroids)
                yield pa.record_batch(
                    [ids.values, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
                )

    return run


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = 64,
    clusters: int = 40,
    rounds: int = 5,
    scale: int = 256,
    seed: int = 2,
    block: int = BLOCK,
    width: int = WIDTH,
) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``; centroids).

    Kept are vectors of ``size`` finite components. Components become integers
    floor(scale * x), saturated at 2^26. Centroids start as the vectors whose
    SHA-256 of ``seed:id`` is smallest and are moved ``rounds`` times to the floor of the
    mean of the vectors nearest to each (squared distance, ties to the smaller number; empty
    ones stay); then vectors are assigned once more.

    Null ids start no centroid unless too few rows have one; equal ids are taken in the order
    of their vectors. Rows with equal or null ids are clustered each; with fewer vectors than
    ``clusters`` each starts a cluster. Sums stop at the largest long. Extra columns are not
    read; no kept vectors give no rows and no centroids.

    A task encodes blocks of ``block`` vectors, once, by dictionaries of the distinct
    subvectors of ``width`` components, and stores codes and dictionaries. A block's own
    dictionaries bound memory and need no shuffle. A round sends the centroids to the
    blocks and gets sums and counts back.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    starts = (
        rows.where(finite(F.col("vector")) & (F.size("vector") == size))
        .select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("draw"),
                F.col("vector").cast("array<double>").alias("vector"))
        .orderBy(F.col("draw").asc_nulls_last(), "vector").limit(clusters).collect()
    )
    centroids = scaled(np.array([row["vector"] for row in starts], np.float64).reshape(len(starts), size), scale)
    stored = durable(rows.mapInArrow(_stored(size, scale, block, width), "id array<bigint>, subvectors binary"))
    for _ in range(rounds if len(starts) else 0):
        moved = centroids.copy()
        partial = stored.select("subvectors").mapInArrow(_round(centroids), "cluster int, place int, sum long, n long")
        for number, place, value, n in summed(partial, ["cluster", "place"]):
            moved[number, place] = value // n
        centroids = moved
    assigned = durable(stored.mapInArrow(_assigned(centroids), "id bigint, cluster int, distance bigint"))
    inertia = assigned.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    everything = assigned.agg(total("distance")).first()[0]
    joined = assigned.join(F.broadcast(inertia), "cluster").withColumn("inertia", F.lit(everything).cast("long"))
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia"), centroids


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """``cluster`` with the SHA-256 of the final centroid's integers beside every vector."""
    rows, centroids = cluster(vectors, **settings)
    digests = F.array(*[F.lit(digest(centroid)) for centroid in centroids]).cast("array<string>")
    return rows.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))
