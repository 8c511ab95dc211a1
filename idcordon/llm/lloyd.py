"""Centroid clustering: Lloyd's rounds over vectors that are cut into blocks of columns.

Kept vectors become whole numbers, ``floor(scale * x)``, and are stored once as blocks of rows, each cut
into ``shards`` slices of columns. In a round a task takes a slice and the matching slice of the
centroids, nothing else of either, and gives the exact partial distances of its rows. Reducing by
block adds the partial distances of its slices and takes the nearest centroid; the sums of each
slice by cluster then update that slice of the centroids. Only sums of K x dimensions numbers reach
the driver. All arithmetic is in 64-bit integers.

Defined results: a vector with another number of components than ``dims``, or with a null or
non-finite one, gives no row, as does a null vector. The first centroids are the vectors with the least sha256 of ``1:<vec_id>``,
repeated ids by their components; a null id counts as empty there. Fewer than K vectors make as
many clusters. Repeated rows each count. Ties go to the smaller cluster number; a cluster without
vectors keeps its centroid. A component of 2**27 or more after scaling is an error, as
distances would not fit 64 bits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idcordon.sources.shared import stored

_LARGEST = 1 << 27


@dataclass(frozen=True)
class LloydOptions:
    """shards: slices of columns. rows: vectors in a block at most."""

    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    shards: int = 4
    rows: int = 4096


def usable(vectors: DataFrame, options: LloydOptions, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has exactly ``dims`` components, none null or non-finite; components as doubles."""
    inf = float("inf")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(inf)))
    return vectors.where((F.size(vector) == options.dims) & finite).select("vec_id", F.col(vector).cast("array<double>").alias("vector"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(scale * x.astype(np.float64))
    if out.size and np.abs(out).max() >= _LARGEST:
        raise ValueError(f"a component is {_LARGEST} or more after scaling")
    return out.astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all."""
    for kind in (np.int8, np.int16, np.int32):
        if not a.size or (np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max):
            return a.astype(kind).tobytes()
    return a.astype(np.int64).tobytes()


def unpack(data: bytes, rows: int, columns: int) -> np.ndarray:
    kind = np.dtype(f"i{len(data) // (rows * columns)}")
    return np.frombuffer(data, dtype=kind).reshape(rows, columns).astype(np.int64)


def widths(options: LloydOptions) -> list[np.ndarray]:
    """The columns of each slice."""
    return np.array_split(np.arange(options.dims), min(options.shards, options.dims))


def sliced(kept: DataFrame, options: LloydOptions) -> DataFrame:
    """(block, shard, n, ids, data): slices of blocks of rows. Ids stand with the first slice of each block."""
    columns = widths(options)
    kind = kept.schema["vec_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, options.rows):
                part = batch.slice(at, options.rows)
                n = part.num_rows
                x = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, options.dims), options.scale)
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                ids = pa.concat_arrays([ids, pa.nulls(len(columns) - 1, ids.type)]) if len(columns) > 1 else ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(columns), pa.int64()), pa.array(range(len(columns)), pa.int32()), pa.array([n] * len(columns), pa.int32()), ids,
                     pa.array([pack(x[:, c]) for c in columns], pa.binary())],
                    names=["block", "shard", "n", "ids", "data"],
                )
                block += 1

    return kept.mapInArrow(cut, f"block bigint, shard int, n int, ids array<{kind.simpleString()}>, data binary")


def first_centroids(kept: DataFrame, options: LloydOptions) -> np.ndarray:
    """Whole components of the vectors with the least hash of their id, in order of that hash."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("hash"), "vector").orderBy("hash", "vector").limit(options.k).collect()
    return whole(np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), options.dims), options.scale)


def with_partials(blocks: DataFrame, centroids: np.ndarray, options: LloydOptions) -> DataFrame:
    """Adds ``partial``: the squared distance of each row to each centroid over the columns of the slice."""
    slices = [centroids[:, c] for c in widths(options)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a slice of a whole block
                row = batch.slice(i, 1)
                c = slices[row.column(1)[0].as_py()]
                x = unpack(row.column(4)[0].as_py(), row.column(2)[0].as_py(), c.shape[1])
                partial = np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([pack(partial)], pa.binary())], names=[*row.schema.names, "partial"])

    return blocks.mapInArrow(measure, T.StructType([*blocks.schema.fields, T.StructField("partial", T.BinaryType())]))


def nearest(group: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, the slices' partial distances added up."""
    n = group.column("n")[0].as_py()
    total = sum(unpack(p.as_py(), n, k) for p in group.column("partial"))
    label = total.argmin(axis=1)
    return label, total[np.arange(n), label]


def _summed(k: int, columns: list[np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """By slice: for each cluster and column the sum and the number of the block's vectors."""

    def sums(group: pa.Table) -> pa.Table:
        label, _ = nearest(group, k)
        count = np.bincount(label, minlength=k)
        there = np.flatnonzero(count)
        out = []
        for shard, n, data in zip(*(group.column(c).to_pylist() for c in ("shard", "n", "data"))):
            own = columns[shard]
            x = unpack(data, n, len(own))
            total = np.zeros((k, len(own)), dtype=np.int64)
            np.add.at(total, label, x)
            out.append((np.repeat(shard, len(there) * len(own)), np.repeat(there, len(own)), np.tile(own, len(there)), total[there].ravel(), np.repeat(count[there], len(own))))
        parts = [np.concatenate(p) for p in zip(*out)]
        return pa.table([pa.array(p.astype(t)) for p, t in zip(parts, ("i4", "i4", "i4", "i8", "i8"))], names=["shard", "cluster", "place", "total", "n"])

    return sums


def updated(measured: DataFrame, centroids: np.ndarray, options: LloydOptions) -> np.ndarray:
    """Each slice's floor of the mean of each cluster; a cluster without vectors stays."""
    k = len(centroids)
    by_block = measured.groupBy("block").applyInArrow(_summed(k, widths(options)), "shard int, cluster int, place int, total bigint, n bigint")
    sums = by_block.groupBy("shard", "cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("(total - pmod(total, n)) div n")
    out = centroids.copy()
    for r in sums.select("cluster", "place", mean.alias("mean")).collect():  # k x dims numbers
        out[r.cluster, r.place] = r.mean
    return out


def cluster(vectors: DataFrame, options: LloydOptions | None = None, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, and the centroids they were assigned to."""
    options = options or LloydOptions()
    kept = usable(vectors, options, vector)
    kind = kept.schema["vec_id"].dataType
    blocks = stored(sliced(kept, options), "slices")
    centroids = first_centroids(kept, options)
    k = len(centroids)
    for _ in range(options.rounds if k else 0):
        centroids = updated(with_partials(blocks, centroids, options), centroids, options)

    def assign(group: pa.Table) -> pa.Table:
        label, distance = nearest(group, k)
        ids = group.column("ids").drop_null().combine_chunks().flatten()
        return pa.table([ids, pa.array(label.astype("i4")), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return stored(with_partials(blocks, centroids, options).groupBy("block").applyInArrow(assign, schema), "clusters"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia and the hash of the centroid's components."""
    own = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows
    rows = [(i, n, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, n in own.items()]
    figures = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
