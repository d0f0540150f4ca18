"""Exact checks on embedding columns: dimensions, norms and nearest neighbours.

Nearest neighbours are found in one pass: every task keeps the ``k`` best vectors per query of
its own partition and emits only those, so neither vector pairs nor a global sort occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import top_n
from plumbline.session import cut_lineage

QUERY_BLOCK = 2048  # queries handed to one pass; more queries mean more passes
METRICS = ("cosine", "l2", "ip")


def norm(vec: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(vec, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def dim_check(df: DataFrame, vec: str, declared: int) -> DataFrame:
    """Vectors per measured dimension against the declared one."""
    sizes = df.groupBy(F.size(vec).alias("dim")).agg(F.count(F.lit(1)).alias("vectors"))
    return sizes.withColumn("matches", F.col("dim") == declared)


def norm_check(df: DataFrame, vec: str, group: str, tolerance: float = 1e-5) -> DataFrame:
    """Unit-norm vectors per group: where all are, cosine, L2 and inner product rank alike."""
    unit = F.abs(norm(vec) - 1.0) <= tolerance
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(unit).alias("unit_vectors"))
    return out.withColumn("normalized", F.col("vectors") == F.col("unit_vectors"))


def centroids(df: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean vector per group; sums are combined map-side per (group, position)."""
    spread = df.select(F.col(group).alias("query_id"), F.posexplode(vec).alias("pos", "x"))
    means = spread.groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("query_vec")
    )


def _distances(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every vector (row) to every query (column)."""
    dots = vectors @ queries.T
    if metric == "ip":
        return -dots
    if metric == "cosine":
        norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        return 1.0 - dots / norms
    squares = (vectors**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2.0 * dots
    return np.sqrt(np.maximum(squares, 0.0))


def _partial_top_k(query_ids: list, queries: np.ndarray, k: int, metric: str, grouped: bool):
    """Task function: Arrow batches of (id, vec, grp) in, the partition's best per query out."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.empty((len(query_ids), 0), dtype=np.int64)
        dist = np.empty((len(query_ids), 0))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("vec")
            vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            d = np.round(_distances(vectors, queries, metric), 9).T
            if grouped:
                owner = batch.column("grp").to_numpy(zero_copy_only=False)
                d = np.where(np.array(query_ids)[:, None] == owner[None, :], d, np.inf)
            new = np.broadcast_to(batch.column("id").to_numpy(zero_copy_only=False), d.shape)
            if d.shape[1] > 4 * k:  # only what is as near as the k-th nearest can matter
                edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                near = (d <= edge).any(axis=0)
                new, d = new[:, near], d[:, near]
            ids, dist = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
            order = np.lexsort((ids, dist), axis=1)[:, :k]
            ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
        kept = np.isfinite(dist)
        owners = np.broadcast_to(np.array(query_ids)[:, None], dist.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(owners[kept], pa.int64()), pa.array(ids[kept], pa.int64()), pa.array(dist[kept], pa.float64())],
            names=["query_id", "id", "distance"],
        )

    return best


def vector_status(vec: str, dim: int, metric: str = "cosine") -> Column:
    """Why a vector cannot be compared with queries of ``dim`` dimensions; ``ok`` if it can."""
    unset = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    zero = F.lit(metric == "cosine") & F.forall(vec, lambda x: x == 0)
    return (
        F.when(F.col(vec).isNull(), "null").when(F.size(vec) != dim, "dimension").when(unset, "not_finite").when(zero, "zero").otherwise("ok")
    )


def comparable_vectors(df: DataFrame, vec: str, dim: int, metric: str = "cosine") -> DataFrame:
    """Vectors per status: what a nearest-neighbour search of this dimension leaves out, and why."""
    return df.groupBy(vector_status(vec, dim, metric).alias("status")).agg(F.count(F.lit(1)).alias("vectors"))


def knn_exact(
    df: DataFrame, id_col: str, vec: str, queries: DataFrame, k: int, metric: str = "cosine", within: str | None = None
) -> DataFrame:
    """The ``k`` nearest vectors of each query ``(query_id, query_vec)``, exactly.

    Distances are rounded to 9 decimals before ranking and ties go to the smaller id; ids are
    integers.  Queries are computed once, and travel with the task in blocks of bounded size.  All
    queries must have one dimension and be comparable, or the call fails; vectors that are not
    comparable with them are left out, and ``comparable_vectors`` counts them by reason.
    With ``within``, only vectors whose column ``within`` equals the query id compete.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    empty = df.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    asked = cut_lineage(queries.select("query_id", "query_vec", F.size("query_vec").alias("dim")), "knn-queries")
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("low"), F.max("dim").alias("high")).first()
    if not shape["n"]:
        return empty
    if shape["low"] != shape["high"]:
        raise ValueError(f"queries of {shape['low']} and {shape['high']} dimensions")
    bad = asked.where(vector_status("query_vec", shape["low"], metric) != "ok").limit(1).collect()
    if bad:
        raise ValueError(f"query {bad[0]['query_id']} cannot be compared")
    blocks = -(-shape["n"] // QUERY_BLOCK)
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    owner = F.col(within).cast("long") if within else F.lit(0).cast("long")
    usable = df.where(vector_status(vec, shape["low"], metric) == "ok")
    source = usable.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("vec"), owner.alias("grp"))
    passes = []
    for b in range(blocks):
        rows = asked.where(block_of == b).orderBy("query_id").collect()
        if not rows:
            continue
        matrix = np.array([r["query_vec"] for r in rows], dtype=np.float64)
        task = _partial_top_k([int(r["query_id"]) for r in rows], matrix, k, metric, within is not None)
        passes.append(source.mapInArrow(task, "query_id long, id long, distance double"))
    best = reduce(DataFrame.unionByName, passes)
    return top_n(best, ["query_id"], [F.asc("distance"), F.asc("id")], k)


def metric_agreement(df: DataFrame, id_col: str, vec: str, queries: DataFrame, k: int, a: str, b: str) -> DataFrame:
    """Neighbours that two metrics share, per query."""
    left = knn_exact(df, id_col, vec, queries, k, a).select("query_id", "id")
    right = knn_exact(df, id_col, vec, queries, k, b).select("query_id", "id", F.lit(1).alias("hit"))
    return left.join(right, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("shared")
    )


def filter_recall(df: DataFrame, id_col: str, vec: str, group: str, queries: DataFrame, k: int) -> DataFrame:
    """What filtering after the search loses against filtering before it."""
    before = knn_exact(df, id_col, vec, queries, k, "cosine", within=group).select("query_id", "id")
    after = knn_exact(df, id_col, vec, queries, k, "cosine").select("query_id", "id", F.lit(1).alias("hit"))
    return before.join(after, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("kept")
    )
