"""Centroid clustering by Lloyd's rounds, sharded by dimension, in exact integers.

Vectors are packed in chunks of CHUNK rows, and each chunk is cut into blocks of BLOCK dimensions, which
are rows of one table laid out by block. A task of a block holds only that block's slice of the
centroids and computes exact partial distances of a chunk; the partial distances of a chunk's blocks are
added by key, and the sum's least entry names the cluster. Then the tasks of a block add up their own
columns by cluster, and each block's slice of the centroids is replaced from those sums alone.

What travels per round is the partial distances (rows times clusters, in 32 bits where they fit), a
cluster number per row, and one row of sums for each task, block and cluster. Centroids are a table of
K rows by dimensions, of which one slice a block is broadcast: its size is set by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starsift.storage import new_path, written

CHUNK, BLOCK = 1024, 16
#: Components stay below this in size, so that squared distances of up to 128 dimensions fit a long.
LARGEST = 1 << 27


def integers(vectors: DataFrame, dims: int, scale: int, vector_col: str = "embedding") -> tuple[Column, Column]:
    """(which rows are kept, their components as floor(scale * x)).

    Kept are vectors of exactly ``dims`` components, none of them null, NaN or infinite. A component too
    large for exact distances is an error rather than a wrong distance.
    """
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    large = F.exists(x, lambda v: F.abs(v.cast("double") * scale) >= LARGEST)
    kept = F.coalesce((F.size(x) == dims) & finite, F.lit(False))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return kept, F.when(large, F.raise_error(F.lit(f"a component times {scale} is not below {LARGEST}"))).otherwise(whole)


def _pack(batches: Iterator[pd.DataFrame], chunk: int) -> Iterator[pd.DataFrame]:
    seq = 0
    for batch in batches:
        for at in range(0, len(batch), chunk):
            some = batch.iloc[at : at + chunk]
            x = np.array(some["point"].tolist(), dtype=np.int32)
            cuts = [np.ascontiguousarray(x[:, d : d + BLOCK]).tobytes() for d in range(0, x.shape[1], BLOCK)]
            rows = [[{"id": i} for i in some["row"].map(lambda r: r["id"])]] + [None] * (len(cuts) - 1)
            yield pd.DataFrame({"chunk": (int(some["part"].iloc[0]) << 33) + seq, "block": range(len(cuts)), "n": len(some), "rows": rows, "cells": cuts})
            seq += 1


def _cells(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32).reshape(n, -1).astype(np.int64)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Squared distances within one block, a row for each vector and a column for each centroid, in 32 bits if they fit."""
    for batch in batches:
        for chunk, n, cells, centroids in zip(batch["chunk"], batch["n"], batch["cells"], batch["centroids"], strict=True):
            x, c = _cells(cells, n), np.stack(list(centroids)).astype(np.int64)
            apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
            short = bool(apart.max() < 1 << 32)
            yield pd.DataFrame({"chunk": [chunk], "n": [n], "short": [short], "apart": [(apart.astype(np.uint32) if short else apart).tobytes()]})


def _nearest(parts: pd.DataFrame) -> pd.DataFrame:
    """The blocks' distances of a chunk added up, and the least of each row; ties go to the smaller number."""
    n, total = int(parts["n"].iloc[0]), np.int64(0)
    for short, data in zip(parts["short"], parts["apart"], strict=True):
        total = total + np.frombuffer(data, dtype=np.uint32 if short else np.int64).reshape(n, -1).astype(np.int64)
    cluster = total.argmin(axis=1)
    return pd.DataFrame({"chunk": parts["chunk"].iloc[:1].tolist(), "clusters": [cluster.astype(np.int32)], "distances": [total[np.arange(n), cluster]]})


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, cluster, n, sums) of all rows of this task."""
    held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
    for batch in batches:
        for block, n, cells, clusters in zip(batch["block"], batch["n"], batch["cells"], batch["clusters"], strict=True):
            x, of = _cells(cells, n), np.asarray(clusters)
            for cluster in np.unique(of).tolist():
                some = x[of == cluster]
                count, total = held.get((block, cluster), (0, 0))
                held[block, cluster] = (count + len(some), total + some.sum(axis=0))
    keys = list(held)
    yield pd.DataFrame({"block": [b for b, _ in keys], "cluster": [c for _, c in keys], "n": [held[k][0] for k in keys], "sums": [held[k][1] for k in keys]})


def _slices(components: DataFrame) -> DataFrame:
    """(block, centroids) of (block, cluster, place, value): each block's part of all centroids, by number."""
    rows = components.groupBy("block", "cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("slice"))
    return rows.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "slice"))), lambda x: x["slice"]).alias("centroids"))


def _components(slices: DataFrame) -> DataFrame:
    rows = slices.select("block", F.posexplode("centroids").alias("cluster", "slice"))
    return rows.select("block", "cluster", F.posexplode("slice").alias("place", "value"))


def cluster(vectors: DataFrame, start: Column, k: int, rounds: int, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((id_col, cluster, distance) of every kept row, (cluster, centroid) of the end).

    Kept rows have exactly ``dims`` components, none null or non-finite, taken as floor(scale * x). The k
    kept rows with the smallest ``start`` are the first centroids, in that order (null last, ties by
    components); with fewer rows there are fewer centroids. Each round assigns every row to the nearest
    centroid (ties: the smaller number) and replaces each centroid that has rows by floor(sum / count) of
    them; after the last, rows are assigned once more. Ids may be null or repeat, every row has its own
    result; other columns change nothing; an empty table gives two empty ones.
    """
    spark = vectors.sparkSession
    kept, point = integers(vectors, dims, scale, vector_col)
    ids = F.struct(F.col(f"`{id_col}`").alias("id"))
    kind = vectors.schema[id_col].dataType.simpleString()
    points = vectors.select(ids.alias("row"), kept.alias("valid"), F.col(f"`{vector_col}`").alias("embedding"), start.alias("start")).filter("valid")
    points = points.select("row", integers(points, dims, scale)[1].alias("point"), "start")

    # Laid out by block, so that a task reads one block's columns; chunks get their numbers as they are written.
    path = new_path(spark, "cells")
    packed = points.select("row", "point", F.spark_partition_id().alias("part")).mapInPandas(partial(_pack, chunk=chunk), f"chunk long, block int, n int, rows array<struct<id:{kind}>>, cells binary")
    packed.write.partitionBy("block").parquet(path)
    cells = spark.read.schema(packed.schema).parquet(path)

    first = points.orderBy(F.col("start").asc_nulls_last(), "point").limit(k)
    first = first.select((F.row_number().over(Window.orderBy(F.col("start").asc_nulls_last(), "point")) - 1).alias("cluster"), "point")
    components = first.select("cluster", F.posexplode("point").alias("at", "value")).select(F.floor(F.col("at") / BLOCK).cast("int").alias("block"), "cluster", (F.col("at") % BLOCK).alias("place"), F.col("value").cast("long").alias("value"))
    slices = written(_slices(components), "centroids")

    def assigned() -> DataFrame:
        near = cells.select("chunk", "block", "n", "cells").join(F.broadcast(slices), "block")  # k * dims numbers
        parts = near.select("chunk", "n", "cells", "centroids").mapInPandas(_partial, "chunk long, n int, short boolean, apart binary")
        return written(parts.groupBy("chunk").applyInPandas(_nearest, "chunk long, clusters array<int>, distances array<long>"), "assigned")

    for _ in range(rounds):
        sums = cells.select("chunk", "block", "n", "cells").join(assigned().select("chunk", "clusters"), "chunk").mapInPandas(_sums, "block int, cluster int, n long, sums array<long>")
        sums = sums.select("block", "cluster", "n", F.posexplode("sums").alias("place", "sum")).groupBy("block", "cluster", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        mean = F.expr("(sum - pmod(sum, n)) div n")  # the floor, without a detour by doubles
        new = _components(slices).join(sums, ["block", "cluster", "place"], "left").select("block", "cluster", "place", F.coalesce(mean, "value").alias("value"))
        slices = written(_slices(new), "centroids")

    rows = cells.filter("block = 0").select("chunk", "rows").join(assigned(), "chunk")
    rows = rows.select(F.explode(F.arrays_zip("rows", "clusters", "distances")).alias("x"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"])
    return rows.select(F.col("x.rows.id").alias(id_col), F.col("x.clusters").alias("cluster"), F.col("x.distances").alias("distance")), _components(slices).groupBy("cluster").agg(whole.alias("centroid"))
