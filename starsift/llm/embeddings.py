"""Embedding near-dedup by cross-polytope hashing.

Equal vectors of a label become one representative with a number of copies. Each representative is
rotated (random signs and Hadamard transforms), and HASHES nearest vertices of the cross-polytope
name its bucket in each of TABLES tables; multiprobe adds the bucket with one vertex replaced by the
second nearest. Vectors that share a bucket are compared exactly, in double precision.

A bucket is cut into blocks of about BLOCK vectors, and pairs of blocks are compared as matrices by
different tasks. What leaves a task is, per vector, the number of its links and the root of its
component within the block pair, never the pairs. A pair that shares several buckets counts in the
first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.llm.components import connected_components
from starsift.storage import written

#: Cosine from which two vectors link.
LEAST = 0.98
#: At cosine 0.98 one vertex agrees for 73 % of pairs, a bucket or a probe of three for about 80 %, one of six tables for over 99.9 %.
TABLES, HASHES = 6, 3
BLOCK = 256
SEED = 20240607


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither vanish nor overflow."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(rows, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES * (HASHES + 1)) bucket numbers of unit rows: per table its own, then its probes."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], size=(TABLES, HASHES, 3, width))
    out = []
    for table in range(TABLES):
        first, second = [], []
        for h in range(HASHES):
            y = padded
            for turn in range(3):
                y = hadamard(y * signs[table, h, turn])
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            near = np.take_along_axis(size, top, 1)
            top = np.where(near[:, :1] >= near[:, 1:], top, top[:, ::-1])
            vertex = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            first.append(vertex[:, 0])
            second.append(vertex[:, 1])
        for probe in range(HASHES + 1):  # the first is no probe: all vertices are the nearest
            number = np.full(len(x), table, dtype=np.int64)
            for h in range(HASHES):
                number = number * 2 * width + (second if probe == h + 1 else first)[h]
            out.append(number)
    return np.stack(out, axis=1)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, some in batch.groupby(batch["embedding"].map(len)):
            numbers = buckets(unit(_stack(some["embedding"])))
            times = numbers.shape[1]
            yield pd.DataFrame({"label": np.repeat(some["label"].to_numpy(), times), "bucket": numbers.reshape(-1), "width": np.repeat(some["embedding"].map(len).to_numpy(), times), "rep": np.repeat(some["rep"].to_numpy(), times)})


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, by links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(rep: np.ndarray, copies: np.ndarray, first: np.ndarray, same: bool, x: np.ndarray, numbers: np.ndarray, bucket: int, least: float) -> pd.DataFrame:
    """(rep, links, root) of the vectors of two blocks (``first``: of the first) that link across them.

    With ``same`` both blocks are one. Only pairs whose first shared bucket is ``bucket`` count.
    """
    a = np.flatnonzero(first)
    b = a if same else np.flatnonzero(~first)
    i, j = np.nonzero(x[a] @ x[b].T >= least)
    i, j = a[i], b[j]
    if same:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 8192):
        p, q = numbers[i[at : at + 8192]], numbers[j[at : at + 8192]]
        shared = np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, np.iinfo(np.int64).max)
        good[at : at + 8192] = shared.min(axis=1) == bucket
    i, j = i[good], j[good]
    links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    order = np.argsort(rep, kind="stable")  # the smallest rep is the root
    place = np.empty(len(rep), dtype=np.int64)
    place[order] = np.arange(len(rep))
    root = rep[order[_roots(len(rep), place[i], place[j])]]
    some = links > 0
    return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[place[some]]})


def _compare_blocks(least: float):
    keys = ["label", "width", "bucket", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for width, some in rows.groupby("width"):
                x = unit(_stack(some["embedding"]))
                numbers = buckets(x)
                rep, copies, first = some["rep"].to_numpy(), some["copies"].to_numpy(), (some["own"] == some["low"]).to_numpy()
                for where in some.reset_index(drop=True).groupby(keys, sort=False).indices.items():
                    (_, _, bucket, low, high), at = where
                    if len(at) > 1:
                        found = compare(rep[at], copies[at], first[at], low == high, x[at], numbers[at], bucket, least)
                        if len(found):
                            yield found

        # Rows come sorted by block pair; the last pair of a batch may go on in the next one.
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            yield from done(rows[~last])
            held = rows[last]
        if held is not None:
            yield from done(held)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link if their labels are equal and their cosine is at least ``least``; other vectors of
    equal content link too. Null vectors, zeros, null or non-finite components, null labels and
    vectors of another length link with nothing. A repeated row is a further vector with the same id,
    and so is another vector with that id. A component without an id has the id null, and its rows
    aren't kept. Other columns of ``vectors``, whatever their names, change nothing. An empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    # Representatives get a number, which is written once and then read; ids may repeat or lack.
    reps = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    label_type = dict(reps.dtypes)["label"]
    hashed = written(reps.select("label", "embedding", "rep").mapInPandas(_hash, f"label {label_type}, bucket long, width int, rep long"), "buckets")
    shared = hashed.groupBy("label", "width", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = hashed.join(shared, ["label", "width", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("label", "width", "bucket", "rep", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    full = met.join(reps.select("rep", "copies", "embedding"), "rep")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "width", "bucket", "low", "high"]
    found = written(full.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(_compare_blocks(least), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least_id = known.groupBy("component").agg(F.min("first_id").alias("known_component"))
    known = known.join(least_id, "component")
    known = written(known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("known_links"), "known_component"), "classes")
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("known_component", "vec_id")
    return out.select("vec_id", F.coalesce("known_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
