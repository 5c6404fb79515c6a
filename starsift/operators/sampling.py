"""Seeded, repeatable sampling and splitting: the choice depends on keys, never on partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.operators.rank import global_rank, ranked_between, stable_order, top_k_per_class


def split_quotas(labels: DataFrame, ratio: float, label: str = "label") -> DataFrame:
    """(label, rows, test_rows): ceil(ratio * n) test rows in all, dealt by largest remainder, ties by label.

    One row per class is ordered in one task.
    """
    counts = labels.groupBy(label).agg(F.count("*").alias("rows"))
    every = Window.partitionBy()
    share = F.col("wanted") * F.col("rows") / F.sum("rows").over(every)
    quotas = counts.withColumn("wanted", F.ceil(F.sum("rows").over(every) * F.lit(ratio))).withColumn("share", share).withColumn("whole", F.floor("share"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("share") - F.col("whole"), 9)), label))
    more = F.col("wanted") - F.sum("whole").over(every)
    return quotas.withColumn("more", more).withColumn("place", place).select(label, "rows", (F.col("whole") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).cast("long").alias("test_rows"))


def stratified_split(labels: DataFrame, ratio: float, seed: int = 42, label: str = "label") -> DataFrame:
    """``labels`` with split, train or test, by exact quotas of each class.

    Raises where a class has one row, or there are fewer test rows than classes (with ratio over 0).
    """
    if ratio <= 0:
        return labels.withColumn("split", F.lit("train"))
    checks = split_quotas(labels, ratio, label).agg(F.min("rows").alias("least"), F.sum("test_rows").alias("test"), F.count("*").alias("classes")).first()
    if checks["classes"] > 1 and (checks["least"] < 2 or checks["test"] < checks["classes"]):
        raise ValueError("too few rows for a stratified split")
    own = labels.select(F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("own"), F.col(label).alias("cls"), "filename", stable_order(seed).alias("place"))
    ranked = global_rank(own, [F.asc("place"), F.asc("filename")], ["cls"])
    quotas = split_quotas(labels, ratio, label).select(F.col(label).alias("of"), "test_rows")
    split = F.when(F.col("rank") <= F.col("test_rows"), "test").otherwise("train").alias("split")
    return ranked.join(quotas, F.col("cls").eqNullSafe(F.col("of"))).select(*(F.col(f"own.`{c}`") for c in labels.columns if c != "split"), split)


def initial_labels(truth: DataFrame, cls: int, n: int, ratio: float, seed: int = 42, label: str = "label_idx") -> DataFrame:
    """(filename, label): trunc(n * ratio) anomalies of class ``cls`` and n minus that others; all rows of a class that is too small."""
    anomalies = math.trunc(n * ratio)
    rows = truth.withColumn("anomaly", (F.col(label) == cls).cast("int")).withColumn("order_key", stable_order(seed))
    picked = top_k_per_class(rows, max(anomalies, n - anomalies), "anomaly", [F.asc("order_key"), F.asc("filename")])
    picked = picked.filter(F.col("nth") <= F.when(F.col("anomaly") == 1, anomalies).otherwise(n - anomalies))
    return picked.select("filename", F.when(F.col("anomaly") == 1, "anomaly").otherwise("normal").alias("label"))


def sample_per_class(df: DataFrame, k: int, seed: int = 42, label: str = "label_idx", pad: bool = False) -> DataFrame:
    """``df``'s k first rows of each class in the seeded order, with nth (in place of a column of that name); with ``pad`` the last row repeats up to k."""
    columns = [c for c in df.columns if c != "nth"]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col(label).alias("cls"), "filename", stable_order(seed).alias("place"))
    rows = top_k_per_class(own, k, "cls", [F.asc("place"), F.asc("filename")])
    out = [F.col(f"own.`{c}`") for c in columns]
    if not pad:
        return rows.select(*out, "nth")
    last = rows.groupBy("cls").agg(F.max("nth").alias("last")).withColumnRenamed("cls", "of")
    times = F.when(F.col("nth") == F.col("last"), F.sequence(F.col("nth"), F.lit(k))).otherwise(F.array("nth"))
    return rows.join(last, F.col("cls").eqNullSafe(F.col("of"))).withColumn("nth", F.explode(times)).select(*out, "nth")


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, rows, weight): 1 / rows, or 1 where there is one class."""
    counts = labels.groupBy(label).agg(F.count("*").alias("rows"))
    return counts.withColumn("weight", F.when(F.count("*").over(Window.partitionBy()) > 1, 1.0 / F.col("rows")).otherwise(F.lit(1.0)))


def _draws(df: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, u, v): for each draw two numbers of [0, 1), from MD5 of seed and draw, as any engine can repeat them."""
    digest = lambda k: F.md5(F.concat(F.lit(f"{seed}|{k}|"), F.col("id").cast("string")))
    unit = lambda k: F.conv(F.substring(digest(k), 1, 10), 16, 10).cast("long") / float(1 << 40)
    return df.sparkSession.range(n).withColumns({"u": unit(1), "v": unit(2)})


def weighted_sample(df: DataFrame, n: int, seed: int = 42, label: str = "label") -> DataFrame:
    """n draws with replacement, each class with equal chance, with draw from 0.

    A draw names a class and a position in it; rows are joined by position.
    """
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), F.col(label).alias("cls"), "filename")
    indexed = global_rank(own, [F.asc("filename")], ["cls"], "position")
    classes = df.groupBy(F.col(label).alias("of")).agg(F.count("*").alias("rows"))
    number = classes.withColumn("number", F.row_number().over(Window.orderBy("of")) - 1)
    k = classes.count()
    draws = _draws(df, n, seed).withColumn("number", F.floor(F.col("u") * k).cast("int")).join(number, "number")
    draws = draws.select(F.col("id").alias("draw"), "of", (F.floor(F.col("v") * F.col("rows")) + 1).alias("at"))
    met = draws.join(indexed, F.col("of").eqNullSafe(F.col("cls")) & (F.col("at") == F.col("position")))
    return met.select("draw", *(F.col(f"own.`{c}`") for c in df.columns))


def uniform_sample(df: DataFrame, n: int, replacement: bool = True, seed: int = 42) -> DataFrame:
    """n draws, with draw from 0; without replacement the first n rows of the seeded order (at most all)."""
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), "filename")
    out = [F.col(f"own.`{c}`") for c in df.columns]
    if not replacement:
        return ranked_between(own, seed, 0, n)[0].select((F.col("rank") - 1).alias("draw"), *out)
    indexed = global_rank(own, [F.asc("filename")], name="position")
    rows = df.count()
    draws = _draws(df, n if rows else 0, seed).select(F.col("id").alias("draw"), (F.floor(F.col("v") * rows) + 1).alias("position"))
    return draws.join(indexed, "position").select("draw", *out)


def batches(df: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """``df`` with batch from 0 in the order of filenames (in place of a column of that name); an incomplete last batch is dropped by default."""
    columns = [c for c in df.columns if c != "batch"]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), "filename")
    ranked = global_rank(own, [F.asc("filename")]).select(*(F.col(f"own.`{c}`") for c in columns), F.floor((F.col("rank") - 1) / size).alias("batch"))
    if drop_last:
        ranked = ranked.filter(F.col("batch") < df.count() // size)
    return ranked
