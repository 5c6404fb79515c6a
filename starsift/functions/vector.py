"""Functions over score and feature vectors, as expressions on ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    most = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - most) / temperature))
    return F.transform(e, lambda x: x / total(e))


def log_sum_exp(logits: Column) -> Column:
    most = F.array_max(logits)
    return most + F.log(total(F.transform(logits, lambda x: F.exp(x - most))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log p of class ``target`` (from 0)."""
    return log_sum_exp(logits) - F.element_at(logits, target.cast("int") + 1)


def soft_cross_entropy(logits: Column, target: Column) -> Column:
    """-sum(t * log p) for a vector of probabilities ``target``."""
    z = log_sum_exp(logits)
    return total(F.zip_with(target, logits, lambda t, x: t * (z - x)))


def argmax(v: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def pseudo_label(logits: Column, cutoff: float) -> tuple[Column, Column, Column]:
    """(largest probability, its class, 1 if it is at least the cutoff)."""
    p = softmax(logits)
    most = F.array_max(p)
    return most, argmax(logits), (most >= cutoff).cast("double")


def consistency(weak: Column, strong: Column, kind: str = "ce", temperature: float = 0.5, cutoff: float = 0.95, hard: bool = True) -> tuple[Column, Column]:
    """(loss, mask) of a row: masked cross-entropy against the weak view's label, or mean squared difference ('L2')."""
    if kind == "L2":
        gap = F.zip_with(strong, weak, lambda s, w: (s - w) * (s - w))
        return total(gap) / F.size(gap), F.lit(1.0)
    _, label, mask = pseudo_label(weak, cutoff)
    loss = cross_entropy(strong, label) if hard else soft_cross_entropy(strong, softmax(weak, temperature))
    return mask * loss, mask


def consistency_loss(df: DataFrame, kind: str = "ce", **options) -> DataFrame:
    """One row: mean loss over all rows, and mean mask."""
    loss, mask = consistency(F.col("weak"), F.col("strong"), kind, **options)
    return df.agg(F.avg(loss).alias("loss"), F.avg(mask).alias("mask"))


def total_loss(df: DataFrame, weight: float = 1.0) -> DataFrame:
    """(sup, unsup, mask) to total and the share that is masked out."""
    return df.select((F.col("sup") + weight * F.col("unsup")).alias("total"), (1 - F.col("mask")).alias("mask_ratio"))


def eval_loss(df: DataFrame) -> DataFrame:
    """One row of (logits, label): mean cross-entropy and accuracy."""
    return df.agg(F.avg(cross_entropy(F.col("logits"), F.col("label"))).alias("loss"), F.avg((argmax(F.col("logits")) == F.col("label")).cast("double")).alias("accuracy"))


def ema(history: DataFrame, m: float = 0.99, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """(keys, value) of (keys, iteration from 0, value): the moving average after the last iteration.

    It starts at the first value; its closed form is m ** k * w0 + sum of (1 - m) * m ** (k - i) * wi.
    """
    k = history.groupBy(*keys).agg(F.max("iteration").alias("k"))
    weight = F.when(F.col("iteration") == 0, F.pow(F.lit(m), F.col("k"))).otherwise((1 - m) * F.pow(F.lit(m), F.col("k") - F.col("iteration")))
    return history.join(k, list(keys)).groupBy(*keys).agg(F.sum(weight * F.col("value")).alias("value"))


def normalize(v: Column, mean: float, std: float) -> Column:
    return F.transform(v, lambda x: (x - mean) / std)


def minmax_stretch(v: Column) -> Column:
    """To 0..255 as integers, cut; null for a constant vector."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(high > low, F.transform(v, lambda x: F.floor((x - low) / (high - low) * 255).cast("int")))


def to_unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.lit(255.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))
