"""Counts, statistics and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.operators.labels import predicted
from starsift.operators.rank import global_rank


def score_stats(pred: DataFrame) -> DataFrame:
    """One row: rows, least, most, mean, population and sample deviation of the scores."""
    return pred.agg(F.count("*").alias("rows"), F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.stddev_samp("score").alias("std_sample"))


def class_distribution(truth: DataFrame, label: str = "label_idx") -> DataFrame:
    return truth.groupBy(label).agg(F.count("*").alias("count"))


def prevalence(truth: DataFrame, cls: int, label: str = "label_idx") -> DataFrame:
    """One row: anomalies of the class, rows, and their ratio."""
    out = truth.agg(F.sum((F.col(label) == cls).cast("long")).alias("anomalies"), F.count("*").alias("rows"))
    return out.withColumn("prevalence", F.col("anomalies") / F.col("rows"))


def channel_stats(pixels: DataFrame, batch: int = 100, exact: bool = False) -> DataFrame:
    """(channel, mean, std) of (filename, channel, values array over 0 to 1).

    Per batch of images in the order of filenames a mean and a population deviation, then their plain
    mean, so a short last batch weighs as much as a full one; with ``exact`` over all pixels.
    """
    parts = pixels.select("filename", "channel", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x).alias("s"), F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    if exact:
        parts = parts.withColumn("batch", F.lit(0))
    else:
        names = global_rank(parts.select("filename").distinct(), [F.asc("filename")])
        parts = parts.join(names.select("filename", F.floor((F.col("rank") - 1) / batch).alias("batch")), "filename")
    sums = parts.groupBy("channel", "batch").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    each = sums.select("channel", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    return each.groupBy("channel").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def summary_by(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def mean_pm_std(runs: DataFrame, values: Sequence[str], keys: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """Mean and sample deviation of values, each rounded to 2 decimals first unless told otherwise."""
    own = (lambda v: F.round(v, 2)) if rounded else F.col
    return runs.groupBy(*keys).agg(*(f(own(v)).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def count_by_source(files: DataFrame, source: str = "source") -> DataFrame:
    return files.groupBy(source).agg(F.count("*").alias("images"))


def throughput(pred: DataFrame, total: int | None = None) -> DataFrame:
    """One row of (ts): rows, seconds from first to last, rows a second, and with ``total`` percent done and seconds left."""
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    out = pred.agg(F.count("*").alias("rows"), seconds.alias("seconds")).withColumn("rate", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))
    if total is None:
        return out
    return out.withColumn("percent", F.col("rows") * 100.0 / total).withColumn("eta", (total - F.col("rows")) / F.col("rate"))


def confusion_matrix(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of (score, truth): tn, fp, fn, tp."""
    p = predicted(F.col("score"), threshold)
    cell = lambda t, k: F.coalesce(F.sum(((F.col("truth") == t) & (p == k)).cast("long")), F.lit(0))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def topk_accuracy(df: DataFrame, ks: Sequence[int], scores: str = "scores", label: str = "label") -> DataFrame:
    """One row: percent of rows whose label (from 0) is among the k largest scores; equal scores by class."""
    pairs = F.transform(F.col(scores), lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    order = F.transform(F.sort_array(pairs), lambda p: p["i"])
    hits = df.select(F.array_position(order, F.col(label).cast("int")).alias("place"))
    return hits.agg(*((F.avg(((F.col("place") > 0) & (F.col("place") <= k)).cast("double")) * 100).alias(f"top{k}") for k in ks))


def best_iteration(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, iteration, accuracy): the highest accuracy, the earliest on ties."""
    best = F.max(F.struct(F.col("accuracy"), (-F.col("iteration")).alias("turn")))
    return history.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.turn")).alias("iteration"), F.col("b.accuracy").alias("accuracy"))


def metrics_history(runs: DataFrame, batch_size: int) -> DataFrame:
    return runs.select("iteration", (F.col("iteration") * batch_size).alias("training_batch"), "auroc", "auprc")


def run_summary(history: DataFrame, keys: Sequence[str] = (), values: Sequence[str] = ("auroc", "auprc")) -> DataFrame:
    """Per run: values at iteration 0 (baseline), 1 (first; baseline if there is none) and the last, and last minus first."""
    pick = lambda v, k: F.max(F.when(F.col("iteration") == k, F.col(v)))
    out = history.groupBy(*keys).agg(*(c for v in values for c in (pick(v, 0).alias(f"baseline_{v}"), F.coalesce(pick(v, 1), pick(v, 0)).alias(f"first_{v}"), F.max_by(v, "iteration").alias(f"final_{v}"))))
    return out.withColumns({f"improvement_{v}": F.col(f"final_{v}") - F.col(f"first_{v}") for v in values})


def split_summary(labels: DataFrame, first: DataFrame) -> DataFrame:
    """One row: anomalies and nominals at first, and all labeled now."""
    start = first.agg(F.sum((F.col("label") == "anomaly").cast("long")).alias("initial_anomalies"), F.sum((F.col("label") == "normal").cast("long")).alias("initial_nominals"))
    return start.join(F.broadcast(labels.agg(F.count("*").alias("total_labeled"))))


def union_runs(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_splits(**splits: DataFrame) -> DataFrame:
    """All tables end to end, with the name of each as split."""
    return union_runs(*(df.withColumn("split", F.lit(name)) for name, df in splits.items()))


def overlap(splits: DataFrame, key: str = "filename", split: str = "split") -> DataFrame:
    """One row: keys that stand in more than one split, and all keys. Splits are disjoint where the first is 0."""
    own = splits.groupBy(key).agg((F.min(split) != F.max(split)).cast("long").alias("several"))
    return own.agg(F.coalesce(F.sum("several"), F.lit(0)).alias("shared"), F.count("*").alias("keys"))


def dedup_latest(pred: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``, as a whole."""
    rest = [c for c in pred.columns if c not in keys]
    return pred.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("nth = 1").drop("nth")
