"""Exact, tie-aware metrics and curves as aggregations over distinct scores.

Inputs have (score, truth) with truth in 0 and 1; ``keys`` name columns by which metrics are taken
apart (a class, a run), all in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.operators.rank import laid_out, meet, part_offsets, prefix_sums
from starsift.storage import written

TOP_PERCENT = (0.1, 1.0)


def score_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, pos, neg, tp, fp): counts at each distinct score, and of it and all higher ones."""
    counts = df.groupBy(*keys, "score").agg(F.sum("truth").cast("long").alias("pos"), F.sum(1 - F.col("truth")).cast("long").alias("neg"))
    return prefix_sums(written(counts, "scores"), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, keys)


def with_totals(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A score table with all positives and negatives as p and n, by join with one row per key."""
    totals = table.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return table.join(totals, list(keys)) if keys else table.join(F.broadcast(totals))


def _before(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A score table with the precision of the next higher score as last_precision (1 before the first)."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return with_totals(table, keys).withColumn("last_precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0)))


def areas(df: DataFrame, keys: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """(keys, auroc, auprc, p, n): ROC area with half for ties; trapezoids of precision over recall from (0, 1).

    Both are 0 where a class has no rows.
    """
    rows = _before(score_table(df, keys) if table is None else table, keys)
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    pr = F.sum(F.col("pos") * (precision + F.col("last_precision")) / 2)
    out = rows.groupBy(*keys, "p", "n").agg(roc.alias("roc"), pr.alias("pr"))
    good = (F.col("p") > 0) & (F.col("n") > 0)
    auroc = F.when(good, F.col("roc") / (F.col("p").cast("double") * F.col("n"))).otherwise(F.lit(0.0))
    auprc = F.when(good, F.col("pr") / F.col("p")).otherwise(F.lit(0.0))
    return out.select(*keys, auroc.alias("auroc"), auprc.alias("auprc"), "p", "n")


def pr_curve(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, recall, precision) at each distinct score, and the point (0, 1) without threshold."""
    rows = with_totals(score_table(df, keys), keys)
    points = rows.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("p")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    first = rows.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return points.unionByName(first.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")))


def roc_curve(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, fpr, tpr) at each distinct score."""
    rows = with_totals(score_table(df, keys), keys)
    return rows.select(*keys, F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def found_at(df: DataFrame, points: DataFrame, keys: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """(keys, inspected, found): anomalies among the first ``inspected`` rows by descending score, ties by filename.

    ``points`` has (keys, inspected), few for each key. A score table places each point in a group of
    equal scores. Of ``df`` only the rows of groups that a point cuts, and that hold both kinds, are put
    in order of filenames, once; each point then sums up the rows of the part that it cuts.
    """
    keys = list(keys)
    table = score_table(df, keys) if table is None else table
    last = F.col("tp") + F.col("fp")
    first = last - F.col("pos") - F.col("neg")
    met = table.join(points, keys) if keys else table.join(F.broadcast(points))
    met = met.filter((first < F.col("inspected")) & (F.col("inspected") <= last))
    whole = F.when(F.col("inspected") == last, F.col("pos")).when(F.col("pos") == 0, 0).when(F.col("neg") == 0, F.col("inspected") - first)
    met = written(met.select(*keys, "inspected", "score", first.alias("before"), (F.col("tp") - F.col("pos")).alias("found_before"), whole.alias("found_in")), "points")
    found = met.filter("found_in is not null").select(*keys, "inspected", (F.col("found_before") + F.col("found_in")).alias("found"))
    cuts = met.filter("found_in is null")
    if cuts.isEmpty():
        return found
    groups = cuts.select(*(F.col(k).alias(f"cut_{k}") for k in keys), F.col("score").alias("cut_score"), "before").distinct()
    same = F.col("score").eqNullSafe(F.col("cut_score"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"cut_{k}"))
    tied = df.select(*keys, "score", "filename", "truth").join(groups, same).select(*keys, "before", "filename", "truth")
    placed, names = laid_out(tied, [F.asc("filename")], [*keys, "before"], [F.col("truth").cast("long").alias("truth")])
    offsets = part_offsets(placed, names, {"found": F.col("truth")})
    # The part that a point cuts, and the nth of the last row before the cut.
    needed = cuts.select("inspected", "found_before", *(F.col(c).alias(n) for c, n in zip([*keys, "before"], names, strict=True)))
    needed = meet(offsets.withColumnRenamed("found_before", "found_before_part"), needed, names)
    nth = F.col("inspected") - F.col(names[-1]) - F.col("rows_before")
    needed = needed.filter((nth > 0) & (nth <= F.col("rows"))).select("inspected", *names, "part", (F.col("found_before") + F.col("found_before_part")).alias("found"), (F.col("first") + nth - 1).alias("last"))
    summed = meet(placed, needed, [*names, "part"]).filter("nth <= last").groupBy(*names, "inspected", "found").agg(F.sum("truth").alias("in_part"))
    return found.unionByName(summed.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=False)), "inspected", (F.col("found") + F.col("in_part")).alias("found")))


def _totals(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("anomalies"))


def top_percent_metrics(df: DataFrame, percents: Sequence[float] = TOP_PERCENT, keys: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """(keys, top_{p}pct_anomalies_found, top_{p}pct_precision) of (filename, score, truth).

    The top p percent are max(1, trunc(N * p / 100)) rows; both values are percentages, found is 0
    where there is no anomaly.
    """
    table = score_table(df, keys) if table is None else table
    totals = _totals(table, keys)
    limits = {p: F.greatest(F.lit(1).cast("long"), F.floor(F.col("rows") * p / 100)) for p in percents}
    points = totals.select(*keys, F.explode(F.array_distinct(F.array(*limits.values()))).alias("inspected"))
    met = found_at(df, points, keys, table)
    met = met.join(totals, list(keys)) if keys else met.join(F.broadcast(totals))
    found = [F.max(F.when(F.col("inspected") == limit, F.col("found"))).alias(f"found_{k}") for k, limit in enumerate(limits.values())]
    out = met.groupBy(*keys, "rows", "anomalies").agg(*found)
    columns = []
    for k, (p, limit) in enumerate(limits.items()):
        columns.append(F.when(F.col("anomalies") > 0, F.col(f"found_{k}") * 100.0 / F.col("anomalies")).otherwise(F.lit(0.0)).alias(f"top_{p:.1f}pct_anomalies_found"))
        columns.append((F.col(f"found_{k}") * 100.0 / limit).alias(f"top_{p:.1f}pct_precision"))
    return out.select(*keys, *columns)


#: The percentages between which inspection points lie evenly, and the points of each stretch.
INSPECTION_EDGES = (0.0001, 0.001, 0.01, 0.1, 1, 10, 100)
INSPECTION_COUNTS = (20, 30, 30, 20, 10, 10)


def inspection_percents() -> list[float]:
    return [float(x) for (a, b), n in zip(pairwise(INSPECTION_EDGES), INSPECTION_COUNTS, strict=True) for x in np.linspace(a, b, n)]


def detection_curve(df: DataFrame, keys: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """(keys, inspected, x, y) of (filename, score, truth): percent of anomalies found by percent inspected.

    Points are the rounded (half to even) distinct counts of the inspection percentages, with 0 and
    all rows. y is null where there is no anomaly, but at 0.
    """
    table = score_table(df, keys) if table is None else table
    totals = _totals(table, keys)
    counts = F.array(F.col("rows"), *(F.bround(F.col("rows") * F.lit(p) / 100).cast("long") for p in inspection_percents()))
    # At most 121 points for each key.
    points = totals.select(*keys, F.explode(F.array_distinct(F.filter(counts, lambda c: c > 0))).alias("inspected"))
    met = found_at(df, points, keys, table)
    met = met.join(totals, list(keys)) if keys else met.join(F.broadcast(totals))
    share = F.when(F.col("anomalies") > 0, 100.0 * F.col("found") / F.col("anomalies"))
    curve = met.select(*keys, "inspected", (F.col("inspected") * 100.0 / F.col("rows")).alias("x"), share.alias("y"))
    zero = totals.select(*keys, F.lit(0).cast("long").alias("inspected"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return curve.unionByName(zero)


def perfect_curve(points: DataFrame, prevalence: float | None) -> DataFrame:
    """(x, y) for x of ``points``: min(x / prevalence, 100), or x where the prevalence is unknown; prevalence is a share of 1."""
    y = F.least(F.col("x") / F.lit(prevalence), F.lit(100.0)) if prevalence else F.col("x")
    return points.select("x", y.alias("y"))


def _ends(curve: DataFrame, at: str, other: str, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(at, other)
    return curve.select(*keys, F.col(at).alias("a"), F.col(other).alias("b"), F.lead(at).over(order).alias("next_a"), F.lead(other).over(order).alias("next_b"))


def interpolated(curve: DataFrame, asked: Sequence[float], at: str = "x", other: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, point, value): linear interpolation of a curve (at most 122 points for each key), clamped at its ends.

    On a flat stretch the last matching point counts.
    """
    spark = curve.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(float(v),) for v in asked], "wanted double"))
    steps = _ends(curve.filter(F.col(at).isNotNull() & F.col(other).isNotNull()), at, other, keys)
    last = F.col("next_a").isNull()
    inside = (F.col("a") <= F.col("wanted")) & (last | (F.col("wanted") < F.col("next_a")))
    value = F.when(last, F.col("b")).otherwise(F.col("b") + (F.col("wanted") - F.col("a")) * (F.col("next_b") - F.col("b")) / (F.col("next_a") - F.col("a")))
    met = steps.join(wanted, inside).groupBy(*keys, "wanted").agg(F.max_by(value, F.col("a")).alias("value"))
    lowest = steps.groupBy(*keys).agg(F.min(F.struct("a", "b")).alias("first"), F.max("a").alias("highest"))
    every = lowest.join(wanted)
    on = [*keys, "wanted"]
    return every.join(met, on, "left").select(*keys, F.col("wanted").alias("point"), F.coalesce("value", F.when(F.col("wanted") < F.col("first.a"), F.col("first.b"))).alias("value"))


def curve_at(curve: DataFrame, xs: Sequence[float] = (0.1, 1.0, 5.0, 10.0), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, point, value): y of a detection curve at the percentages ``xs``."""
    return interpolated(curve, xs, "x", "y", keys)


def inspection_needed(curve: DataFrame, ys: Sequence[float] = (50.0, 80.0, 95.0), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, point, value): the x at which a detection curve reaches ``ys``; null where it never does."""
    highest = curve.groupBy(*keys).agg(F.max("y").alias("highest"))
    found = interpolated(curve, ys, "y", "x", keys)
    found = found.join(highest, list(keys)) if keys else found.join(F.broadcast(highest))
    return found.select(*keys, "point", F.when(F.col("point") <= F.col("highest"), F.col("value")).alias("value"))


def score_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """(truth, bin, n, density) over each class's own range of scores; the last bin takes the highest."""
    ranges = df.groupBy("truth").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("rows"))
    width = (F.col("most") - F.col("least")) / bins
    place = F.least(F.floor(F.when(width > 0, (F.col("score") - F.col("least")) / (F.col("most") - F.col("least")) * bins).otherwise(0)), F.lit(bins - 1)).cast("int")
    counts = df.join(F.broadcast(ranges), "truth").groupBy("truth", place.alias("bin"), "rows", width.alias("width")).agg(F.count("*").alias("n"))
    return counts.select("truth", "bin", "n", F.when(F.col("width") > 0, F.col("n") / (F.col("rows") * F.col("width"))).alias("density"))


def score_kde(df: DataFrame, points: int = 200) -> DataFrame:
    """(x, density): Gaussian kernel density of the scores on an even grid, bandwidth std * n ** -0.2.

    Scores are counted by distinct value before they meet the grid of ``points`` rows.
    """
    s = df.agg(F.min("score"), F.max("score"), F.stddev_samp("score"), F.count("*")).first()
    least, most, spread, n = (0.0, 0.0, 1.0, 1) if s[3] == 0 else (s[0], s[1], s[2] or 1.0, s[3])
    h = spread * n**-0.2
    counts = df.groupBy("score").agg(F.count("*").alias("times"))
    grid = F.explode(F.array(*(F.lit(float(x)) for x in np.linspace(least, most, points))))
    z = (F.col("x") - F.col("score")) / h
    return counts.withColumn("x", grid).groupBy("x").agg((F.sum(F.col("times") * F.exp(-z * z / 2)) / (n * h * np.sqrt(2 * np.pi))).alias("density"))


def evaluate(df: DataFrame, percents: Sequence[float] = TOP_PERCENT, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each key of (filename, score, truth): areas, prevalence and top-percent metrics."""
    table = score_table(df, keys)
    a = areas(df, keys, table)
    t = top_percent_metrics(df, percents, keys, table)
    out = a.join(t, list(keys)) if keys else a.join(F.broadcast(t))
    return out.withColumn("prevalence", F.col("p") / (F.col("p") + F.col("n"))).withColumnRenamed("p", "anomalies").withColumnRenamed("n", "nominals")
