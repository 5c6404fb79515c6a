"""Top-N, ranking and positions in a global order, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starsift.storage import written

#: Rows of a table that one task may order as a whole, or that every task may get.
SMALL = 1 << 16
#: Leading hexadecimal digits by which rows of a seeded order are counted: at most 16 ** DIGITS counts.
DIGITS = 4


def top_n(pred: DataFrame, n: int = 1000) -> DataFrame:
    """The n highest scores (NaN first); ties by filename. Plans as TakeOrderedAndProject."""
    return pred.orderBy(F.desc("score"), "filename").limit(n)


def rank_anomalous(pred: DataFrame) -> DataFrame:
    return pred.orderBy(F.desc("score"), "filename")


def rank_nominal(pred: DataFrame) -> DataFrame:
    return pred.orderBy("score", "filename")


def _by_gap(pred: DataFrame, centre: DataFrame) -> DataFrame:
    """Rows by distance of their score from the one row of ``centre``, as gap."""
    own = F.struct(*[F.col(f"`{c}`") for c in pred.columns]).alias("own")  # so that no column of ``pred`` clashes
    met = pred.select(own).join(F.broadcast(centre.toDF("centre")))  # one row
    gap = F.abs(F.col("own.score") - F.col("centre")).alias("gap")
    return met.select(*(F.col(f"own.`{c}`") for c in pred.columns if c != "gap"), gap).orderBy("gap", "filename")


def rank_by_mean(pred: DataFrame) -> DataFrame:
    """Rows by distance of their score from the mean, as gap (in place of a column of that name)."""
    return _by_gap(pred, pred.agg(F.avg("score")))


def rank_by_median(pred: DataFrame) -> DataFrame:
    """Rows by distance of their score from the exact median, as gap (in place of a column of that name).

    The median is the mean of the one or two middle scores by position among the distinct scores, so no
    task holds all of them.
    """
    counts = written(pred.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count("*").alias("rows")), "scores")
    placed = prefix_sums(counts, [F.asc("score")], {"up_to": F.col("rows")})
    total = counts.agg(F.sum("rows").alias("total"))
    last, first = F.col("up_to"), F.col("up_to") - F.col("rows")
    middle = placed.join(F.broadcast(total)).filter(((first * 2 < F.col("total")) & (last * 2 >= F.col("total"))) | ((first * 2 <= F.col("total")) & (last * 2 > F.col("total"))))
    return _by_gap(pred, middle.agg(F.avg("score")))  # of one or two rows


def is_small(table: DataFrame) -> bool:
    """Whether a table that is cheap to read has at most SMALL rows."""
    return table.limit(SMALL + 1).count() <= SMALL


def laid_out(df: DataFrame, order: Sequence[Column], keys: Sequence[str], columns: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """(key_0, ..., part, nth, ``columns``) of ``df`` in ranges of ``keys`` and ``order``, written; and the names of keys.

    Within a part the rows of a key stand together, and nth numbers them without gaps in ``order``.
    """
    names = [f"key_{k}" for k in range(len(keys))]
    by = [F.col(f"`{k}`") for k in keys] + list(order)
    nth = F.monotonically_increasing_id()  # rises by one within a sorted partition
    named = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).select(*named, F.spark_partition_id().alias("part"), nth.alias("nth"), *columns), "ranked"), names


def part_offsets(placed: DataFrame, names: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, part, first, rows, rows_before, {name}_before): for each key and part its first nth, and sums over the parts before."""
    totals = placed.groupBy(*names, "part").agg(F.min("nth").alias("first"), F.count("*").alias("rows"), *(F.sum(c).alias(f"in_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = {"rows_before": F.coalesce(F.sum("rows").over(earlier), F.lit(0))} | {f"{n}_before": F.coalesce(F.sum(f"in_{n}").over(earlier), F.lit(0)) for n in sums}
    return totals.withColumns(before).drop(*(f"in_{n}" for n in sums))


def meet(rows: DataFrame, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of a table by ``names``, null meeting null; each task gets the table where it is small."""
    table = written(table, "offsets")
    other = table.select(*(F.col(n).alias(f"met_{n}") for n in names), *(c for c in table.columns if c not in names))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"met_{n}"))
    return rows.join(F.broadcast(other) if is_small(table) else other, same).drop(*(f"met_{n}" for n in names))


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """``df``, which is read more than once, with each of ``sums`` over the rows up to this one in ``order`` within ``keys``.

    A small table is ordered as it is. The rows of others are range-partitioned and written, so that a
    row's part is fixed; sums of parts give each part's offset, and a window runs within a part.
    """
    if is_small(df):
        running = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*(F.col(f"`{c}`") for c in df.columns), *(F.sum(value).over(running).alias(name) for name, value in sums.items()))
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")  # so that no column of ``df`` clashes
    values = [value.alias(f"add_{name}") for name, value in sums.items()]
    out = [F.col(f"own.`{c}`") for c in df.columns]
    placed, names = laid_out(df, order, keys, [own, *values])
    offsets = part_offsets(placed, names, {name: F.col(f"add_{name}") for name in sums})
    within = Window.partitionBy(*names, "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"up_to_{name}": F.sum(f"add_{name}").over(within) for name in sums})
    met = meet(running, offsets.drop("first", "rows", "rows_before"), [*names, "part"])
    return met.select(*out, *((F.col(f"up_to_{name}") + F.col(f"{name}_before")).alias(name) for name in sums))


def global_rank(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with each row's position from 1 in ``order`` (within ``keys``) as ``name``.

    One shuffle: the rows of a part are numbered as they are written, and a part's offset makes of that
    the position.
    """
    placed, names = laid_out(df, order, keys, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own")])
    met = meet(placed, part_offsets(placed, names, {}).drop("rows"), [*names, "part"])
    place = F.col("rows_before") + F.col("nth") - F.col("first") + 1
    return met.select(*(F.col(f"own.`{c}`") for c in df.columns), place.alias(name))


def by_score(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``pred`` with rank by descending score, ties by filename."""
    return global_rank(pred, [F.desc("score"), F.asc("filename")], keys)


def top_k_per_class(df: DataFrame, k: int, cls: str, order: Sequence[Column]) -> DataFrame:
    """The first k rows of each class in ``order``, with their place as nth. Plans as WindowGroupLimit."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).filter(F.col("nth") <= k)


def gallery(pred: DataFrame, k: int = 5) -> DataFrame:
    """The k highest and k lowest scores, fewer where there are less than 2k rows, with their side and place."""
    n = pred.count()
    k = min(k, n // 2)
    high = pred.orderBy(F.desc("score"), "filename").limit(k).withColumn("side", F.lit("highest"))
    low = pred.orderBy("score", "filename").limit(k).withColumn("side", F.lit("lowest"))
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "highest", -F.col("score")).otherwise(F.col("score")), "filename")
    return high.unionByName(low).withColumn("nth", F.row_number().over(order))


def most_wrong(df: DataFrame, k: int = 10) -> DataFrame:
    """Rows of (score, label in 0 and 1) by distance of score and label, without exact ones, the first k."""
    gap = F.abs(F.col("score") - F.col("label"))
    return df.withColumn("gap", gap).filter("gap <> 0").orderBy(F.desc("gap"), "filename").limit(k)


def cursor_page(ranked: DataFrame, start: int, n: int, total: int) -> DataFrame:
    """n rows of a table with rank from position ``start``, which is clamped to 0 and total - 1."""
    start = max(0, min(start, total - 1))
    return ranked.filter((F.col("rank") > start) & (F.col("rank") <= start + n))


def stable_order(seed: int, name: str = "filename") -> Column:
    """A seeded order of names that any engine can repeat: MD5 of seed and name."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(name)))


def stable_shuffle(files: DataFrame, seed: int) -> DataFrame:
    """``files`` with their position in one seeded permutation as rank."""
    return global_rank(files.withColumn("order_key", stable_order(seed)), [F.asc("order_key"), F.asc("filename")]).drop("order_key")


def n_batches(files: DataFrame, labeled: DataFrame, n_to_load: int) -> DataFrame:
    """One row: unlabeled files and the batches they make."""
    left = files.join(labeled, "filename", "left_anti").agg(F.count("*").alias("unlabeled"))
    return left.select("unlabeled", F.ceil(F.col("unlabeled") / n_to_load).cast("long").alias("batches"))


def ranked_between(rows: DataFrame, seed: int, first: int, n: int) -> tuple[DataFrame, int]:
    """(the rows at positions first + 1 to first + n of the seeded order, with rank; the number of all rows).

    Rows are counted by the leading digits of their order first; those of the prefixes within which the
    positions lie are ordered, and no other row is. ``rows`` is read twice.
    """
    key = stable_order(seed)
    counts = rows.groupBy(F.substring(key, 1, DIGITS).alias("prefix")).agg(F.count("*").alias("rows"))
    counts = written(counts, "prefixes")  # at most 16 ** DIGITS rows
    upto = F.sum("rows").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    needed = counts.withColumn("upto", upto).filter((F.col("upto") > first) & (F.col("upto") - F.col("rows") < first + n))
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("own")
    some = rows.select(own, key.alias("place"), F.substring(key, 1, DIGITS).alias("start"))
    some = some.join(F.broadcast(needed.select(F.col("prefix").alias("start"), (F.col("upto") - F.col("rows")).alias("before"))), "start")
    within = Window.partitionBy("start").orderBy("place", F.col("own.filename"))
    ranked = some.withColumn("rank", F.col("before") + F.row_number().over(within)).filter((F.col("rank") > first) & (F.col("rank") <= first + n))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return ranked.select(*(F.col(f"own.`{c}`") for c in rows.columns), "rank"), total


def next_unlabeled_batch(files: DataFrame, labeled: DataFrame, cursor: int, n: int, seed: int = 42) -> tuple[DataFrame, int]:
    """The next n unlabeled files of the seeded order from ``cursor``, with rank, and the next cursor.

    The last batch may be short; the cursor then returns to 0, as it does from beyond the end. The
    cursor counts in the list of files that are unlabeled now.
    """
    left = files.join(labeled.select("filename"), "filename", "left_anti").select(*(F.col(f"`{c}`") for c in files.columns))
    batch, total = ranked_between(left, seed, cursor, n)
    if not total:
        return batch, cursor
    return batch, 0 if cursor + n >= total else cursor + n
