"""Label tables: reading and checking, last write wins, joins on filename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNKNOWN, NORMAL, ANOMALY = -1, 0, 1
NAMES = {"normal": NORMAL, "anomaly": ANOMALY}


def encode(name: Column) -> Column:
    """0 for normal, 1 for anomaly in either case; any other name raises an error."""
    low = F.lower(name)
    return F.when(low == "normal", F.lit(NORMAL)).when(low == "anomaly", F.lit(ANOMALY)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(name, F.lit("null")))).cast("int"))


def decode(label: Column) -> Column:
    """The name of 0 and 1, null of any other value."""
    return F.when(label == NORMAL, F.lit("normal")).when(label == ANOMALY, F.lit("anomaly"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A header CSV with filename and label; further columns stay. Raises where a column or a known name lacks."""
    df = spark.read.option("header", True).csv(path)
    missing = {"filename", "label"} - set(df.columns)
    if missing:
        raise ValueError(f"label table lacks {sorted(missing)}")
    bad = validation(df).first()["invalid"]
    if bad:
        raise ValueError(f"{bad} labels are neither normal nor anomaly")
    return df


def write_labels(df: DataFrame, path: str) -> None:
    """All columns of ``df``, filename and label first."""
    df.select("filename", "label", *(f"`{c}`" for c in df.columns if c not in ("filename", "label"))).write.mode("overwrite").option("header", True).csv(path)


def validation(df: DataFrame) -> DataFrame:
    """One row: rows, and those whose label is neither normal nor anomaly (as written)."""
    good = F.coalesce(F.col("label").isin(*NAMES), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum((~good).cast("long")), F.lit(0)).alias("invalid"))


def latest(edits: DataFrame, order: list[str], key: str = "filename", value: str = "label") -> DataFrame:
    """(key, value) of the last edit of each key in ``order``."""
    return edits.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def upsert(base: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """``base``, one row for each filename, with its label overwritten by the last of ``edits``.

    All rows and columns of ``base`` stay; files that only the edits know have null in the others. A
    filename that repeats in ``base`` has one row after.
    """
    rest = [c for c in base.columns if c not in ("filename", "label")]
    own = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))) if rest else F.struct(F.lit(0).alias("c"))
    rows = base.select("filename", "label", own.alias("own"), F.lit(0).alias("priority"))
    both = rows.unionByName(latest(edits, order).withColumn("priority", F.lit(1)), allowMissingColumns=True)
    kept = both.groupBy("filename").agg(F.max_by("label", "priority").alias("label"), F.max_by("own", F.when(F.col("own").isNotNull(), F.hash("label"))).alias("own"))
    columns = {"filename": F.col("filename"), "label": F.col("label")} | {c: F.col(f"own.c{k}") for k, c in enumerate(rest)}
    return kept.select(*(columns[c].alias(c) for c in base.columns))


def changes(base: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """One row: base labels that the edits change, and filenames that are new."""
    old = base.select("filename", F.col("label").alias("old_label"))
    met = latest(edits, order).join(old, "filename", "left")
    changed = F.col("old_label").isNotNull() & (F.col("old_label") != F.col("label")) & (F.col("old_label") != "unknown")
    return met.agg(F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("changed"), F.coalesce(F.sum(F.col("old_label").isNull().cast("long")), F.lit(0)).alias("added"))


def distribution(base: DataFrame, edits: DataFrame, order: list[str]) -> DataFrame:
    """(label, count) after the edits."""
    return upsert(base, edits, order).groupBy("label").agg(F.count("*").alias("count"))


def remember(files: DataFrame, key: str = "filename", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(key, ts): the first row of each key."""
    return files.groupBy(key).agg(F.min_by("ts", F.struct(*order)).alias("ts"))


def extend_train(split: DataFrame, labels: DataFrame) -> DataFrame:
    """(filename, split): files with a new label go to train unless they are in test."""
    new = labels.select("filename").distinct().join(split.filter("split = 'test'"), "filename", "left_anti").select("filename", F.lit("train").alias("split"))
    return split.select("filename", "split").unionByName(new).distinct()


def training_checks(labels: DataFrame, files: DataFrame) -> DataFrame:
    """One row: unlabeled files, whether none is left, whether only one class is labeled."""
    left = files.join(labels, "filename", "left_anti").agg(F.count("*").alias("unlabeled"))
    classes = labels.agg(F.countDistinct("label").alias("classes"))
    return left.join(F.broadcast(classes)).select("unlabeled", (F.col("unlabeled") == 0).alias("no_unlabeled"), (F.col("classes") < 2).alias("one_class"))


def attach_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner join on filename; duplicates multiply."""
    return pred.join(truth, "filename")


def drop_labeled(pred: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """The predictions without a label; ``key`` is what tells files apart."""
    return pred.join(labels.select(key), key, "left_anti")


def restrict_to_batch(pred: DataFrame, batch: DataFrame, key: str = "filename") -> DataFrame:
    """The predictions of a batch's files; ``key`` is what tells files apart."""
    return pred.join(batch.select(key), key, "left_semi")


existing_labels = existing_files = restrict_to_batch


def orphans(labels: DataFrame, files: DataFrame) -> DataFrame:
    """One row: labels whose file exists, and labels without one."""
    met = labels.select("filename").join(files.select("filename").distinct().withColumn("there", F.lit(1)), "filename", "left")
    return met.agg(F.coalesce(F.sum(F.col("there").isNotNull().cast("long")), F.lit(0)).alias("existing"), F.coalesce(F.sum(F.col("there").isNull().cast("long")), F.lit(0)).alias("orphans"))


def label_of(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """``pred`` with label, and shown as Anomalous, Nominal or None."""
    met = pred.join(labels.select("filename", "label"), "filename", "left")
    shown = F.when(F.col("label") == "anomaly", "Anomalous").when(F.col("label") == "normal", "Nominal").otherwise("None")
    return met.withColumn("label", F.coalesce("label", F.lit("None"))).withColumn("shown", shown)


def available_filenames(*tables: DataFrame) -> DataFrame:
    names = [t.select("filename") for t in tables]
    out = names[0]
    for t in names[1:]:
        out = out.union(t)
    return out.distinct()


def index_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with label_idx, the place of its label among the sorted distinct ones from 0.

    Only the distinct labels are ordered in one task.
    """
    index = df.select(label).distinct().withColumn("label_idx", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(index, label)


def class_names(df: DataFrame, names: dict[int, str], label: str = "label_idx") -> DataFrame:
    """``df`` with class_name; null for classes without a name."""
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn("class_name", F.try_element_at(pairs, F.col(label).cast("int")))


def make_filename(kind: str, split: Column, label: Column, row: Column) -> Column:
    """The generated names of the two known collections."""
    number = F.lpad(row.cast("string"), 5, "0")
    if kind == "miniimagenet":
        return F.concat(F.lit("miniimagenet_"), split, F.lit("_"), F.regexp_replace(label, "n", ""), F.lit("_"), number, F.lit(".jpeg"))
    return F.concat(F.lit("galaxymnist_"), split, F.lit("_"), number, F.lit("_"), label, F.lit(".jpeg"))


#: Parts of a path that name a kind of run, the first that is found.
RUN_TYPES = ("n_samples_ablation", "active_learning", "training_iterations", "miniimagenet", "galaxymnist")


def run_type(path: Column) -> Column:
    out = None
    for name in RUN_TYPES:
        out = F.when(path.contains(name), name) if out is None else out.when(path.contains(name), name)
    return out


def one_vs_rest(df: DataFrame, cls: int, label: str = "label_idx") -> DataFrame:
    """``df`` with truth: 1 for class ``cls``, else 0."""
    return df.withColumn("truth", (F.col(label) == cls).cast("int"))


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score > threshold, 1).otherwise(0)


def confusion_subset(df: DataFrame, which: str) -> DataFrame:
    """Rows of (score, truth) that are false positives ('fp') or false negatives ('fn')."""
    truth = 0 if which == "fp" else 1
    return df.filter((F.col("truth") == truth) & (predicted(F.col("score")) == 1 - truth))


def find_corrections(df: DataFrame, n: int) -> DataFrame:
    """(filename, label, score) of (filename, score, truth): the n // 2 highest scores of each class, labeled by truth."""
    from starsift.operators.rank import top_k_per_class

    best = top_k_per_class(df, n // 2, "truth", [F.desc("score"), F.asc("filename")])
    return best.select("filename", F.when(F.col("truth") == 1, "anomaly").otherwise("normal").alias("label"), "score")


def not_in_classes(df: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """The rows whose class is none of ``classes``; a null class is none of them."""
    return df.filter(~F.coalesce(F.col(label).isin(*classes), F.lit(False)))


def stamp(ts: Column) -> Column:
    """A time as people read it."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def run_id(ts: Column) -> Column:
    """A time as runs are named."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def duration(seconds: Column) -> Column:
    """A number of seconds as hours:minutes:seconds."""
    part = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat_ws(":", F.floor(seconds / 3600).cast("string"), part(seconds % 3600 / 60), part(seconds % 60))
