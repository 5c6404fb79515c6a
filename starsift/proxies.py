"""Tables that stand for score, label, image and stream inputs, made from the given ones by Spark; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.functions.vector import dot
from starsift.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_name() -> Column:
    """Five digits of vec_id, so ids of six share names: what must tell vectors apart goes by vec_id."""
    return F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 5, "0"), F.lit(".jpeg"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, filename, label_idx, features)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", image_name().alias("filename"), F.col("label").alias("label_idx"), F.col("embedding").cast("array<double>").alias("features"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, filename, label_idx, score): a sigmoid of the product with the mean vector of class 1."""
    v = vectors(spark, sf_dir)
    means = v.filter("label_idx = 1").select(F.posexplode("features")).groupBy("pos").agg(F.avg("col").alias("m"))
    centre = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centre"))  # one number for each dimension
    return v.join(F.broadcast(centre)).select("vec_id", "filename", "label_idx", F.round(1 / (1 + F.exp(-10 * dot(F.col("features"), F.col("centre")))), 9).alias("score"))


SCORES = """c AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE label = 1 GROUP BY i)),
p AS (SELECT vec_id, 'img_' || lpad(vec_id::VARCHAR, 5, '0') || '.jpeg' AS filename, label AS label_idx,
 round(1 / (1 + exp(-10 * list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * centre[i])))), 9) AS score FROM embeddings, c)"""
VECTORS = "v AS (SELECT vec_id, 'img_' || lpad(vec_id::VARCHAR, 5, '0') || '.jpeg' AS filename, label AS label_idx, embedding::DOUBLE[] AS features FROM embeddings)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`scores` with truth for class 1."""
    return scores(spark, sf_dir).withColumn("truth", (F.col("label_idx") == 1).cast("int"))


JUDGED = SCORES + ", t AS (SELECT *, (label_idx = 1)::INT AS truth FROM p)"


def ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, score, truth) with many equal scores: length classes of labeled documents."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("filename"), (F.least(F.expr("(n_chars + 25) div 50"), F.lit(100)) / 100.0).alias("score"), F.col("toxic").cast("int").alias("truth"))


TIES = "t AS (SELECT doc_id::VARCHAR AS filename, least((n_chars + 25) // 50, 100)::DOUBLE / 100 AS score, toxic::INT AS truth FROM documents JOIN labels USING (doc_id))"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, weak, strong, label): two pairs of logits for each vector, and class 1 or not."""
    pair = lambda a, b: F.array(F.col("features")[a] * 20, F.col("features")[b] * 20)
    return vectors(spark, sf_dir).select("filename", pair(0, 1).alias("weak"), pair(2, 3).alias("strong"), (F.col("label_idx") == 1).cast("int").alias("label"))


LOGITS = VECTORS + ", l AS (SELECT filename, features[1] * 20 AS w0, features[2] * 20 AS w1, features[3] * 20 AS s0, features[4] * 20 AS s1, (label_idx = 1)::INT AS label FROM v)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, filename, px): 8 x 8 gray images of the vectors' components."""
    return vectors(spark, sf_dir).select("vec_id", "filename", F.transform("features", lambda x: F.floor((x + 1) * 127.5).cast("int")).alias("px"))


PIXELS = VECTORS + ", g AS (SELECT filename, list_transform(features, lambda x: floor((x + 1) * 127.5)::INT) AS px FROM v)"


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, label, ts, event_id): label clicks by user."""
    label = F.when(F.col("event_type").isin("view", "click"), "normal").when(F.col("event_type") == "error", "anomaly")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("filename"), label.alias("label"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return rows.filter("label is not null")


LABEL_EVENTS = "e AS (SELECT user_id::VARCHAR AS filename, CASE WHEN event_type IN ('view', 'click') THEN 'normal' ELSE 'anomaly' END AS label, ts, event_id FROM events WHERE event_type IN ('view', 'click', 'error'))"


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, user, score, source, ts) of the events."""
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("filename"), F.col("user_id").cast("string").alias("user"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))


STREAM = "s AS (SELECT event_id::VARCHAR AS filename, user_id::VARCHAR AS user_name, least(value / 500, 1.0)::DOUBLE AS score, event_type AS source, ts FROM events)"


def as_stream(df: DataFrame, files: int = 4, per_batch: int = 1) -> DataFrame:
    """``df`` as a stream of files by ranges of ts, ``per_batch`` a batch; which comes first isn't sure."""
    rows = written(df.repartitionByRange(files, "ts").sortWithinPartitions("ts"), "stream")
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def history(spark: SparkSession, sf_dir: str, classes: range = range(10)) -> DataFrame:
    """(anomaly_class, iteration, filename, score, truth): four slices of the vectors as iterations, each class against the rest."""
    rows = scores(spark, sf_dir).withColumn("iteration", (F.col("vec_id") % 4).cast("int")).withColumn("anomaly_class", F.explode(F.array(*map(F.lit, classes))))
    return rows.withColumn("truth", (F.col("label_idx") == F.col("anomaly_class")).cast("int"))


HISTORY = SCORES + ", h AS (SELECT anomaly_class::INT AS anomaly_class, (vec_id % 4)::INT AS iteration, filename, score, (label_idx = anomaly_class)::INT AS truth FROM p, range(10) r(anomaly_class))"
