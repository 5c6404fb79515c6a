"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from starsift.functions import metrics as M  # noqa: E402
from starsift.operators import rank as R  # noqa: E402
from starsift.plans import fixmatch  # noqa: E402
from starsift.operators import sampling as S  # noqa: E402
from starsift.queries import queries  # noqa: E402


def big(spark: SparkSession, d: str) -> DataFrame:
    """(filename, score, truth) of all line items: many ties, keys from all columns that tell rows apart."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    return rows.select(name.alias("filename"), (F.col("l_discount") * 10 + F.col("l_tax")).cast("double").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("truth"))


def bigger(spark: SparkSession, d: str) -> DataFrame:
    """:func:`big` ten times, with names of their own."""
    return big(spark, d).withColumn("filename", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat("filename", F.lit("-"), k.cast("string")))))


def next_batch(spark: SparkSession, d: str) -> DataFrame:
    files = big(spark, d).select("filename")
    return R.next_unlabeled_batch(files, files.filter("crc32(filename) % 3 = 0"), 1000, 2500)[0]


def trained(spark: SparkSession, d: str) -> DataFrame:
    from starsift.queries import _training

    fitted = fixmatch.fit(_training(spark, d), fixmatch.Config(steps=20))
    return spark.createDataFrame([(len(fitted.history), fitted.history[-1]["total_loss"])], "steps int, loss double")


HEADLINE = {
    "topn": lambda s, d: R.top_n(big(s, d), 1000),
    "auroc": lambda s, d: M.areas(big(s, d)),
    "top_percent": lambda s, d: M.top_percent_metrics(big(s, d)),
    "detection_curve": lambda s, d: M.detection_curve(big(s, d)),
    "evaluate": lambda s, d: M.evaluate(big(s, d)),
    "global_rank": lambda s, d: R.by_score(big(s, d)),
    "score_linear": queries()["score_linear"],
    "search": queries()["search"],
    "multi_class_metrics": queries()["multi_class_metrics"],
    "fixmatch_20_steps": trained,
    "next_unlabeled_batch": next_batch,
    "stratified_split": lambda s, d: S.stratified_split(big(s, d).withColumnRenamed("truth", "label"), 0.2),
    "stream_labels": queries()["stream_labels"],
    "stream_topn": queries()["stream_topn"],
    "evaluate_x10": lambda s, d: M.evaluate(bigger(s, d)),
}
#: Runs of each query; the median counts.
RUNS = 3


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    HEADLINE["topn"](spark, d).count()  # starts the JVM and reads the files once
    took = {}
    for name, f in HEADLINE.items():
        runs = []
        for _ in range(RUNS):
            began = time.time()
            f(spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total median seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
