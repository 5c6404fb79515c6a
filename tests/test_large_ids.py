"""Ids of six digits: their image names repeat, their vectors don't."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from starsift import queries as Q
from starsift.sources import images as I


@pytest.fixture(scope="module")
def large_ids(spark, sf, tmp_path_factory):
    """A folder whose embeddings have the ids 10000 to 10029, and 100000 to 100299, which share their names."""
    folder = str(tmp_path_factory.mktemp("large_ids"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id < 330")
    moved = F.when(F.col("vec_id") < 30, F.col("vec_id") + 10_000).otherwise(F.col("vec_id") + 99_970)
    rows.withColumn("vec_id", moved).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def check_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet/*.parquet')")
    result = con.execute(Q.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    rounded = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    found = rounded(Q.queries()[name](spark, folder).select(*columns).collect())
    assert len({r[0] for r in found}) < len(found)
    assert found == rounded(result.fetchall())


def test_a_task_without_images_gives_no_rows(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert I.decode_images(I.read_images(spark, str(tmp_path)), 4).collect() == []


def test_decoded_images_are_told_apart_by_id(spark, large_ids):
    check_against_sql(spark, large_ids, "decoded_images")


def test_a_folder_without_images_gives_no_resized_ones(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert I.resize_and_write(I.read_images(spark, str(tmp_path)), 4, str(tmp_path / "blobs")).collect() == []


def test_resized_images_are_told_apart_by_id(spark, large_ids):
    check_against_sql(spark, large_ids, "resized_images")


def test_labeled_rows_are_dropped_by_id(spark, large_ids):
    check_against_sql(spark, large_ids, "anti_labeled")


def test_rows_of_a_batch_are_found_by_id(spark, large_ids):
    check_against_sql(spark, large_ids, "semi_batch")
