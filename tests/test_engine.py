"""What SQL can't say: sources, errors, views, training, streams, plans."""

from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starsift.functions import metrics as M
from starsift.functions import pixels as X
from starsift.functions import vector as V
from starsift.operators import aggregates as A
from starsift.operators import labels as L
from starsift.operators import rank as R
from starsift.operators import sampling as S
from starsift.plans import fixmatch, rounds, scoring
from starsift.sources import images as I
from starsift.storage import new_path
from starsift.streaming import search as T


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    raw = b"".join(b"\0" + pixels[k].tobytes() for k in range(h))
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


RED = np.zeros((8, 8, 3), np.uint8)
RED[..., 0] = 200


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.png").write_bytes(png(RED))
    (tmp_path / "b.PNG").write_bytes(png(np.full((8, 8), 7, np.uint8)))
    (tmp_path / "c.png").write_bytes(png(np.dstack([RED, np.full((8, 8), 9, np.uint8)])))
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_images_are_rgb_and_bad_ones_follow_the_policy(spark, folder):
    rows = I.read_images(spark, folder)
    assert {r["filename"] for r in rows.collect()} == {"a.png", "b.PNG", "c.png", "bad.png"}
    out = {r["filename"]: np.frombuffer(r["pixels"], np.uint8).reshape(4, 4, 3) for r in I.decode_images(rows, 4).collect()}
    assert set(out) == {"a.png", "b.PNG", "c.png"}
    assert (out["a.png"] == [200, 0, 0]).all() and (out["c.png"] == [200, 0, 0]).all() and (out["b.PNG"] == 7).all()
    assert I.decode_images(rows, 4, "blank").count() == 4
    with pytest.raises(Exception, match="not an image"):
        I.decode_images(rows, 4, "fail").collect()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_zip_entries_come_from_several_tasks(spark, tmp_path, method):
    rng = np.random.default_rng(method)
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"s{k}.zip", "w", method) as z:
            z.comment = b"a comment behind the directory"
            z.writestr("note.txt", b"3")
            for n in range(30):
                z.writestr(f"x/{k}_{n}.{'JPG' if n % 2 else 'png'}", rng.bytes(int(rng.integers(0, 3000))))
    rows = I.read_zip_images(spark, str(tmp_path), size=8192)
    tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("source", "task").agg(F.sum(F.length("content")).alias("bytes")).collect()
    for k in range(2):
        own = [r for r in tasks if r["source"].endswith(f"s{k}.zip")]
        assert len(own) >= 3 and max(r["bytes"] for r in own) < sum(r["bytes"] for r in own)
        with zipfile.ZipFile(tmp_path / f"s{k}.zip") as z:
            expected = {n: z.read(n) for n in z.namelist() if not n.endswith(".txt")}
        assert {r["filename"]: bytes(r["content"]) for r in rows.filter(F.col("source").endswith(f"s{k}.zip")).collect()} == expected


def test_a_damaged_zip_entry_is_an_error(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.png", b"0123456789")
    (tmp_path / "d.zip").write_bytes(data.getvalue().replace(b"0123456789", b"0123456780"))
    with pytest.raises(Exception, match="checksum"):
        I.read_zip_images(spark, str(tmp_path)).collect()


def test_listed_files(spark, tmp_path):
    contents = {f"f{k:02d}.png": bytes([k]) * (k * 37) for k in range(40)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    lines = [f"  {tmp_path / n} " for n in contents] + ["", str(tmp_path / "gone.png"), (tmp_path / "f07.png").as_uri()]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    rows = I.read_listed_files(spark, str(tmp_path / "list.txt"), size=4000)
    assert {(r["filename"], bytes(r["content"])) for r in rows.collect()} == set(contents.items())
    assert rows.count() == 41  # a line for each row
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("content")).alias("bytes")).collect()
    assert len(tasks) >= 4 and max(r["bytes"] for r in tasks) <= 4000 + 39 * 37
    gone = [r for r in I.read_listed_files(spark, str(tmp_path / "list.txt"), "null").collect() if r["content"] is None]
    assert [r["filename"] for r in gone] == ["gone.png"]
    with pytest.raises(Exception, match="gone.png"):
        I.read_listed_files(spark, str(tmp_path / "list.txt"), "fail").collect()
    (tmp_path / "empty.txt").write_text("")
    assert I.read_listed_files(spark, str(tmp_path / "empty.txt")).count() == 0


def test_nested_images_and_stored_winners(spark, tmp_path):
    row = spark.createDataFrame([(bytearray(b"x"), "n0153")], "bytes binary, label string").select(F.struct("bytes").alias("image"), "label")
    for split in ("train", "test"):
        row.coalesce(1).write.parquet(str(tmp_path / f"w-{split}"))
        (tmp_path / "nested").mkdir(exist_ok=True)
        next((tmp_path / f"w-{split}").glob("*.parquet")).rename(tmp_path / "nested" / f"{split}-00000.parquet")
    rows = I.read_nested_images(spark, str(tmp_path / "nested")).collect()
    assert {(r["split"], r["label"], bytes(r["content"])) for r in rows} == {("train", "n0153", b"x"), ("test", "n0153", b"x")}
    best = spark.createDataFrame([("d/a.png", 0.9, bytearray(b"p"))], "filename string, score double, pixels binary")
    I.write_topn(best, str(tmp_path / "top"))
    assert I.read_topn(spark, str(tmp_path / "top")).first()["filename"] == "a.png"
    assert I.append_predictions(best, str(tmp_path / "store")).count() == 1
    assert I.append_predictions(best, str(tmp_path / "store")).count() == 2


def test_image_stream(spark, folder, tmp_path_factory):
    out, progress = new_path(spark, "found"), new_path(spark, "progress")
    T.stream_search(I.stream_images(spark, folder), lambda df: df.select("filename", F.length("content").cast("double").alias("score")), out, progress).awaitTermination()
    assert {r["filename"] for r in spark.read.parquet(out).collect()} == {"a.png", "b.PNG", "c.png", "bad.png"}


@pytest.mark.parametrize(("h", "w", "size"), [(7, 5, 3), (3, 4, 6), (8, 8, 4), (1, 9, 2)])
def test_resize_by_area(h, w, size):
    pixels = np.random.default_rng(h * w).integers(0, 256, (h, w, 3)).astype(np.uint8)
    fine = pixels.astype(float).repeat(size, axis=0).repeat(size, axis=1)  # whole blocks of h * w cells each
    means = fine.reshape(size, h, size, w, 3).mean(axis=(1, 3))
    assert (I.resize_area(pixels, size) == np.floor(np.round(means, 6) + 0.5)).all()


def test_points_that_cut_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(k, f"f{i:03d}", float(rng.integers(0, 4)), int(rng.integers(0, 2))) for k in ("a", "b") for i in range(60)]
    rows += [("c", "x", None, 1), ("c", "y", None, 0), ("c", "z", 0.5, 0)]
    df = spark.createDataFrame(rows, "k string, filename string, score double, truth int")
    points = spark.createDataFrame([(k, i) for k in ("a", "b") for i in range(1, 61)] + [("c", 1), ("c", 2), ("c", 3)], "k string, inspected long")
    found = {(r["k"], r["inspected"]): r["found"] for r in M.found_at(df, points, ["k"]).collect()}
    expected = {}
    for k in ("a", "b", "c"):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        expected |= {(k, i + 1): sum(r[3] for r in own[: i + 1]) for i in range(len(own))}
    assert found == expected


def test_label_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("filename,label,note\na,normal,x\nb,anomaly,\n")
    df = L.read_labels(spark, str(tmp_path / "l.csv"))
    assert df.columns == ["filename", "label", "note"]
    L.write_labels(df, str(tmp_path / "out"))
    assert L.read_labels(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.csv").write_text("filename,label\na,Normal\n")
    with pytest.raises(ValueError, match="neither"):
        L.read_labels(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "lack.csv").write_text("filename\na\n")
    with pytest.raises(ValueError, match="lacks"):
        L.read_labels(spark, str(tmp_path / "lack.csv"))
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("x",)], "label string").select(L.encode(F.col("label"))).collect()


def test_summaries_lists_and_split_tables(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run{k}").mkdir()
        (tmp_path / f"run{k}" / "results_summary.csv").write_text(f"final_auroc\n0.{k}\n")
    rows = {r["run_dir"].rsplit("/", 1)[1]: r["final_auroc"] for r in I.read_summaries(spark, str(tmp_path)).collect()}
    assert rows == {"run1": 0.1, "run2": 0.2}
    (tmp_path / "list.txt").write_text(" a.png \n\nb.png\n")
    assert [r["path"] for r in I.read_file_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.png", "b.png"]
    df = spark.createDataFrame([("a", 1), ("b", -1), ("c", -1)], "filename string, label int")
    I.write_split_tables(df, str(tmp_path / "split"), df.agg(F.avg("label").alias("mean")))
    assert {(r["filename"], r["label"]) for r in I.read_split_tables(spark, str(tmp_path / "split")).collect()} == {("a", -1), ("b", -1), ("c", -1)}
    assert abs(I.read_split_stats(spark, str(tmp_path / "split")).first()["mean"] + 1 / 3) < 1e-12
    I.write_split_tables(df, str(tmp_path / "bare"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.read_split_stats(spark, str(tmp_path / "bare"))
    for _ in range(2):  # made once, then read
        assert I.read_split_stats(spark, str(tmp_path / "bare"), lambda rows: rows.agg(F.max("label").alias("most"))).first()["most"] == 1
    typed = I.read_summaries(spark, str(tmp_path), "final_auroc string")
    assert {r["final_auroc"] for r in typed.collect()} == {"0.1", "0.2"}
    now = spark.createDataFrame([("b",)], "filename string")
    assert [r["filename"] for r in I.read_unlabeled(spark, str(tmp_path / "split"), now).collect()] == ["c"]


def test_nan_scores_come_first(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", 0.9)], "filename string, score double")
    assert [r["filename"] for r in R.top_n(df, 2).collect()] == ["b", "c"]


def test_a_rank_takes_one_shuffle(spark, capsys):
    df = spark.range(5000).select(F.col("id").cast("string").alias("filename"), (F.col("id") % 7).cast("double").alias("score"))
    R.by_score(df).explain()
    plan = capsys.readouterr().out  # of the rows as they were written, in order
    assert "Window" not in plan and "Exchange hash" not in plan and "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan


def test_ranks_of_null_keys(spark):
    rows = [(k, v) for k in ("a", None) for v in (3, 1, 2)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert {(r["k"], r["v"], r["rank"]) for r in R.global_rank(df, [F.asc("v")], ["k"]).collect()} == {(k, v, v) for k, v in rows}


def test_rank_has_no_window_over_all_rows(spark, capsys):
    df = spark.range(5000).select(F.col("id").cast("string").alias("filename"), (F.col("id") % 7).cast("double").alias("score"))
    ranked = R.by_score(df)
    ranked.explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan  # ranges were written before
    for window in plan.split("Window ")[1:]:
        assert "part" in window.split("\n")[0]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 5001))
    assert R.by_score(df.limit(0)).count() == 0


def test_top_n_plans(spark, capsys):
    df = spark.range(10).select(F.col("id").cast("string").alias("filename"), F.col("id").cast("double").alias("score"))
    R.top_n(df, 3).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
    R.top_k_per_class(df.withColumn("c", F.col("score") % 2), 2, "c", [F.desc("score")]).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_metrics_of_one_class_and_of_ties(spark):
    one = spark.createDataFrame([("a", 0.5, 0), ("b", 0.7, 0)], "filename string, score double, truth int")
    assert M.areas(one).first()["auroc"] == 0.0
    assert M.detection_curve(one).filter("inspected > 0 and y is not null").count() == 0
    tie = spark.createDataFrame([(0.8, 1), (0.8, 0), (0.4, 1), (0.4, 0), (0.9, 1), (0.1, 0)], "score double, truth int")
    row = M.areas(tie).first()
    score = np.array([0.8, 0.8, 0.4, 0.4, 0.9, 0.1])
    truth = np.array([1, 0, 1, 0, 1, 0])
    pairs = [(p > n) + (p == n) / 2 for p in score[truth == 1] for n in score[truth == 0]]
    assert abs(row["auroc"] - np.mean(pairs)) < 1e-12
    recall, precision = [0.0], [1.0]
    for t in sorted(set(score), reverse=True):
        tp = ((score >= t) & (truth == 1)).sum()
        recall.append(tp / 3)
        precision.append(tp / (score >= t).sum())
    assert abs(row["auprc"] - np.trapezoid(precision, recall)) < 1e-12


def test_interpolation_is_numpys(spark):
    xs, ys = [0.0, 1.0, 4.0, 9.0, 100.0], [0.0, 30.0, 30.0, 80.0, 100.0]
    curve = spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")
    asked = [0.1, 1.0, 2.5, 50.0, 100.0]
    got = {r["point"]: r["value"] for r in M.curve_at(curve, asked).collect()}
    assert np.allclose([got[a] for a in asked], np.interp(asked, xs, ys))
    back = {r["point"]: r["value"] for r in M.inspection_needed(curve, [30.0, 50.0]).collect()}
    assert np.allclose([back[30.0], back[50.0]], np.interp([30.0, 50.0], ys, xs))
    low = curve.filter("x < 5")
    assert M.inspection_needed(low, [95.0]).first()["value"] is None


def test_samples_repeat_and_balance(spark):
    df = spark.range(400).select(F.format_string("f%03d", "id").alias("filename"), F.when(F.col("id") < 20, 1).otherwise(0).alias("label"))
    a, b = S.weighted_sample(df, 1000, 5), S.weighted_sample(df, 1000, 5)
    rows = a.orderBy("draw").collect()
    assert rows == b.orderBy("draw").collect()
    assert 400 < sum(r["label"] for r in rows) < 600
    assert S.uniform_sample(df, 30, replacement=False).select("filename").distinct().count() == 30
    assert S.uniform_sample(df, 500, replacement=False).count() == 400
    with pytest.raises(ValueError, match="too few"):
        S.stratified_split(df.filter("filename in ('f000', 'f100')"), 0.5)
    assert S.stratified_split(df, 0.0).filter("split = 'test'").count() == 0


def test_a_batch_orders_only_what_it_cuts(spark, capsys):
    files = spark.range(5000).select(F.format_string("f%04d", "id").alias("filename"), F.lit("x").alias("place"), F.lit("y").alias("start"))
    labeled = files.filter("filename like '%7'").select("filename")
    left = files.join(labeled, "filename", "left_anti")
    order = [r["filename"] for r in R.stable_shuffle(left.select("filename"), 42).orderBy("rank").collect()]
    cursor, seen = 0, []
    while True:
        batch, cursor = R.next_unlabeled_batch(files, labeled, cursor, 999)
        assert batch.columns == [*files.columns, "rank"]
        seen += [r["filename"] for r in batch.orderBy("rank").collect()]
        if not cursor:
            break
    assert seen == order
    R.next_unlabeled_batch(files, labeled, 100, 50)[0].explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" not in plan
    assert "prefix" in plan or "start" in plan


def test_batch_cursor(spark):
    files = spark.range(10).select(F.format_string("f%d", "id").alias("filename"))
    labeled = files.filter("filename in ('f1', 'f2')")
    first, cursor = R.next_unlabeled_batch(files, labeled, 0, 5)
    assert (first.count(), cursor) == (5, 5)
    rest, cursor = R.next_unlabeled_batch(files, labeled, 5, 5)
    assert (rest.count(), cursor) == (3, 0)
    none, cursor = R.next_unlabeled_batch(files, labeled, 50, 5)
    assert (none.count(), cursor) == (0, 0)
    gone, cursor = R.next_unlabeled_batch(files, files, 3, 5)
    assert (gone.count(), cursor) == (0, 3)


def test_constant_image_stretches_to_null(spark):
    df = spark.createDataFrame([([5, 5],), ([0, 10],)], "v array<int>")
    assert [r[0] for r in df.select(V.minmax_stretch(F.col("v"))).collect()] == [None, [0, 255]]


@pytest.mark.parametrize("name", sorted(X.STRONG))
def test_operations_keep_shape_and_range(name):
    x = np.random.default_rng(0).integers(0, 256, (16, 16, 3), dtype=np.uint8)
    for v in X.STRONG[name]:
        out = X.apply(x, name, float(v))
        assert out.shape == x.shape and out.dtype == np.uint8
    neutral = {"brightness": 1.0, "color": 1.0, "contrast": 1.0, "sharpness": 1.0, "rotate": 0.0, "shear_x": 0.0, "shear_y": 0.0, "translate_x": 0.0, "translate_y": 0.0, "posterize": 8, "solarize": 256, "identity": 0}
    if name in neutral:
        assert (X.apply(x, name, neutral[name]) == x).all()


def test_operations_on_bytes_equal_those_on_arrays(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (8, 8, 3), dtype=np.uint8), np.full((8, 8, 3), 9, np.uint8), rng.integers(100, 120, (8, 8, 3), dtype=np.uint8)]
    rows = [(n, c, x[..., c].ravel().tolist()) for n, x in enumerate(images) for c in range(3)]
    df = spark.createDataFrame(rows, "n int, c int, v array<int>")
    v = F.col("v")
    pairs = {
        "invert": (X.invert(v), [lambda x: X.apply(x, "invert", 0)]),
        "posterize": (X.posterize(v, 5), [lambda x: X.apply(x, "posterize", 5.7)]),
        "solarize": (X.solarize(v, 110), [lambda x: X.apply(x, "solarize", 110.0)]),
        "autocontrast": (X.autocontrast(v), [lambda x: X.apply(x, "autocontrast", 0)]),
        "right": (X.translate(v, 8, 2), [lambda x: X.apply(x, "translate_x", -0.25)]),
        "left": (X.translate(v, 8, -3), [lambda x: X.apply(x, "translate_x", 0.375)]),
        "hflip": (X.hflip(v, 8), [lambda x: x[:, ::-1]]),
    }
    got = {(r["n"], r["c"]): r for r in df.select("n", "c", *(c.alias(name) for name, (c, _) in pairs.items())).collect()}
    for name, (_, (f,)) in pairs.items():
        for n, x in enumerate(images):
            for c in range(3):
                assert got[n, c][name] == f(x)[..., c].ravel().tolist(), (name, n)


def test_unsharp_against_direct_sums(spark):
    x = np.random.default_rng(8).integers(0, 256, (6, 6, 3)).astype(np.uint8)
    df = spark.createDataFrame([("a", bytearray(x.tobytes()))], "filename string, pixels binary")
    got = np.frombuffer(bytes(X.adjust_images(df, 6, unsharp=True).first()["pixels"]), np.uint8).reshape(6, 6, 3)
    for i in range(6):
        for j in range(6):
            for c in range(3):
                own, mean = float(x[i, j, c]), float(x[i, j, c])
                if 0 < i < 5 and 0 < j < 5:
                    mean = (sum(float(x[i + a, j + b, c]) for a in (-1, 0, 1) for b in (-1, 0, 1)) + 4 * own) / 13
                assert got[i, j, c] == int(min(255, max(0, mean + (own - mean) * 2.5 + 0.5)))


def test_views_repeat(spark):
    x = np.random.default_rng(1).integers(0, 256, (16, 16, 3), dtype=np.uint8).tobytes()
    df = spark.createDataFrame([(f"f{k}", bytearray(x)) for k in range(6)], "filename string, pixels binary")
    a = X.augment_views(df, 16).orderBy("filename", "view").collect()
    b = X.augment_views(df.repartition(3), 16).orderBy("filename", "view").collect()
    assert a == b and len(a) == 12 and len({bytes(r["pixels"]) for r in a if r["view"] == "strong"}) > 1


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    y = (np.arange(240) % 8 == 0).astype(int)
    x = rng.normal(0, 1, (240, 6)) + 1.5 * y[:, None]
    rows = [(f"f{k:03d}", x[k].tolist(), int(y[k]) if k % 3 == 0 else -1, int(y[k])) for k in range(240)]
    return spark.createDataFrame(rows, "filename string, features array<double>, label int, label_idx int").repartition(3).cache()


@pytest.mark.parametrize("cfg", [fixmatch.Config(steps=8, lr=0.3, ema=0.5), fixmatch.Config(steps=8, lr=0.005, optimizer="Adam", ema=0.5, hard_label=False, warmup=2, cosine=True)])
def test_training_improves(spark, blobs, cfg):
    fitted = fixmatch.fit(blobs, cfg)
    assert fitted.history[-1]["sup_loss"] < fitted.history[0]["sup_loss"]
    scored = L.one_vs_rest(scoring.score_linear(blobs, fitted.model), 1)
    assert M.areas(scored).first()["auroc"] > 0.9
    path = new_path(spark, "model")
    fixmatch.save_model(spark, fitted, path)
    assert np.allclose(fixmatch.load_model(spark, path).weights, fitted.model.weights)
    assert fixmatch.load_model(spark, path + "-none", strict=False) is None


def test_training_rejects(blobs):
    with pytest.raises(ValueError, match="unknown optimizer"):
        fixmatch.fit(blobs, fixmatch.Config(optimizer="LBFGS"))
    with pytest.raises(ValueError, match="too high"):
        fixmatch.fit(blobs, fixmatch.Config(optimizer="Adam", lr=0.1))
    with pytest.raises(ValueError, match="unlabeled"):
        fixmatch.fit(blobs.filter("label >= 0"), fixmatch.Config())


@pytest.fixture(scope="module")
def held_out(blobs):
    return blobs.filter("label = -1").select("filename", "features", F.col("label_idx").alias("label"))


CFG = fixmatch.Config(steps=9, lr=0.3, ema=0.5, cutoff=0.7, batches=3, eval_every=2, warmup=2, cosine=True)


@pytest.mark.parametrize("optimizer", ["SGD", "Adam"])
def test_training_resumes_where_it_stopped(spark, blobs, held_out, optimizer):
    cfg = fixmatch.Config(**{**vars(CFG), "optimizer": optimizer, "lr": 0.3 if optimizer == "SGD" else 0.005})
    table = fixmatch.training_table(blobs, cfg, held_out)
    whole = fixmatch.fit(table, cfg)
    first = fixmatch.fit(table, cfg, until=4)
    path = new_path(spark, "state")
    fixmatch.save_state(spark, first.state, path)
    rest = fixmatch.fit(table, cfg, resume=fixmatch.load_state(spark, path))
    for name in ("theta", "average", "speed", "square", "best"):
        assert (getattr(rest.state, name) == getattr(whole.state, name)).all(), name
    assert (rest.state.step, rest.state.best_step, rest.state.best_accuracy) == (9, whole.state.best_step, whole.state.best_accuracy)
    assert rest.model == whole.model and rest.last == whole.last
    assert [{k: v for k, v in h.items() if k not in ("accuracy", "eval_loss")} for h in first.history + rest.history] == [{k: v for k, v in h.items() if k not in ("accuracy", "eval_loss")} for h in whole.history]


def test_state_is_whole_or_none(spark, tmp_path):
    one = np.arange(6.0).reshape(3, 2)
    state = fixmatch.State(one, one + 1, one + 2, one + 3, step=4)
    path = str(tmp_path / "state")
    fixmatch.save_state(spark, state, path)
    # A later state whose writer was lost before the mark, and a name that nobody knows.
    spark.createDataFrame([("theta", [0.0])], "name string, value array<double>").write.parquet(f"{path}/states/step=7")
    spark.createDataFrame([("of_tomorrow", [0.0])], "name string, value array<double>").write.mode("append").parquet(f"{path}/states/step=4")
    found = fixmatch.load_state(spark, path)
    assert found.step == 4 and (found.square == one + 3).all() and found.best is None
    assert fixmatch.load_state(spark, path, step=7, strict=False) is None
    assert fixmatch.load_state(spark, str(tmp_path / "none"), strict=False) is None
    with pytest.raises(KeyError):
        fixmatch.load_state(spark, path, step=7)


def test_the_best_average_is_returned(spark, blobs, held_out):
    cfg = fixmatch.Config(**{**vars(CFG), "cosine": False, "warmup": 0, "lr": 3.0})
    table = fixmatch.training_table(blobs, cfg, held_out)
    fitted = fixmatch.fit(table, cfg)
    plain = fixmatch.fit(table, fixmatch.Config(**{**vars(cfg), "eval_every": 0}))
    assert fitted.last == plain.model and "accuracy" not in plain.history[-1]
    judged = {h["step"] + 1: h["accuracy"] for h in fitted.history if "accuracy" in h}
    assert list(judged) == [2, 4, 6, 8, 9]

    def accuracy(model):
        scored = scoring.score_linear(held_out, model)
        return scored.agg(F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]

    assert judged[9] == pytest.approx(accuracy(fitted.last))
    assert fitted.state.best_accuracy == max(judged.values()) == pytest.approx(accuracy(fitted.model))
    assert fitted.state.best_step == min(k for k, v in judged.items() if v == max(judged.values()))
    # Up to a judged step the average is that of training without any selection.
    until = fixmatch.fit(table, fixmatch.Config(**{**vars(cfg), "eval_every": 0}), until=fitted.state.best_step)
    assert fitted.model == until.model


def test_a_step_reads_its_share(spark, blobs, held_out, capsys):
    table = fixmatch.training_table(blobs, CFG, held_out)
    counts = {(r["share"], r["label"]): r["count"] for r in table.groupBy("share", "label").count().collect()}
    for label in (-1, 0, 1):
        own = [counts[s, label] for s in range(3)]
        assert max(own) - min(own) <= 1
    assert counts[fixmatch.HELD_OUT, 0] + counts[fixmatch.HELD_OUT, 1] == held_out.count()
    table.filter(F.col("share").isin([1])).select("key", "features").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(share" in plan or "PartitionFilters: [(share" in plan
    files = {r[0] for r in table.filter(F.col("share").isin([1])).select(F.input_file_name()).distinct().collect()}
    assert files and all("/share=1/" in f for f in files)


def test_sums_come_by_a_tree_to_one_row(spark):
    rows = [(k, [float(k), 1.0]) for k in range(300)]
    parts = spark.createDataFrame(rows, "part long, values array<double>").repartition(5)
    for fan in (2, 7, 64, 1000):
        assert fixmatch.summed(parts, 300, fan).tolist() == [299 * 150.0, 300.0]
    assert fixmatch.summed(parts, 3, 4).tolist() == [299 * 150.0, 300.0]  # more parts than were said
    assert fixmatch.summed(parts.limit(0), 5) is None


def test_noise_is_normal_and_repeats():
    seeds = np.arange(4000, dtype=np.uint64)
    light, heavy = fixmatch._normal(seeds, 8)
    assert abs(light.mean()) < 0.02 and abs(light.std() - 1) < 0.02 and abs(heavy.std() - 1) < 0.02
    assert abs(np.corrcoef(light.ravel(), heavy.ravel())[0, 1]) < 0.02
    assert (fixmatch._normal(seeds[7:9], 8)[0] == light[7:9]).all()


def test_round_adds_labels(spark, blobs):
    truth = blobs.select("filename", "label_idx")
    state = rounds.State(S.initial_labels(truth, 1, 40, 0.25))
    done = rounds.active_learning_round(blobs.select("filename", "features"), truth, state, 1, fixmatch.Config(steps=3, lr=0.3, ema=0.5), n_corrections=10)
    assert done.state.labels.count() == 40 + done.corrections.count()
    assert done.corrections.groupBy("label").count().filter("count > 5").count() == 0
    assert 0 <= done.metrics.first()["auroc"] <= 1


def test_sweep(spark, blobs):
    out = rounds.sweep(blobs.select("filename", "features"), blobs.select("filename", "label_idx"), [1], fixmatch.Config(steps=2, lr=0.3, ema=0.5)).collect()
    assert [(r["anomaly_class"], r["iteration"]) for r in out] == [(1, 0)]


def test_search_stores_all_and_returns_payload(spark, blobs):
    source = blobs.withColumn("source", F.lit("s"))
    store = new_path(spark, "predictions")
    model = scoring.LinearModel([[0.0, 1.0]] * 6, [0.0, 0.0])
    out = scoring.search(source, lambda df: scoring.score_linear(df, model), 5, store, ["label_idx"])
    assert out.count() == 5 and I.read_predictions(spark, store).count() == 240
    scoring.search(source, lambda df: scoring.score_linear(df, model), 5, store)
    assert I.read_predictions(spark, store).count() == 240  # a container that is scored again replaces its rows


def test_search_gives_each_winner_its_own_payload(spark):
    rows = [("a", "s", [0.1], "x"), ("a", "s", [0.9], "y"), ("a", "s", [0.5], "z"), ("b", "s", [0.7], "w")]
    source = spark.createDataFrame(rows, "filename string, source string, features array<double>, note string")
    out = scoring.search(source, lambda df: scoring.score_linear(df, scoring.LinearModel([[0.0, 1.0]], [0.0, 0.0])), 3, payload=["note"])
    assert [r["note"] for r in out.orderBy(F.desc("score")).collect()] == ["y", "w", "z"]


def test_a_run_is_seen_whole_or_not_at_all(spark):
    store = new_path(spark, "store")
    rows = lambda source, score, names="ab": spark.createDataFrame([(n, source, score) for n in names], "filename string, source string, score double")
    with pytest.raises(FileNotFoundError):
        I.read_predictions(spark, store)
    I.store_predictions(rows("s", 0.1).union(rows("t", 0.2)), store, "one")
    I.store_predictions(rows("s", 0.3, "abc"), store, "2")
    # A run whose writer was lost before it was complete.
    rows("t", 0.9).write.parquet(f"{store}/runs/run=3")
    seen = lambda: {(r["source"], r["filename"], r["score"]) for r in I.read_predictions(spark, store).collect()}
    assert seen() == {("s", n, 0.3) for n in "abc"} | {("t", n, 0.2) for n in "ab"}
    for _ in range(2):  # a run that is repeated under its name
        I.store_predictions(rows("t", 0.8), store, "3")
        assert seen() == {("s", n, 0.3) for n in "abc"} | {("t", n, 0.8) for n in "ab"}
        assert I.read_predictions(spark, store).count() == 5


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    for k, times in enumerate((["2024-01-01 10:00:00"], ["2024-01-01 14:00:00"], ["2024-01-01 10:00:30", "2024-01-01 15:00:00"])):
        spark.createDataFrame([(t,) for t in times], "ts string").select(F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    files = sorted((tmp_path / "in").glob("*/*.parquet"))
    (tmp_path / "flat").mkdir()
    dropped = 0
    schema = "ts timestamp"
    rates = T.tumbling_rate(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat")), 60, "1 hour")
    q = rates.writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).start()
    for k, f in enumerate(files):
        (tmp_path / "flat" / f"{k}.parquet").write_bytes(f.read_bytes())
        q.processAllAvailable()
    for p in q.recentProgress:
        dropped += sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
    q.stop()
    assert dropped == 1


def test_stream_top_n_is_idempotent(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("string").alias("filename"), (F.col("id") / 100).alias("score"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    store, progress = str(tmp_path / "out"), str(tmp_path / "c")
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        T.stream_top_n(stream, 10, store, progress).awaitTermination()
    assert {r["filename"] for r in T.newest_state(spark, store).collect()} == {str(k) for k in range(90, 100)}


def test_label_deltas_become_a_base(spark, tmp_path):
    edits = [(f"f{k % 7}", "anomaly" if k % 3 else "normal", k) for k in range(60)]
    for k in range(10):
        spark.createDataFrame(edits[6 * k : 6 * k + 6], "filename string, label string, turn long").coalesce(1).write.parquet(str(tmp_path / f"in/{k:02d}"))
    (tmp_path / "flat").mkdir()
    store, progress = str(tmp_path / "store"), str(tmp_path / "progress")
    expected = {}
    for k in range(10):
        next((tmp_path / f"in/{k:02d}").glob("*.parquet")).rename(tmp_path / f"flat/{k:02d}.parquet")
        stream = spark.readStream.schema("filename string, label string, turn long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
        T.stream_labels(stream, ["turn"], store, progress, compact=4).awaitTermination()
        expected |= {f: label for f, label, _ in edits[6 * k : 6 * k + 6]}
        assert {r["filename"]: r["label"] for r in T.label_state(spark, store, ["turn"]).collect()} == expected
        there = sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.endswith(".crc") and "_done" not in p.name)
        base = [f"base={k - (k + 1) % 4}"] if k >= 3 else []
        assert there == sorted(base + [f"delta={j}" for j in range(k - (k + 1) % 4 + 1, k + 1)])
    # A batch that runs again: its delta is written once more, the base stays, an unfinished base is not read.
    spark.createDataFrame([("f0", "normal", 1)], "filename string, label string, turn long").write.parquet(f"{store}/base=99")
    assert {r["filename"]: r["label"] for r in T.label_state(spark, store, ["turn"]).collect()} == expected


def test_a_label_batch_writes_what_it_changed(spark, tmp_path):
    wide = spark.range(20_000).select(F.col("id").cast("string").alias("filename"), F.lit("normal").alias("label"), F.lit(0).cast("long").alias("turn"))
    wide.coalesce(1).write.parquet(str(tmp_path / "wide"))
    (tmp_path / "flat").mkdir()
    next((tmp_path / "wide").glob("*.parquet")).rename(tmp_path / "flat/0.parquet")
    store = str(tmp_path / "store")
    for k in range(2):
        if k:
            spark.createDataFrame([("5", "anomaly", 1)], wide.schema).coalesce(1).write.parquet(str(tmp_path / "one"))
            next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "flat/1.parquet")
        T.stream_labels(spark.readStream.schema(wide.schema).parquet(str(tmp_path / "flat")), ["turn"], store, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{store}/delta=1").count() == 1
    assert T.label_state(spark, store, ["turn"]).count() == 20_000


def test_old_winners_are_removed(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("filename"), F.col("id").cast("double").alias("score"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    T.stream_top_n(stream, 3, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    states = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("state="))
    assert len(states) == 2 and states[1] == states[0] + 1
    assert {r["filename"] for r in T.newest_state(spark, str(tmp_path / "out")).collect()} == {"47", "48", "49"}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("files", [1, 5])
def test_rates_do_not_depend_on_batches(spark, rocks, tmp_path, files):
    at = [0, 0, 1, 5, 70, 71, 71, 71, 71, 200, 500, 501, 502, 503, 2000, 4000]
    rows = spark.createDataFrame([("k", t) for t in at] + [("j", 30)], "source string, t long").select("source", F.timestamp_seconds("t").alias("ts"))
    (tmp_path / "in").mkdir()
    parts = np.array_split(sorted(rows.collect(), key=lambda r: r["ts"]), files)
    for k, part in enumerate(parts):  # a stream takes files in the order of their times
        spark.createDataFrame([tuple(r) for r in part], rows.schema).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        to = next((tmp_path / f"w{k}").glob("*.parquet")).rename(tmp_path / f"in/{k}.parquet")
        os.utime(to, (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = T.rate_by_count_or_time(stream, "source", count=4, seconds=60, watermark="100 seconds")
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("source", F.unix_seconds("start").alias("start"), "rows", "seconds", "total")
    # Four by count at 5 s; five at 71 s, as a unit is taken whole; one by time; four by count; one by a timer as 4000 s came; the last is still open.
    assert sorted(map(tuple, found.collect())) == [("j", 30, 1, 60, 1), ("k", 0, 4, 6, 4), ("k", 70, 5, 2, 9), ("k", 200, 1, 60, 10), ("k", 500, 4, 4, 14), ("k", 2000, 1, 60, 15)]


def test_small_tables(spark):
    runs = spark.createDataFrame([(0, 0.5, 0.2, 0.7), (1, 0.6, 0.3, 0.9), (2, 0.8, 0.5, 0.9)], "iteration int, auroc double, auprc double, accuracy double")
    s = A.run_summary(runs).first()
    assert (s["baseline_auroc"], s["first_auroc"], s["final_auroc"]) == (0.5, 0.6, 0.8)
    assert A.best_iteration(runs).first()["iteration"] == 1
    only = A.run_summary(runs.filter("iteration = 0")).first()
    assert only["first_auroc"] == only["final_auroc"] == 0.5


def test_positions_beside_clashing_columns(spark):
    """Every name that prefix_sums makes stands in its input; many parts, ties by a second column."""
    names = ["part", "nth", "own", "key_0", "add_rank", "in_rank", "before_rank", "up_to_rank"]
    rows = [(k, (k * 7919) % 50, "ab"[k % 2]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, score long, kind string").repartition(7).withColumns({c: F.lit("clash") for c in names})
    got = R.global_rank(df, [F.desc("score"), F.asc("id")], ["kind"])
    assert got.columns == [*df.columns, "rank"]
    expected = {}
    for kind in "ab":
        own = sorted((r for r in rows if r[2] == kind), key=lambda r: (-r[1], r[0]))
        expected |= {r[0]: k + 1 for k, r in enumerate(own)}
    found = got.collect()
    assert {r["id"]: r["rank"] for r in found} == expected and all(r[c] == "clash" for r in found for c in names)


def test_operators_beside_clashing_columns(spark):
    """Every name that these operators make for themselves stands in their input."""
    names = ["centre", "rank", "order_key", "test_rows", "place", "own", "cls", "nth", "part", "position", "start", "before", "of", "at", "number", "rows"]
    df = spark.range(40).select(F.format_string("f%02d", "id").alias("filename"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("label"), (F.col("id") % 7).cast("double").alias("score"))
    odd = df.withColumns({c: F.lit("clash") for c in names})
    keep = lambda out, *but: all(r[c] == "clash" for r in out.collect() for c in names if c not in but)
    for f in (R.rank_by_mean, R.rank_by_median):
        out = f(odd)
        assert keep(out) and [(r["filename"], r["gap"]) for r in out.collect()] == [(r["filename"], r["gap"]) for r in f(df).collect()]
    pairs = {
        "batches": lambda d: S.batches(d, 6),
        "split": lambda d: S.stratified_split(d, 0.2),
        "sample": lambda d: S.sample_per_class(d, 3, label="label"),
        "padded": lambda d: S.sample_per_class(d, 13, label="label", pad=True),
        "weighted": lambda d: S.weighted_sample(d, 50),
        "uniform": lambda d: S.uniform_sample(d, 50),
        "without": lambda d: S.uniform_sample(d, 50, replacement=False),
        "shuffle": lambda d: R.ranked_between(d, 1, 3, 9)[0],
    }
    for name, f in pairs.items():
        out, plain = f(odd), f(df)
        but = [c for c in ("rank", "nth") if c in plain.columns]
        assert keep(out, *but), name
        columns = plain.columns if name != "shuffle" else ["filename", "label", "score"]
        assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect())), name
    twice = odd.withColumn("batch", F.lit(0))
    assert S.batches(twice, 6).columns.count("batch") == 1


def test_upsert_keeps_columns_and_rows(spark):
    base = spark.createDataFrame([("a", "normal", "x", 1), ("b", None, None, 2), ("c", "anomaly", "z", None)], "filename string, label string, note string, own int")
    edits = spark.createDataFrame([("a", "anomaly", 1), ("a", "normal", 2), ("b", "normal", 1), ("d", "anomaly", 5)], "filename string, label string, turn int")
    out = L.upsert(base, edits, ["turn"])
    assert out.columns == base.columns
    assert sorted(map(tuple, out.collect())) == [("a", "normal", "x", 1), ("b", "normal", None, 2), ("c", "anomaly", "z", None), ("d", "anomaly", None, None)]
    assert L.upsert(base.limit(0), edits, ["turn"]).count() == 3 and L.upsert(base, edits.limit(0), ["turn"]).count() == 3


def test_runs_take_away_their_own_tables_only(spark):
    from concurrent.futures import ThreadPoolExecutor
    from pathlib import Path
    from threading import Barrier

    from starsift.storage import scratch, shared_dir, written

    before, gate = {p.name for p in Path(shared_dir(spark)).iterdir()}, Barrier(2)

    def work(n: int) -> list:
        with scratch(spark) as keep:
            mine = written(spark.range(n), "mine")
            gate.wait(60)
            with scratch(spark) as inner:
                kept = inner(written(mine, "inner"), "kept")
            if n == 3:
                out = keep(kept, "result")
                gate.wait(60)
            else:
                gate.wait(60)  # the other run has nearly ended
                out = keep(written(kept, "again"), "result")
        return [r["id"] for r in out.orderBy("id").collect()]

    outside = written(spark.range(2), "outside")
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (3, 5))) == [list(range(3)), list(range(5))]
    assert outside.count() == 2
    left = {p.name.split("-")[0] for p in Path(shared_dir(spark)).iterdir() if p.name not in before}
    assert left == {"outside", "result"}


def test_exact_median(spark):
    for scores in ([3.0], [1.0, 2.0], [1.0, 1.0, 5.0, 9.0], [2.0, 2.0, 2.0, 7.0], [4.0, 1.0, None, 3.0, 3.0, 8.0]):
        df = spark.createDataFrame([(str(k), x) for k, x in enumerate(scores)], "filename string, score double")
        own = sorted(x for x in scores if x is not None)
        middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        assert {(r["filename"], r["gap"]) for r in R.rank_by_median(df).collect()} == {(str(k), None if x is None else abs(x - middle)) for k, x in enumerate(scores)}
