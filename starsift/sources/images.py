"""Image, blob, ZIP and file-list sources, and their sinks."""

from __future__ import annotations

import bz2
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.operators.labels import basename
from starsift.operators.rank import prefix_sums
from starsift.storage import written

#: Suffixes of image files, in lower case.
EXTENSIONS = (".jpeg", ".jpg", ".png", ".tif", ".tiff")
ON_ERROR = ("drop", "blank", "fail")
#: Bytes of an archive, or of listed files, that one task reads.
RANGE = 64 << 20
#: Of the parts that Spark makes of a folder (each file counts as 4 MB there), so many become one task, but no fewer than so many tasks a core stay.
PARTS_A_TASK, TASKS_A_CORE = 16, 4


def has_extension(path: Column, extensions: Sequence[str] = EXTENSIONS) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for e in extensions:
        out = out | low.endswith(e)
    return out


def read_images(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(filename, image) of the image files of a folder; bytes that aren't an image have height -1."""
    df = spark.read.format("image").load(path)
    tasks = df.rdd.getNumPartitions() // PARTS_A_TASK  # small files make very many parts, which cost more than their files
    df = df.coalesce(max(tasks, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    return df.filter(has_extension(F.col("image.origin"), extensions)).select(basename(F.col("image.origin")).alias("filename"), "image")


def read_nested_images(spark: SparkSession, path: str) -> DataFrame:
    """(filename split part as split, label, content) of Parquet files named split-*.parquet with image.bytes."""
    df = spark.read.parquet(path)
    return df.select(F.split(F.col("_metadata.file_name"), "-")[0].alias("split"), "label", F.col("image.bytes").alias("content"))


def read_blob_table(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of a Parquet container; reading only filenames leaves the blobs unread."""
    return spark.read.parquet(path).select(F.col("filename").cast("string").alias("filename"), "content")


def write_blob_table(df: DataFrame, path: str, append: bool = True) -> None:
    df.select("filename", "content").write.mode("append" if append else "overwrite").parquet(path)


def opened(path: str) -> BinaryIO:
    """A file for reading at any place, on the executor: by its local path or by any URI that pyarrow knows.

    Raises FileNotFoundError where there is none.
    """
    if local := re.match(r"(?:file:(?://)?)?(/.*)", path):
        return open(local[1], "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path)
    return system.open_input_file(name)


def write_files(df: DataFrame, folder: str) -> int:
    """Write each row of (filename, content) as a file of a folder, by executors; the number of files.

    A file is written under another name and then renamed, so a task that runs again or is lost leaves
    no part of one. ``folder`` is a path or URI as :func:`opened` takes it; names may have folders.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", folder)
        system, root = FileSystem.from_uri(f"file://{local[1]}" if local else folder)
        for batch in batches:
            for name, content in zip(batch["filename"], batch["content"], strict=True):
                to = f"{root}/{name}"
                system.create_dir(to.rsplit("/", 1)[0])
                part = f"{to}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, to)
            yield pd.DataFrame({"n": [len(batch)]})

    return df.select("filename", F.col("content").cast("binary").alias("content")).mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def _entry(file: BinaryIO, at: int, packed: int, method: int, crc: int, name: str) -> bytes:
    """The content of the entry whose local header stands at ``at``."""
    file.seek(at)
    head = file.read(30)
    names, extra = struct.unpack("<26xHH", head)
    file.seek(at + 30 + names + extra)
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method == zipfile.ZIP_BZIP2:
        data = bz2.decompress(data)
    elif method == zipfile.ZIP_LZMA:
        data = zipfile.LZMADecompressor().decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise zipfile.BadZipFile(f"{name} is packed by method {method}")
    if zlib.crc32(data) != crc:
        raise zipfile.BadZipFile(f"{name} has another checksum")
    return data


def zip_entries(archives: DataFrame, extensions: Sequence[str] = EXTENSIONS, size: int = RANGE) -> DataFrame:
    """(source, filename, range, at, packed, method, crc) of the image entries of (source) archives, from their directories alone.

    ``range`` numbers stretches of about ``size`` bytes of an archive by where entries begin.
    """
    kinds = tuple(extensions)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch["source"]:
                with opened(source) as file, zipfile.ZipFile(file) as z:
                    rows = [(source, i.filename, i.header_offset // size, i.header_offset, i.compress_size, i.compress_type, i.CRC) for i in z.infolist() if i.filename.lower().endswith(kinds)]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=["source", "filename", "range", "at", "packed", "method", "crc"])

    return archives.select("source").mapInPandas(listed, "source string, filename string, range long, at long, packed long, method int, crc long")


def read_zip_images(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS, size: int = RANGE) -> DataFrame:
    """(source, filename, content) of the image entries of each ZIP file of a folder.

    Spark lists the archives, tasks read their directories, and the entries of each stretch of ``size``
    bytes are one task's work: it reads its entries by their places, so an archive of any length is
    read by many tasks and held by none.
    """

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, file = None, None
        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.source != source:
                        if file:
                            file.close()
                        source, file = row.source, opened(row.source)
                    yield pd.DataFrame({"source": [source], "filename": [row.filename], "content": [_entry(file, row.at, row.packed, row.method, row.crc, row.filename)]})
        finally:
            if file:
                file.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("source"))
    found = written(zip_entries(files, extensions, size), "entries")
    tasks = max(1, found.select("source", "range").distinct().count())
    return found.repartition(tasks, "source", "range").sortWithinPartitions("source", "at").mapInPandas(contents, "source string, filename string, content binary")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the lines of a text file, trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def read_listed_files(spark: SparkSession, path: str, on_missing: str = "drop", size: int = RANGE) -> DataFrame:
    """(path, filename, content) of the files that a text file lists, a row for each line.

    Executors look up the sizes, lines are packed in the order of paths into tasks of about ``size``
    bytes, and each task opens its files. A file that isn't there is dropped, has the content null
    ('null'), or is an error ('fail').
    """
    if on_missing not in ("drop", "null", "fail"):
        raise ValueError("on_missing is one of drop, null, fail")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch["path"]:
                try:
                    with opened(name) as file:
                        found.append(file.seek(0, 2))
                except FileNotFoundError:
                    if on_missing == "fail":
                        raise
                    found.append(None)
            yield pd.DataFrame({"path": batch["path"], "size": pd.array(found, dtype="Int64")})

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, there in zip(batch["path"], batch["size"].notna(), strict=True):
                content = None
                if there:
                    with opened(name) as file:
                        content = file.read()
                yield pd.DataFrame({"path": [name], "content": [content]})

    listed = read_file_list(spark, path).mapInPandas(sizes, "path string, size long")
    listed = written(listed if on_missing != "drop" else listed.filter("size is not null"), "listed")
    packed = prefix_sums(listed, [F.asc("path")], {"upto": F.coalesce("size", F.lit(0)) + 1})  # files of no bytes count too
    packed = packed.withColumn("task", F.floor((F.col("upto") - 1) / size).cast("int"))
    tasks = max(1, -(-(listed.agg(F.sum(F.coalesce("size", F.lit(0)) + 1)).first()[0] or 0) // size))
    read = packed.select("path", "size", "task").repartitionById(tasks, "task").mapInPandas(contents, "path string, content binary")
    return read.select("path", basename(F.col("path")).alias("filename"), "content")


def read_summaries(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All results_summary.csv under a folder, with the folder of each as run_dir; without a schema they are read once more to infer it."""
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    df = reader.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "results_summary.csv").csv(root)
    return df.withColumn("run_dir", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def write_topn(df: DataFrame, path: str) -> None:
    """Scores and payload in one table, so that they can't come apart."""
    df.write.mode("overwrite").parquet(path)


def read_topn(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("filename", basename(F.col("filename")))


def append_predictions(df: DataFrame, path: str) -> DataFrame:
    """Add predictions to a table without rewriting it, and return all of it; rows that are added twice stand twice."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def store_predictions(df: DataFrame, path: str, run: str | None = None) -> DataFrame:
    """Put the predictions of a run in a store, in place of earlier ones of the same sources, and return all of it.

    ``df`` has a source. The rows go to a folder of the run; then a row for each source says that it
    is complete, and only then readers see it. So a run that is lost half-way changes nothing, one
    that is repeated under its name overwrites itself, and containers that are scored again have one
    row for each file. One run writes at a time.
    """
    spark, run = df.sparkSession, run or uuid.uuid4().hex
    df.write.mode("overwrite").parquet(f"{path}/runs/run={run}")
    known = _manifest(spark, path)
    turn = 0 if known is None else known.agg(F.max("turn")).first()[0] + 1
    sources = spark.read.parquet(f"{path}/runs/run={run}").select("source").distinct()
    sources.select("source", F.lit(run).alias("run"), F.lit(turn).alias("turn")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return read_predictions(spark, path)


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("source string, run string, turn int").parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predictions of a store: for each source those of the last complete run that has it."""
    newest = _manifest(spark, path)
    if newest is None:
        raise FileNotFoundError(f"no complete run in {path}")
    newest = newest.groupBy("source").agg(F.max_by("run", "turn").alias("last"))
    rows = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs").withColumn("run", F.col("run").cast("string"))
    kept = rows.join(newest.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("last")))
    return kept.drop("of", "last", "run")


def write_split_tables(df: DataFrame, path: str, stats: DataFrame | None = None) -> None:
    """(filename, label, ...) in two parts, labeled and not; ``stats``, such as mean and std, beside them."""
    df.withColumn("is_labeled", F.col("label").isNotNull() & (F.col("label") >= 0)).write.mode("overwrite").partitionBy("is_labeled").parquet(f"{path}/files")
    if stats is not None:
        stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_split_tables(spark: SparkSession, path: str) -> DataFrame:
    """All rows of both parts with the label -1, as of files that nobody labeled."""
    return spark.read.parquet(f"{path}/files").drop("is_labeled").withColumn("label", F.lit(-1))


def read_split_stats(spark: SparkSession, path: str, stats: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The statistics beside split tables; where they lack, ``stats`` makes them of all rows, and they are written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/stats")
    except AnalysisException:
        if stats is None:
            raise
        stats(spark.read.parquet(f"{path}/files").drop("is_labeled")).write.mode("overwrite").parquet(f"{path}/stats")
        return spark.read.parquet(f"{path}/stats")


def read_unlabeled(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The unlabeled part without files that were labeled meanwhile."""
    return spark.read.parquet(f"{path}/files").filter("not is_labeled").drop("is_labeled").join(labels.select("filename"), "filename", "left_anti")


def to_rgb(pixels: Column, channels: Column) -> Column:
    """Row-major values of 1, 3 or more channels as RGB triples: gray is repeated, a fourth channel is cut off."""
    places = F.sequence(F.lit(0), (F.size(pixels) / channels).cast("int") - 1)
    triple = lambda i: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda c: F.element_at(pixels, (i * channels + F.when(channels == 1, 0).otherwise(c) + 1).cast("int")))
    return F.when(F.size(pixels) > 0, F.flatten(F.transform(places, triple))).otherwise(pixels)


def _shares(n: int, size: int) -> np.ndarray:
    """(size, n): the share that each of ``n`` pixels has in each of ``size`` new ones."""
    edges, at = np.arange(size + 1) * n / size, np.arange(n)
    cover = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.clip(cover, 0, None) * size / n


def resize_area(pixels: np.ndarray, size: int) -> np.ndarray:
    """(height, width, channels) to (size, size, channels): a new pixel is the mean of the area that it covers."""
    h, w, _ = pixels.shape
    means = np.einsum("ih,hwc,jw->ijc", _shares(h, size), pixels.astype(np.float64), _shares(w, size), optimize=True)
    return np.floor(np.round(means, 6) + 0.5).astype(np.uint8)


def decode_images(images: DataFrame, size: int, on_error: str = "drop") -> DataFrame:
    """(filename, pixels) of :func:`read_images`: RGB bytes by rows, size * size * 3.

    The source has BGR order; gray becomes three equal channels and a fourth one is cut off. What
    isn't an image is dropped, becomes black ('blank') or an error ('fail'); a key and its pixels
    share a row throughout.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, out = [], []
            for name, h, w, c, data in zip(batch["filename"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                if h <= 0:
                    if on_error == "fail":
                        raise ValueError(f"{name} is not an image")
                    if on_error == "drop":
                        continue
                    pixels = np.zeros((size, size, 3), np.uint8)
                else:
                    pixels = np.frombuffer(data, np.uint8).reshape(h, w, c)
                    pixels = np.repeat(pixels, 3, axis=2) if c == 1 else pixels[:, :, 2::-1]
                    pixels = resize_area(pixels, size)
                names.append(name)
                out.append(pixels.tobytes())
            if names:  # of no rows, pandas makes columns of numbers
                yield pd.DataFrame({"filename": names, "pixels": out})

    flat = images.select("filename", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "filename string, pixels binary")


def png(pixels: bytes, size: int) -> bytes:
    """A square RGB image as a PNG file."""
    rows = np.frombuffer(pixels, np.uint8).reshape(size, size * 3)
    lines = np.hstack([np.zeros((size, 1), np.uint8), rows]).tobytes()  # each line begins with its filter: none

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def resize_and_write(images: DataFrame, size: int, path: str, on_error: str = "drop", append: bool = False) -> DataFrame:
    """Images of :func:`read_images` in one size, as PNG files in a blob table under ``path``; and that table.

    What isn't an image is dropped, black or an error, as in :func:`decode_images`.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"filename": batch["filename"], "content": [png(x, size) for x in batch["pixels"]]})

    write_blob_table(decode_images(images, size, on_error).mapInPandas(encoded, "filename string, content binary"), path, append)
    return read_blob_table(images.sparkSession, path)


def stream_images(spark: SparkSession, path: str, per_trigger: int = 1000, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """A stream of (filename, content, ts) of the files that come into a folder; each file once."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.filter(has_extension(F.col("path"), extensions)).select(basename(F.col("path")).alias("filename"), "content", F.col("modificationTime").alias("ts"))
