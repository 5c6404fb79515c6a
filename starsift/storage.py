"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The run whose tables are written now, if any: a list of their paths. Threads and tasks have their own.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made and set, if all of Spark runs in this one process;
    on a cluster that would be a folder which others can't see, so it's an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} shares")
        path = tempfile.mkdtemp(prefix="starsift-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; a run within :func:`scratch` takes it away at its end."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _run.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, ``compression`` as the writer names it.

    This cuts the lineage: a lost executor costs its running tasks, not the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """(Hadoop's path, its file system), whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system."""
    for path in paths:
        where, system = _files(spark, path)
        system.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, which says that something is complete."""
    where, system = _files(spark, path)
    system.create(where, True).close()


def folders(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    """(number, path) of what stands in a folder as name=<number>, or as plain name with the number 0."""
    where, system = _files(spark, path)
    if not system.exists(where):
        return []
    found = [str(status.getPath().toString()) for status in system.listStatus(where)]
    named = [(re.fullmatch(rf"{re.escape(name)}(?:=(\d+))?", f.rsplit("/", 1)[1]), f) for f in found]
    return sorted((int(m[1] or 0), f) for m, f in named if m)


class Run:
    """What :func:`scratch` gives: called with a table and a name it writes the table as one that stays."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        self.kept.append(self.paths[-1])
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Run]:
    """A run: the intermediate tables that are written within it, by this thread, go at its end; what is kept stays.

    with scratch(spark) as keep:
        result = keep(work(docs), "result")  # the tables that ``work`` wrote go at the end

    Runs may be nested or go on at once in several threads: each has its own tables only, and what an
    inner run keeps is the outer run's.
    """
    outer, run = _run.get(), Run()
    token = _run.set(run.paths)
    try:
        yield run
    finally:
        _run.reset(token)
        if outer is not None:
            outer += run.kept
        removed(spark, [path for path in run.paths if path not in run.kept])
