"""Streams of predictions and labels: running top-N, rates, first and last writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from starsift.operators.labels import latest
from starsift.operators.rank import top_n
from starsift.storage import folders, mark, removed


def _start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_search(source: DataFrame, scored: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Score a stream and keep all predictions under ``store``, a folder for each batch.

    A batch that runs again overwrites its own folder, so nothing counts twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored(batch).write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")

    return _start(source, checkpoint, write)


def stream_top_n(pred: DataFrame, n: int, store: str, checkpoint: str) -> StreamingQuery:
    """The running n highest of (filename, score, ...) under ``store``: of the last state and the batch only.

    A state that is gone stops the stream: winners of earlier batches would be lost without a word. The
    last state and the one before, from which a batch may run again, are kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{store}/state={batch_id - 1}") if batch_id else None
        rows = batch if before is None else batch.unionByName(before.select(batch.columns))
        top_n(rows, n).write.mode("overwrite").parquet(f"{store}/state={batch_id}")
        removed(spark, [path for k, path in folders(spark, store, "state") if k < batch_id - 1])

    return _start(pred, checkpoint, write)


def newest_state(spark: SparkSession, store: str) -> DataFrame:
    """The rows of the last state that a stream wrote under ``store``."""
    rows = spark.read.parquet(store)
    last = rows.agg(F.max("state")).first()[0]
    return rows.filter(F.col("state") == last).drop("state")


def stream_labels(edits: DataFrame, order: list[str], store: str, checkpoint: str, key: str = "filename", compact: int = 16) -> StreamingQuery:
    """The last label of each key, by ``order`` columns, under ``store``; :func:`label_state` reads it."""
    return stream_keyed(edits, key, ["label"], order, store, checkpoint, compact)


def label_state(spark: SparkSession, store: str, order: list[str], key: str = "filename", upto: int | None = None) -> DataFrame:
    """The last label of each key that :func:`stream_labels` knows, up to a batch."""
    return keyed_state(spark, store, key, ["label"], order, upto)


def stream_keyed(rows: DataFrame, key: str, columns: list[str], order: list[str], store: str, checkpoint: str, compact: int = 16, first: bool = False) -> StreamingQuery:
    """The last row of each key by ``order``, or the first one, under ``store``: a base and what the batches since then changed.

    A batch writes its own rows only, as ``delta=<batch>``. Every ``compact`` batches the base and the
    deltas become a new base, ``base=<batch>``; then those it holds are removed. A batch that runs again
    writes its delta again, and a base that is there stays as it is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        picked(batch, key, columns, order, first).write.mode("overwrite").parquet(f"{store}/delta={batch_id}")
        mark(spark, f"{store}/delta_done={batch_id}")
        if (batch_id + 1) % compact:
            return
        if batch_id not in {k for k, _ in _complete(spark, store, "base")}:
            keyed_state(spark, store, key, columns, order, batch_id, first).write.mode("overwrite").parquet(f"{store}/base={batch_id}")
            mark(spark, f"{store}/base_done={batch_id}")
        for name, last in (("base_done", batch_id - 1), ("base", batch_id - 1), ("delta_done", batch_id), ("delta", batch_id)):
            removed(spark, [path for k, path in folders(spark, store, name) if k <= last])

    return _start(rows, checkpoint, write)


def picked(rows: DataFrame, key: str, columns: list[str], order: list[str], first: bool = False) -> DataFrame:
    """(key, columns, order) of the last row of each key, or the first."""
    own = list(dict.fromkeys([*columns, *order]))
    pick = F.min_by if first else F.max_by
    return rows.groupBy(key).agg(pick(F.struct(*own), F.struct(*order)).alias("one")).select(key, "one.*")


def _complete(spark: SparkSession, store: str, name: str) -> list[tuple[int, str]]:
    """The folders name=<number> whose writer came to its end."""
    done = {k for k, _ in folders(spark, store, f"{name}_done")}
    return [(k, path) for k, path in folders(spark, store, name) if k in done]


def keyed_state(spark: SparkSession, store: str, key: str, columns: list[str], order: list[str], upto: int | None = None, first: bool = False) -> DataFrame:
    """What :func:`stream_keyed` knows, up to a batch: the newest base and the deltas after it."""
    bases = [(k, path) for k, path in _complete(spark, store, "base") if upto is None or k <= upto]
    since, base = max(bases, default=(-1, None))
    deltas = [path for k, path in _complete(spark, store, "delta") if k > since and (upto is None or k <= upto)]
    return picked(spark.read.parquet(*([base] if base else []), *deltas), key, columns, order, first)


def tumbling_rate(rows: DataFrame, seconds: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """(start, rows, rate) of a stream or table with a timestamp ts, in windows of ``seconds``."""
    if rows.isStreaming:
        rows = rows.withWatermark("ts", watermark)
    counts = rows.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("rows"))
    return counts.select(F.col("w.start").alias("start"), "rows", (F.col("rows") / seconds).alias("rate"))


def stream_dedup(rows: DataFrame, key: str = "filename", watermark: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


class _Rates(StatefulProcessor):
    """Adds up the counts of closed units of a key, and reports them by count or by time."""

    def __init__(self, key: str, count: int, seconds: int, unit: int) -> None:
        self.key, self.count, self.seconds, self.unit = key, count, seconds, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows long, start long, total long")

    def _report(self, key: tuple, start: int, rows: int, seconds: int, total: int) -> tuple:
        return (*key, pd.Timestamp(start, unit="s"), rows, seconds, total)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, "start", "rows", "seconds", "total"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, start, total = self.held.get() if self.held.exists() else (0, 0, 0)
        out = []
        # A unit is closed once, and units that close later are later ones; so order matters within a batch only.
        for at, n in sorted((int(at), int(n)) for batch in rows for at, n in zip(batch["at"], batch["n"], strict=True)):
            if held and at - start >= self.seconds:
                out.append(self._report(key, start, held, self.seconds, total))
                held = 0
            start = start if held else at
            held, total = held + n, total + n
            if held >= self.count:
                out.append(self._report(key, start, held, at + self.unit - start, total))
                held = 0
        self.held.update((held, start, total))
        if held:
            self.handle.registerTimer((start + self.seconds) * 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, start, total = self.held.get() if self.held.exists() else (0, 0, 0)
        out = []
        if held and (start + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._report(key, start, held, self.seconds, total))
            self.held.update((0, start, total))
        yield self._frame(out)

    def close(self) -> None:
        pass


def rate_by_count_or_time(rows: DataFrame, key: str, count: int = 10_000, seconds: int = 60, unit: int = 1, watermark: str = "10 minutes") -> DataFrame:
    """(key, start, rows, seconds, total): reported when ``count`` rows have come or ``seconds`` have passed.

    Time is the stream's own (ts), in units of ``unit`` seconds, of which ``seconds`` is a multiple. Spark
    counts the rows of each key and unit, in parts before the shuffle, so that a hot key is a few
    numbers a unit; a unit is taken as it closes behind the watermark. A report by count takes the
    unit's rows whole, so it may have more; one by time comes by the next unit or, where none comes, by
    a timer. Reports are the same however the rows are cut into batches. The session needs the
    RocksDB state store.
    """
    if seconds % unit:
        raise ValueError("seconds is a multiple of unit")
    kind = rows.schema[key].dataType.simpleString()
    units = rows.withWatermark("ts", watermark).groupBy(key, F.window("ts", f"{unit} seconds").alias("w")).agg(F.count("*").alias("n"))
    closed = units.select(key, F.window_time("w").alias("ts"), F.unix_seconds(F.col("w.start")).alias("at"), "n")
    return closed.groupBy(key).transformWithStateInPandas(_Rates(key, count, seconds, unit), f"{key} {kind}, start timestamp, rows long, seconds long, total long", "Append", "EventTime")


def latest_labels(edits: DataFrame, order: list[str]) -> DataFrame:
    """The batch answer that :func:`stream_labels` must come to."""
    return latest(edits, order)
