"""Quality by importance resampling.

Words and pairs of words are hashed into BUCKETS. Two generative models are the shares of the
buckets: in target texts (labelled rows of good quality) and in all texts. A document's log weight
is the sum over its n-grams of log(target share / raw share). Adding Gumbel noise and keeping the
largest k is sampling k documents without replacement in proportion to their weights.

The models are two tables of BUCKETS numbers, whatever the size of the corpus; the k largest are
found by positions in a global order, never in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.operators.rank import global_rank
from starsift.storage import written

#: Buckets of the hashed n-grams, counts that each bucket begins with, labelled rows of the target model at most.
BUCKETS, SMOOTHING, FIT_ROWS = 1 << 16, 1.0, 40_000
SEED = 42

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of tokens, kept for tokens met before."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = xxhash.xxh64_intdigest(token)
        return found


def ngrams(text: str, known: dict[str, int]) -> np.ndarray:
    """The buckets of the words and pairs of words of a text; runs of signs are words."""
    found = _TOKEN.findall(text)
    one = np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))
    two = (one[:-1] * _MIX) ^ (one[1:] + (one[:-1] >> np.uint64(17)))
    mixed = np.concatenate([one, two]) * _MIX
    return (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, counts = _Hashes(), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            np.add.at(counts, ngrams(text.as_py() or "", known), 1)
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log shares of the buckets in all texts of ``docs``."""
    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.full(BUCKETS, SMOOTHING)
    for r in rows.toLocalIterator():  # BUCKETS rows at most
        counts[r["bucket"]] += r["n"]
    return np.log(counts / counts.sum())


def log_weights(docs: DataFrame, target: np.ndarray, raw: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with log_weight; 0 for a text without words."""
    sent = docs.sparkSession.sparkContext.broadcast(target - raw)

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, known = sent.value, _Hashes()
        for texts in batches:
            yield pd.Series([float(ratio[ngrams(t or "", known)].sum()) for t in texts], dtype="float64")

    return docs.withColumn("log_weight", weigh(F.col(text_col).cast("string")))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, sample_key, rank, kept) for every row of ``docs``.

    ``share`` of all rows is kept (k is rounded up); without it the share of good rows among the
    labelled ones. Keys are the log weight plus Gumbel noise that depends on seed, id and text, so
    reruns agree; equal keys go by id. Null labels or ids don't train; without good rows the target
    is the raw model, and the sample is uniform. Null texts are empty and weigh 1; repeated rows
    have equal keys; very long texts count whole; other columns of ``docs`` change nothing; an empty
    table gives no rows.
    """
    known = labels.select(F.col(id_col).alias("label_id"), (F.col(label_col) > 0).cast("int").alias("good")).dropna()
    rates = known.agg(F.avg("good").alias("share")).first()
    share = share if share is not None else (rates["share"] if rates["share"] is not None else 1.0)
    # At most FIT_ROWS ids.
    chosen = known.filter("good = 1").orderBy(F.xxhash64("label_id"), "label_id").limit(FIT_ROWS).select("label_id").distinct()
    raw = model(docs, text_col)
    best = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("own_text")).join(F.broadcast(chosen), "label_id", "left_semi")
    target = model(best, "own_text")
    if not rates["share"]:
        target = raw
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("own_text"))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "own_text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = log_weights(own, target, raw, "own_text").withColumn("sample_key", F.col("log_weight") - F.log(-F.log(unit)))
    # Written, as ranges are drawn from it before it is dealt out by them.
    keyed = written(keyed.select("doc_id", "log_weight", "sample_key"), "keyed")
    ranked = global_rank(keyed, [F.desc("sample_key"), F.asc("doc_id")])
    k = math.ceil(share * keyed.count())
    return ranked.withColumn("kept", F.col("rank") <= k)
