"""Scoring and search: a pluggable model over any source, all in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starsift.functions.vector import dot
from starsift.operators.rank import top_n
from starsift.sources.images import store_predictions
from starsift.storage import written


@dataclass
class LinearModel:
    """Two-class linear head: weights (features, 2) and biases (2); the score is softmax column 1."""

    weights: list[list[float]]
    bias: list[float]


def score_linear(df: DataFrame, model: LinearModel, features: str = "features") -> DataFrame:
    """``df`` with score: JVM expressions only, as two classes need one sigmoid of the logits' difference."""
    w = np.asarray(model.weights)
    gap = F.array(*(F.lit(float(x)) for x in w[:, 1] - w[:, 0]))
    z = dot(F.col(features), gap) + float(model.bias[1] - model.bias[0])
    return df.withColumn("score", 1 / (1 + F.exp(-z)))


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], Sequence[float]], columns: Sequence[str], batch_size: int = 2500) -> DataFrame:
    """``df`` with score by any model: ``predict`` takes the columns of a batch and returns a score a row.

    Batches come as Arrow record batches; ``batch_size`` bounds what the model sees at once.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [pd.Series(np.asarray(predict(batch.iloc[k : k + batch_size]), dtype=np.float64)) for k in range(0, len(batch), batch_size)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="float64")

    return df.withColumn("score", scored(F.struct(*columns)))


def search(source: DataFrame, scored: Callable[[DataFrame], DataFrame], n: int = 1000, store: str | None = None, payload: Sequence[str] = (), run: str | None = None) -> DataFrame:
    """The n highest scores over all containers of ``source``.

    Payload columns stay out of the sort: the n winners fetch theirs by filename and source, each row
    once. With ``store`` all predictions go to that store in place of earlier ones of the same sources
    (:func:`starsift.sources.images.store_predictions`); they are scored once, written to a folder of the
    run, and from there stored and ranked.
    """
    pred = scored(source)
    narrow = pred.select("filename", "source", "score")
    if store:
        narrow = written(narrow, "predictions")
        store_predictions(narrow, store, run)
    best = top_n(narrow, n)
    if not payload:
        return best
    # Where (filename, source) repeats, the k-th of its winners by score gets the k-th of its rows.
    same, place = Window.partitionBy("filename", "source"), "place"
    won = best.withColumn(place, F.row_number().over(same.orderBy(F.desc("score"))))
    names = won.select("filename", "source").distinct()  # at most n
    rows = scored(source.join(F.broadcast(names), ["filename", "source"])).withColumn(place, F.row_number().over(same.orderBy(F.desc("score"))))
    return rows.select("filename", "source", place, *payload).join(F.broadcast(won), ["filename", "source", place]).select("filename", "source", *payload, "score")
