"""Active learning: labels, batch, fit, score, evaluate, corrections; and runs over several classes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.functions.metrics import evaluate
from starsift.operators import labels as L
from starsift.operators.rank import next_unlabeled_batch
from starsift.plans.fixmatch import Config, Fit, fit
from starsift.plans.scoring import score_linear
from starsift.storage import written


@dataclass
class State:
    """What goes from round to round: labels (filename, label), the cursor and the model."""

    labels: DataFrame
    cursor: int = 0
    fitted: Fit | None = None


@dataclass
class Round:
    state: State
    scores: DataFrame
    metrics: DataFrame
    corrections: DataFrame


def active_learning_round(features: DataFrame, truth: DataFrame, state: State, cls: int, cfg: Config, n_to_load: int = 1000, n_corrections: int = 20) -> Round:
    """One round over (filename, features) and (filename, label_idx).

    The batch of unlabeled rows and all labeled ones train the model; every row is scored; metrics
    leave out the labeled ones; corrections are the highest scores of each class in the batch,
    labeled by truth, and are written into the labels.
    """
    batch, cursor = next_unlabeled_batch(features.select("filename"), state.labels, state.cursor, n_to_load, cfg.seed)
    batch = written(batch.select("filename"), "batch")
    labeled = features.join(state.labels.select("filename", L.encode(F.col("label")).alias("label")), "filename")
    loaded = features.join(batch, "filename", "left_semi").withColumn("label", F.lit(L.UNKNOWN))
    fitted = fit(labeled.unionByName(loaded), cfg, state.fitted.train if state.fitted else None)
    scores = written(score_linear(features, fitted.model).select("filename", "score"), "scores")
    judged = L.one_vs_rest(L.attach_truth(L.drop_labeled(scores, state.labels), truth), cls)
    corrections = written(L.find_corrections(L.restrict_to_batch(judged, batch), n_corrections), "corrections")
    edits = corrections.select("filename", "label", F.lit(1).alias("turn"))
    labels = written(L.upsert(state.labels, edits, ["turn"]), "labels")
    return Round(State(labels, cursor, fitted), scores, evaluate(judged), corrections)


def multi_class_metrics(pred: DataFrame, classes: Sequence[int], label: str = "label_idx") -> DataFrame:
    """(anomaly_class, metrics) of (filename, score, label): all one-vs-rest classes in one job, the class as a column."""
    every = pred.withColumn("anomaly_class", F.explode(F.array(*map(F.lit, classes)))).withColumn("truth", (F.col(label) == F.col("anomaly_class")).cast("int"))
    return evaluate(every, keys=["anomaly_class"])


def sweep(features: DataFrame, truth: DataFrame, classes: Sequence[int], cfg: Config, rounds: int = 1, initial: int = 40, ratio: float = 0.25) -> DataFrame:
    """(anomaly_class, iteration, metrics): rounds of each class; fits follow each other on the driver."""
    from starsift.operators.sampling import initial_labels

    out = None
    for cls in classes:
        state = State(written(initial_labels(truth, cls, initial, ratio, cfg.seed), "initial"))
        for k in range(rounds):
            done = active_learning_round(features, truth, state, cls, cfg)
            state = done.state
            row = done.metrics.withColumn("anomaly_class", F.lit(cls)).withColumn("iteration", F.lit(k))
            out = row if out is None else out.unionByName(row)
    return out
