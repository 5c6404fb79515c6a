"""Semi-supervised training of a linear head: weak and strong views, masked pseudo-labels.

The rows are written once as a training table, laid out by share: each class is dealt evenly over
``batches`` shares in a seeded order, and step k reads share k mod ``batches`` only, by partition
pruning. A step is one distributed sum of gradients: tasks add up their rows, executors add up the
tasks' sums in groups, and one row of a few numbers reaches the driver, which updates the weights.
Held-out rows stand in a share of their own; every ``eval_every`` steps the next step's job reads it
too and counts the averaged weights' hits, so an evaluation costs no job of its own but for the last.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.operators.rank import global_rank, stable_order
from starsift.plans.scoring import LinearModel
from starsift.storage import new_path

log = logging.getLogger(__name__)

#: The share of held-out rows; files of a share; partial sums that one task adds up.
HELD_OUT, FILES, FAN = -1, 16, 64


@dataclass
class Config:
    seed: int = 42
    steps: int = 200
    lr: float = 0.0075
    weight_decay: float = 7.5e-4
    optimizer: str = "SGD"
    momentum: float = 0.9
    ema: float = 0.99
    hard_label: bool = True
    temperature: float = 0.5
    cutoff: float = 0.95
    unlabeled_weight: float = 1.0
    oversample: bool = True
    warmup: int = 0
    cosine: bool = False
    weak_noise: float = 0.01
    strong_noise: float = 0.05
    strong_drop: float = 0.25
    batches: int = 1
    eval_every: int = 0


@dataclass
class State:
    """All that a further step needs: weights (features and intercept by two), their average, the optimizer's sums, the step; and the best average yet."""

    theta: np.ndarray
    average: np.ndarray
    speed: np.ndarray
    square: np.ndarray
    step: int = 0
    best: np.ndarray | None = None
    best_step: int = 0
    best_accuracy: float = -1.0


@dataclass
class Fit:
    """``model`` is the averaged weights with the best held-out accuracy, or the last ones without evaluation; ``last`` the last ones."""

    model: LinearModel
    train: LinearModel
    history: list[dict[str, float]] = field(default_factory=list)
    last: LinearModel | None = None
    state: State | None = None


def rate_at(cfg: Config, step: int) -> float:
    """The step's share of the learning rate: linear warm-up, then max(0, cos(7 pi / 16 of progress)) if asked."""
    if step < cfg.warmup:
        return step / max(1, cfg.warmup)
    if not cfg.cosine:
        return 1.0
    return max(0.0, math.cos(math.pi * 7 / 16 * (step - cfg.warmup) / max(1, cfg.steps - cfg.warmup)))


def training_table(rows: DataFrame, cfg: Config, held_out: DataFrame | None = None) -> DataFrame:
    """(key, features, label, share) of (filename, features, label), written by share.

    Within a class, the place in a seeded order of filenames modulo ``batches`` names the share, so each
    share has its part of every class to within a row. Labels are 0, 1 or -1 for unknown; rows of
    ``held_out`` with an unknown label are left out.
    """
    spark = rows.sparkSession
    rows = rows.select("filename", "features", F.col("label").cast("int").alias("label"))
    if cfg.batches > 1:
        ranked = global_rank(rows.withColumn("place", stable_order(cfg.seed)), [F.asc("place"), F.asc("filename")], ["label"], "nth")
        dealt = ranked.withColumn("share", ((F.col("nth") - 1) % cfg.batches).cast("int")).drop("nth", "place")
    else:
        dealt = rows.withColumn("share", F.lit(0))
    if held_out is not None:
        known = held_out.select("filename", "features", F.col("label").cast("int").alias("label")).filter("label >= 0")
        dealt = dealt.unionByName(known.withColumn("share", F.lit(HELD_OUT)))
    table = dealt.select(F.xxhash64("filename").alias("key"), F.col("features").cast("array<double>").alias("features"), "label", "share")
    path = new_path(spark, "training")
    # Equal sums at each run: a file's rows are in an order of their own, whatever order they came in.
    table.repartition("share", F.pmod("key", F.lit(FILES))).sortWithinPartitions("share", "label", "key").write.partitionBy("share").parquet(path)
    return spark.read.schema("key long, features array<double>, label int, share int").parquet(path)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random, made of others: a public mixing function of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _normal(seeds: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Two rows of d standard normal numbers for each seed."""
    numbers = _mixed(seeds[:, None] + np.arange(1, 2 * d + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    unit = ((numbers >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    radius, turn = np.sqrt(-2 * np.log(unit[:, :d])), 2 * np.pi * unit[:, d:]
    return radius * np.cos(turn), radius * np.sin(turn)


def _features(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _step(theta: np.ndarray, average: np.ndarray, cfg: Config, step: int, weights: dict[int, float]):
    """A task's sums: gradients of labeled and unlabeled rows, six sums of losses, and of held-out rows (n, hits, loss)."""
    d = len(theta) - 1
    w, b = theta[:d], theta[d]
    class_weight = np.array([weights.get(0, 0.0), weights.get(1, 0.0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeled, unlabeled, loss, judged = np.zeros((d + 1, 2)), np.zeros((d + 1, 2)), np.zeros(6), np.zeros(3)
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()
            every = _features(batch.column(1), d)
            label, share = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            out = share == HELD_OUT
            if out.any():
                z, y = every[out] @ average[:d] + average[d], label[out]
                right = np.log(_softmax(z)[np.arange(len(y)), y] + 1e-300)
                judged += [len(y), (z.argmax(axis=1) == y).sum(), -right.sum()]
            lb, ub = (label >= 0) & ~out, (label < 0) & ~out
            if lb.any():
                x, y = every[lb], label[lb]
                p, times = _softmax(x @ w + b), class_weight[y]
                g = (p - np.eye(2)[y]) * times[:, None]
                labeled[:d] += x.T @ g
                labeled[d] += g.sum(axis=0)
                loss[:2] += [(-np.log(np.maximum(p[np.arange(len(p)), y], 1e-300)) * times).sum(), times.sum()]
            if ub.any():
                u = every[ub]
                with np.errstate(over="ignore"):
                    seeds = _mixed(batch.column(0).to_numpy(zero_copy_only=False)[ub].view(np.uint64) + _mixed(np.array([cfg.seed * 1_000_003 + step], dtype=np.uint64)))
                    light, heavy = _normal(seeds, d)
                weak, strong = u + cfg.weak_noise * light, u + cfg.strong_noise * heavy
                width = max(1, int(cfg.strong_drop * d))
                start = (seeds % np.uint64(d - width + 1)).astype(np.int64)
                at = np.arange(d)[None, :]
                strong[(at >= start[:, None]) & (at < start[:, None] + width)] = 0
                z = weak @ w + b
                q = _softmax(z)
                mask = q.max(axis=1) >= cfg.cutoff
                target = np.eye(2)[q.argmax(axis=1)] if cfg.hard_label else _softmax(z / cfg.temperature)
                p = _softmax(strong @ w + b)
                g = (p - target) * mask[:, None]
                unlabeled[:d] += strong.T @ g
                unlabeled[d] += g.sum(axis=0)
                loss[2:5] += [(mask * -(target * np.log(np.maximum(p, 1e-300))).sum(axis=1)).sum(), len(u), mask.sum()]
        if part is not None:
            yield _sums_row(part, np.concatenate([labeled.ravel(), unlabeled.ravel(), loss, judged]))

    return run


_SUMS = "part long, values array<double>"


def _sums_row(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([values], pa.list_(pa.float64()))], names=["part", "values"])


def _added(fan: int | None):
    """Rows of sums added up in their order, one row for each group of ``fan`` parts, or one row; parts are numbered by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total = None, None
        for batch in batches:
            for part, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row, own = values.values.to_numpy(zero_copy_only=False), part // fan if fan else 0
                if own != group:
                    if total is not None:
                        yield _sums_row(group, total)
                    group, total = own, np.zeros(len(row))
                total += row
        if total is not None:
            yield _sums_row(group, total)

    return run


def summed(parts: DataFrame, tasks: int, fan: int = FAN) -> np.ndarray | None:
    """The sum of all rows of (part, values), from about ``tasks`` parts, by a tree of executors; one row comes to the driver."""
    while tasks > fan:
        tasks = -(-tasks // fan)
        parts = parts.repartition(tasks, F.floor(F.col("part") / fan)).sortWithinPartitions("part").mapInArrow(_added(fan), _SUMS)
    row = parts.repartition(1).sortWithinPartitions("part").mapInArrow(_added(None), _SUMS).first()
    return None if row is None else np.array(row["values"])


def _checked(cfg: Config) -> None:
    if cfg.optimizer not in ("SGD", "Adam"):
        raise ValueError(f"unknown optimizer {cfg.optimizer}")
    if cfg.optimizer == "Adam" and cfg.lr > 0.005:
        raise ValueError("the learning rate is too high for Adam")
    if cfg.batches < 1:
        raise ValueError("batches is at least 1")


def _updated(state: State, g: np.ndarray, cfg: Config) -> None:
    """One step of the optimizer and of the moving average."""
    lr = cfg.lr * rate_at(cfg, state.step)
    if cfg.optimizer == "SGD":
        state.speed = cfg.momentum * state.speed + g
        state.theta = state.theta - lr * (g + cfg.momentum * state.speed)
    else:
        state.speed, state.square = 0.9 * state.speed + 0.1 * g, 0.999 * state.square + 0.001 * g * g
        state.theta = state.theta - lr * (state.speed / (1 - 0.9 ** (state.step + 1))) / (np.sqrt(state.square / (1 - 0.999 ** (state.step + 1))) + 1e-8)
    state.average = cfg.ema * state.average + (1 - cfg.ema) * state.theta
    state.step += 1


def fit(rows: DataFrame, cfg: Config | None = None, start: LinearModel | None = None, held_out: DataFrame | None = None, resume: State | None = None, until: int | None = None) -> Fit:
    """Train on (filename, features, label) with label 0, 1 or -1 for unknown, or on a :func:`training_table`.

    Training begins at zero, at ``start``, or where ``resume`` ended, and stops after ``cfg.steps`` steps
    in all, or ``until``; in pieces it comes to what it comes to at once, on one training table.
    Scores come from the moving average of the weights. With ``cfg.eval_every`` and ``held_out`` rows
    the history has their accuracy and loss after each so many steps and at the end, and the model is
    the average with the most hits, the earlier of equal ones. Raises without labeled or unlabeled rows.
    """
    cfg = cfg or Config()
    _checked(cfg)
    table = rows if "share" in rows.columns else training_table(rows, cfg, held_out)
    counts = {(r["out"], r["label"]): r["count"] for r in table.groupBy((F.col("share") == HELD_OUT).alias("out"), "label").count().collect()}
    known = {label: n for (out, label), n in counts.items() if not out and label >= 0}
    if not counts.get((False, -1)) or not known:
        raise ValueError("training needs labeled and unlabeled rows")
    judging = cfg.eval_every > 0 and any(out for out, _ in counts)
    weights = {k: (1.0 / n if cfg.oversample and len(known) > 1 else 1.0) for k, n in known.items()}
    if resume is not None:
        state = State(**vars(resume))
        d = len(state.theta) - 1
    else:
        d = len(table.select("features").first()[0])
        theta = np.zeros((d + 1, 2)) if start is None else np.vstack([np.array(start.weights), np.array(start.bias)])
        state = State(theta, theta.copy(), np.zeros_like(theta), np.zeros_like(theta))
    decay = np.vstack([np.full((d, 2), cfg.weight_decay), np.zeros((1, 2))])  # none on the intercept
    size, history = (d + 1) * 2, []

    def sums(shares: list[int]) -> np.ndarray:
        read = table.filter(F.col("share").isin(shares)).select("key", "features", "label", "share", F.spark_partition_id().alias("part"))
        found = summed(read.mapInArrow(_step(state.theta, state.average, cfg, state.step, weights), _SUMS), tasks)
        return np.zeros(2 * size + 9) if found is None else found

    def judge(judged: np.ndarray) -> None:
        """Note the average's hits and loss, of the weights as they were at the last step's end."""
        accuracy = float(judged[1] / judged[0])
        if history:
            history[-1] |= {"accuracy": accuracy, "eval_loss": float(judged[2] / judged[0])}
        if accuracy > state.best_accuracy:
            state.best, state.best_step, state.best_accuracy = state.average.copy(), state.step, accuracy

    tasks = table.rdd.getNumPartitions()  # of the whole table; a step's are fewer
    last = cfg.steps if until is None else min(until, cfg.steps)
    while state.step < last:
        due = judging and state.step > 0 and state.step % cfg.eval_every == 0
        total = sums([state.step % cfg.batches, HELD_OUT] if due else [state.step % cfg.batches])
        if due:
            judge(total[2 * size + 6 :])
        sup, uns, loss = total[:size].reshape(d + 1, 2), total[size : 2 * size].reshape(d + 1, 2), total[2 * size :]
        g = sup / max(loss[1], 1e-12) + cfg.unlabeled_weight * uns / max(loss[3], 1) + decay * state.theta
        step, sup_loss, uns_loss = state.step, loss[0] / max(loss[1], 1e-12), loss[2] / max(loss[3], 1)
        history.append({"step": step, "sup_loss": float(sup_loss), "unsup_loss": float(uns_loss), "total_loss": float(sup_loss + cfg.unlabeled_weight * uns_loss), "mask_ratio": float(1 - loss[4] / max(loss[3], 1)), "learning_rate": cfg.lr * rate_at(cfg, step)})
        _updated(state, g, cfg)
    if judging and state.step == cfg.steps:
        judge(sums([HELD_OUT])[2 * size + 6 :])
    as_model = lambda t: LinearModel(t[:d].tolist(), t[d].tolist())
    best = state.average if state.best is None else state.best
    return Fit(as_model(best), as_model(state.theta), history, as_model(state.average), state)


_ARRAYS, _NUMBERS = ("theta", "average", "speed", "square", "best"), ("step", "best_step", "best_accuracy")


def save_state(spark: SparkSession, state: State, path: str) -> None:
    """The state as rows (name, value) under ``path``, and a row that says that they are complete.

    States of several steps may stand under one path. One that lacks its mark, as its writer was lost,
    is none.
    """
    rows = [(name, np.asarray(getattr(state, name), dtype=np.float64).ravel().tolist()) for name in _ARRAYS if getattr(state, name) is not None]
    rows += [(name, [float(getattr(state, name))]) for name in _NUMBERS]
    spark.createDataFrame(rows, "name string, value array<double>").write.mode("overwrite").parquet(f"{path}/states/step={state.step}")
    spark.createDataFrame([(state.step, len(rows))], "step int, n_rows int").write.mode("append").parquet(f"{path}/complete")


def load_state(spark: SparkSession, path: str, step: int | None = None, strict: bool = True) -> State | None:
    """The complete state of ``step``, or the newest; names that it doesn't know are skipped.

    Without one it raises; not ``strict``, it logs that and returns None.
    """
    try:
        complete = spark.read.parquet(f"{path}/complete")
        newest = complete.agg(F.max("step")).first()[0] if step is None else step
        if complete.filter(F.col("step") == newest).isEmpty():
            raise KeyError(f"no complete state of step {newest} under {path}")
        rows = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/states/step={newest}").collect()}
    except (AnalysisException, KeyError) as lack:
        if strict:
            raise
        log.error("no state to go on from: %s", lack)
        return None
    if skipped := sorted(set(rows) - {*_ARRAYS, *_NUMBERS}):
        log.info("skipped %s", ", ".join(skipped))
    arrays = {name: np.array(rows[name]).reshape(-1, 2) for name in _ARRAYS if name in rows}
    return State(**arrays, step=int(rows["step"][0]), best_step=int(rows["best_step"][0]), best_accuracy=rows["best_accuracy"][0])


def save_model(spark: SparkSession, fitted: Fit, path: str) -> None:
    """Rows (name, iteration, value) of both weight sets."""
    steps = fitted.state.step if fitted.state else len(fitted.history)
    rows = [(name, steps, [x for row in m.weights for x in row] + list(m.bias)) for name, m in (("eval", fitted.model), ("train", fitted.train))]
    spark.createDataFrame(rows, "name string, iteration int, value array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str, name: str = "eval", strict: bool = True) -> LinearModel | None:
    """A weight set; raises where it lacks, or logs that and returns None if not strict."""
    try:
        row = spark.read.parquet(path).filter(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
    except (AnalysisException, KeyError) as lack:
        if strict:
            raise
        log.error("no model under %s: %s", path, lack)
        return None
    values = row["value"]
    return LinearModel([values[k : k + 2] for k in range(0, len(values) - 2, 2)], values[-2:])
