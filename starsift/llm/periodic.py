"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least LEAST_REPEATS * q and LEAST_WORDS long,
that no neighbour extends. Scale k looks for periods of more than k / 2 and up to k words. Every
window of k / 2 places has its least k-word string (its minimizer), and inside a run the minimizer of
a window stands again one period later, as that window does. A string of k words repeats within a run
of period q <= k at multiples of q alone, so two places of equal minimizers that follow each other are
one period apart: such a pair seeds an extension to both sides. Periods under SHORTEST have too few
words for windows, so they are read off the words that equal the one q places before (lag scans).

Words are compared by numbers given out per group of documents, so an extension is exact; the hashes of
k-word strings choose places only. A document is one row and its runs are one task's work; tasks take
documents in groups of about GROUP words, between which marks that equal nothing keep runs apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_REPEATS = 6, 4
#: The first scale; shorter periods go by lag scans.
SHORTEST = 16
#: Words of documents that a task holds at once; a longer document is a group of its own.
GROUP = 1 << 18

WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"

_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _TURN
    return (x ^ (x >> np.uint64(32))) * _STEP


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of true values begins and ends."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    return edges[::2], edges[1::2]


def _over_windows(values: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """The ``pick`` (least or greatest) of each ``window`` neighbouring values; ``window`` is a power of two."""
    size = 1
    while size < window:
        values, size = pick(values[:-size], values[size:]), size * 2
    return values


def _seeds(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of minimizers of scale k whose next equal one is more than k / 2 and at most k words on.

    ``hashes`` has one number for each string of k words.
    """
    window = k // 2
    least = _over_windows(hashes, window, np.minimum)
    # A place is a minimizer if the greatest of the least hashes of the windows that hold it is its own.
    edge = np.zeros(window - 1, dtype=np.uint64)
    places = np.flatnonzero(_over_windows(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)
    order = np.argsort(hashes[places], kind="stable")
    first, then = places[order[:-1]], places[order[1:]]
    lag = then - first
    good = (hashes[first] == hashes[then]) & (lag > k // 2) & (lag <= k)
    return first[good], lag[good]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of ``a`` and ``b`` are equal."""
    at, size, n = 0, 64, min(len(a), len(b))
    while at < n:
        end = min(n, at + size)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, size = end, size * 2
    return n


def runs_of(codes: np.ndarray, longest: int) -> np.ndarray:
    """(runs, 3) rows of start, length and period, by start and then period.

    ``longest`` is the length of the longest document among the codes; longer periods are not tried.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        # The same stretch may have a multiple of its period too; the smallest is its period.
        if end - start >= max(LEAST_WORDS, LEAST_REPEATS * period):
            found[start, end] = min(period, found.get((start, end), period))

    n = len(codes)
    for period in range(1, min(SHORTEST // 2, longest // LEAST_REPEATS) + 1):
        starts, ends = _stretches(codes[period:] == codes[:-period])
        long = ends - starts >= max(LEAST_WORDS, LEAST_REPEATS * period) - period
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            keep(start, end + period, period)
    with np.errstate(over="ignore"):
        hashes, k = _mixed(codes.astype(np.uint64) + _STEP), 1
        while k < longest // LEAST_REPEATS and len(hashes) > 3 * k:
            hashes, k = _mixed(_mixed(hashes[:-k]) + hashes[k:]), 2 * k
            if k < SHORTEST:
                continue
            places, lags = _seeds(hashes, k)
            reached: dict[int, int] = {}
            for at, lag in sorted(zip(places.tolist(), lags.tolist(), strict=True)):
                if at < reached.get(lag, -1):
                    continue  # within a stretch of this period that is known
                right = at + _reach(codes[at : n - lag], codes[at + lag :])
                left = at - _reach(codes[:at][::-1], codes[lag : at + lag][::-1])
                reached[lag] = right
                keep(left, right + lag, lag)
    return np.array(sorted((start, end - start, period) for (start, end), period in found.items()), dtype=np.int64).reshape(-1, 3)


def _found(group: list[list[str]]) -> Iterator[tuple[list[tuple[int, int, int]], list[str]]]:
    """For each list of words its runs and the words that no run repeats."""
    lengths = np.array([len(words) for words in group])
    codes = pd.factorize(np.array([w for words in group for w in [*words, None]], dtype=object), use_na_sentinel=True)[0].astype(np.int64)
    marks = np.flatnonzero(codes < 0)
    codes[marks] = -1 - np.arange(len(marks))  # a mark of its own after each document
    runs = runs_of(codes, int(lengths.max(initial=0)))
    starts = np.concatenate([[0], marks[:-1] + 1])
    own = np.searchsorted(starts, runs[:, 0], side="right") - 1
    at = 0
    for nth, words in enumerate(group):
        some = []
        while at < len(runs) and own[at] == nth:
            some.append((int(runs[at, 0] - starts[nth]), int(runs[at, 1]), int(runs[at, 2])))
            at += 1
        kept = words
        if some:
            stays = np.ones(len(words), dtype=bool)
            for start, length, period in some:
                stays[start + period : start + length] = False
            kept = [w for w, stay in zip(words, stays.tolist(), strict=True) if stay]
        yield some, kept


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find = re.compile(WORD).findall
    ids: list = []
    words: list[list[str]] = []
    held = 0

    def done() -> pd.DataFrame:
        found = list(_found(words))
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in some] for some, _ in found]
        return pd.DataFrame({"row": ids, "n_words": [len(w) for w in words], "runs": runs, "collapsed": [" ".join(kept) for _, kept in found]})

    for batch in batches:
        for row, text in zip(batch["row"], batch["text"], strict=True):
            ids.append(row)
            words.append(find(text))
            held += len(words[-1])
            if held >= GROUP:
                yield done()
                ids, words, held = [], [], 0
    if ids:
        yield done()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` has start, length and period of each run, in words, by start and then period; runs may
    overlap. ``collapsed`` is the text without the words that stand in a run after its first period,
    joined by single spaces. A null or empty text has no words, no runs and an empty text; very long
    texts are searched whole; ids may be null or repeat, each row has its own result; other columns of
    ``docs``, whatever their names, change nothing; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = rows.mapInPandas(_groups, f"row struct<id:{kind}>, n_words long, runs {RUNS}, collapsed string")
    return found.select(F.col("row.id").alias(id_col), "n_words", "runs", "collapsed")


def strongest(runs: str = "runs") -> F.Column:
    """The run with the greatest length / period, compared as fractions; of equal ones the first; null if none."""
    return F.aggregate(
        F.col(runs),
        F.lit(None).cast(RUNS[len("array<") : -1]),
        lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best),
    )
