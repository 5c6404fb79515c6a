"""Toxicity by noisy-channel deobfuscation.

1. A character language model: trigram counts over all texts, summed in Spark. Its table is bounded
   by the alphabet (61 ** 3), whatever the size of the corpus.
2. A word that may be disguised (signs and digits that look like letters, letters in twos or
   more, letters set apart), however long, becomes a lattice of what each character may stand for. Viterbi search
   under the language model restores the word; a word with one reading only stays as it is.
3. The restored words of labelled documents are counted by class, whole and by their beginnings
   (and by how many distinct words share a beginning). Those that tell the classes apart, at most
   ``FEATURES``, are the features of a logistic regression, which scores the restored text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starsift.storage import written

#: Labelled rows that a model is fitted on at most, the smallest by hash of the id.
FIT_ROWS = 40_000
#: Features of a model at most.
FEATURES = 4096
#: Lengths of the beginnings of words that are features, beside whole words.
PREFIXES = (4, 5, 6, 8)
#: Distinct words with a beginning are told apart up to this number.
REPEATS = 3
#: A feature's toxic documents, as a share of all and at least; weight of the prior in its rate; its rate at least; the penalty of its weight.
SHARE, LEAST, PRIOR, TELLING, PENALTY = 0.005, 4, 4.0, 0.25, 3e-4

#: Tokens that a task remembers (550 bytes each where words have features), and counts that it gathers
#: before it hands them on (90 bytes each).
CACHED, FLUSH = 100_000, 100_000
NOTHING: list = []

#: What signs and digits may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
#: Costs in nats: reading a sign as a letter; leaving out a digit, or a sign at an end of the word;
#: each letter more of a run; leaving a gap open between letters set apart; reading a run of two as one
#: letter where other letters of the word stand alone.
READ, LEFT_OUT, END, REPEAT, OPEN, DOUBLED = 1.0, 5.0, 2.0, 1.0, 3.0, 4.0

_SPACED = re.compile(r"(?<!\w)[^\W_](?:[ ._*-][^\W_](?!\w)){2,}")
_SIGNS = re.escape("".join(LOOKS))
_LETTERS = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(rf"(?=.*[^\W\d_])(?:.*[{_SIGNS}]|.*([^\W\d_])\1)", re.S)
_RUN = re.compile(r"([^\W\d_])\1*")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_TWO = re.compile(r"([^\W\d_])\1")
_ENDS = re.compile(r"^[^\w@$!|+(€£¡*]+|[^\w@$!|+(€£¡*]+$|[!$@|+(€£¡*]{3,}$|^[!$@|+(€£¡*]{3,}")

#: The alphabet: 0 is what stands between words, 1 to 26 a to z, then the Latin-1 letters, last any other letter.
_LATIN = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
SIZE = 28 + len(_LATIN)
_CLASS = {chr(97 + k): k + 1 for k in range(26)} | {c: 27 + k for k, c in enumerate(_LATIN)}


def _class_of(char: str) -> int:
    return _CLASS.get(char, SIZE - 1 if char.isalpha() else 0)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.full(0x10000, -1, dtype=np.int64)
    for c in range(0x10000):
        table[c] = 0 if 0xD800 <= c < 0xE000 else _class_of(chr(c))
    counts = np.zeros(SIZE**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            codes = np.frombuffer((" " + (text.as_py() or "").lower() + " ").encode("utf-32-le"), dtype="<u4")
            x = table[np.minimum(codes, 0xFFFF)]
            grams = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
            if len(grams) > SIZE**3:
                counts += np.bincount(grams, minlength=SIZE**3)
            else:
                np.add.at(counts, grams, 1)
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Negative log probabilities of the third character after two, by (first * SIZE + second) * SIZE + third."""
    grams = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.full(SIZE**3, 0.05)
    for row in grams.toLocalIterator():  # SIZE ** 3 rows at most
        counts[row["gram"]] += row["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    return (-np.log(counts / counts.sum(axis=2, keepdims=True))).astype(np.float32).reshape(-1).tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of ``word``, what it may stand for at what cost; runs of a letter are one place."""
    places: list[list[tuple[str, float]]] = []
    k, n = 0, len(word)
    runs = [len(m.group()) for m in _RUN.finditer(word)]
    stretched = len(runs) > 1 and min(runs) > 1  # no letter stands alone
    while k < n:
        char, end = word[k], k + 1
        if char.isalpha():
            while end < n and word[end] == char:
                end += 1
            run = end - k
            if run >= 3:
                places.append([(char, 0.0), (char * 2, REPEAT), (char * run, REPEAT * run)])
            elif run == 2:
                places.append([(char, 0.0), (char * 2, REPEAT)] if stretched else [(char * 2, 0.0), (char, DOUBLED)])
            else:
                places.append([(char, 0.0)])
        elif char in " ._-*" and 0 < k < n - 1 and word[k - 1].isalnum() and word[k + 1].isalnum() and char not in LOOKS:
            places.append([("", 0.0), (" ", OPEN)])
        elif char in LOOKS:
            out = END if k in (0, n - 1) and not char.isdigit() else LEFT_OUT
            places.append([(x, READ) for x in LOOKS[char]] + [(" ", out)])
        else:
            places.append([(" ", 0.0)])
        k = end
    return places


def viterbi(places: list[list[tuple[str, float]]], costs: list[float]) -> str:
    """The cheapest reading of a lattice under the language model, words apart by spaces.

    A state keeps what it read last and the reading before, so the work is linear in the length.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choices in [*places, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, read) in states.items():
            for chars, extra in choices:
                p, q, total = a, b, cost + extra
                for char in chars:
                    c = _class_of(char)
                    if c or q:  # one space is as good as several
                        total += costs[(p * SIZE + q) * SIZE + c]
                        p, q = q, c
                known = after.get((p, q))
                if known is None or total < known[0]:
                    after[p, q] = (total, (read, chars))
        states = after
    least = min(cost for cost, _ in states.values())
    return min(_text(read) for cost, read in states.values() if cost == least)


def _text(read: tuple) -> str:
    parts = []
    while read:
        read, chars = read
        parts.append(chars)
    return "".join(reversed(parts))


def undoubled(word: str, costs: list[float]) -> str | None:
    """What ``viterbi`` reads in a word of letters alone, None where it isn't so plain.

    If no run is longer than two and some letter stands alone, only runs of two have two readings, and
    the costs in which those differ lie between the letters before and after a run.
    """
    if not word.isalpha() or _LONG_RUN.search(word):
        return None
    twos = [m.start() for m in _TWO.finditer(word)]
    if 2 * len(twos) == len(word):
        return None
    out, last = [], 0
    for k in twos:
        a, b, c = (_class_of(word[k - 1]) if k else 0), _class_of(word[k]), (_class_of(word[k + 2]) if k + 2 < len(word) else 0)
        if costs[(a * SIZE + b) * SIZE + c] + DOUBLED < costs[(a * SIZE + b) * SIZE + b] + costs[(b * SIZE + b) * SIZE + c]:
            out.append(word[last : k + 1])
            last = k + 2
    return "".join([*out, word[last:]])


def restore(token: str, costs: list[float]) -> list[str]:
    """The words that ``token`` (without white space but what sets letters apart) stands for, in lower case."""
    bare = token.strip(".,;:?\"'")
    if bare.isascii() and bare.isalpha():  # most tokens: letters alone
        bare = bare.lower()
        if not _TWO.search(bare):
            return [bare]
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token)
    token = token.lower()
    spaced = " " in token
    if not spaced:
        token = _ENDS.sub("", token)
    if spaced or _DISGUISED.match(token) or _SPACED.search(token):
        plain = None if spaced else undoubled(token, costs)
        token = viterbi(lattice(token), costs) if plain is None else plain
    return _LETTERS.findall(token)


def beginnings(word: str) -> list[str]:
    """The whole word, marked by a sign that no word has, and its beginnings."""
    return [word[:k] for k in PREFIXES if len(word) > k] + ([word + "$"] if len(word) >= 3 else [])


def features(words: Iterable[tuple[str, list[str]]]) -> set[str]:
    """Of (word, its beginnings): each beginning, and with + for each further distinct word up to REPEATS."""
    counts = Counter(f for found in dict(words).values() for f in found)
    return {f + "+" * k for f, n in counts.items() for k in range(min(n, REPEATS))}


class _Words(dict):
    """What a function finds in the words of a token, kept for tokens that were met before (up to CACHED)."""

    def __init__(self, costs, find, most: int = CACHED):
        super().__init__()
        self.costs, self.find, self.most = costs, find, most

    def __missing__(self, token):
        if len(self) >= self.most:
            self.clear()
        found = self[token] = self.find(restore(token, self.costs))
        return found


def tokens(text: str) -> set[str]:
    """The distinct tokens of a text, letters set apart as one token each."""
    found = set(text.split())
    found.update(m.group() for m in _SPACED.finditer(text) if " " in m.group())
    return found


@dataclass
class Model:
    """The language model's costs, the weight of each feature, and the score's log odds without any."""

    costs: list[float]
    weights: dict[str, float]
    intercept: float


def _finder(costs: list[float], known: set[str] | None = None) -> _Words:
    """For a token: its restored words with their beginnings, only those of ``known`` if given."""

    def find(words: list[str]) -> list[tuple[str, list[str]]]:
        found = [(w, beginnings(w)) for w in words]
        return [x for x in found if x[1]] or NOTHING

    if known is not None:  # most words have no feature that is known

        def find(words: list[str]) -> list[tuple[str, list[str]]]:
            found = []
            for w in words:
                have = [w[:k] for k in PREFIXES if w[:k] in known and len(w) > k]
                if w + "$" in known and len(w) >= 3:
                    have.append(w + "$")
                if have:
                    found.append((w, have))
            return found or NOTHING

    return _Words(costs, find)


def _count_features(costs: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(costs.value)
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(counts[0].keys() | counts[1].keys())
            made = pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], names=["feature", "pos", "neg"])
            counts[0].clear()
            counts[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(features(x for t in tokens(text.as_py() or "") for x in find[t]))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield out()
        yield out()
        find.clear()

    return run


def _find_features(costs: Broadcast, chosen: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(costs.value, {f.rstrip("+") for f in chosen})
        for batch in batches:
            found = [sorted(features(x for t in tokens(text.as_py() or "") for x in find[t]) & chosen) for text in batch.column(0)]
            yield pa.record_batch([batch.column(1).cast(pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["label", "found"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows of ``docs``, at most ``fit_rows``.

    The language model reads all of ``docs``. Null labels or ids are left out; equal texts with
    equal labels count once. Where a class has no row, or nothing tells the classes apart, every
    text gets one score: the toxic share of the labelled rows, but less than one half.
    """
    spark = docs.sparkSession
    costs = language_model(docs, text_col)
    sent = spark.sparkContext.broadcast(costs)
    chosen = labels.select(F.col(id_col).alias("label_id"), (F.col(label_col) > 0).cast("int").alias("toxic_label")).dropna()
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "toxic_label").limit(fit_rows)
    # At most fit_rows rows of 12 bytes.
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("own_text")).join(F.broadcast(chosen), "label_id")
    rows = written(rows.withColumn("content", F.xxhash64("own_text")).dropDuplicates(["content", "toxic_label"]).select("own_text", "toxic_label"), "labelled")
    n = {r["toxic_label"]: r["count"] for r in rows.groupBy("toxic_label").count().collect()}
    toxic, every = n.get(1, 0), sum(n.values())
    prior = toxic / max(1, every)
    counted = rows.mapInArrow(_count_features(sent), "feature string, pos long, neg long")
    summed = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    met = F.col("pos") + F.col("neg")
    telling = summed.filter((F.col("pos") >= max(LEAST, math.ceil(SHARE * toxic))) & ((F.col("pos") + PRIOR * prior) / (met + PRIOR) >= TELLING))
    best = telling.orderBy(F.desc((F.col("pos") - met * prior) / F.sqrt(met)), "feature").limit(FEATURES)
    names = sorted(r["feature"] for r in best.select("feature").collect())  # FEATURES at most
    if not names or toxic == every:
        share = min(max(prior, 1e-3), 0.49)
        return Model(costs, {}, math.log(share / (1 - share)))
    found = rows.mapInArrow(_find_features(sent, set(names)), "label double, found array<string>")
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="found", outputCol="features").setBinary(True).transform(found)
    fitted = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=60).fit(written(vectors.select("label", "features"), "vectors"))
    return Model(costs, dict(zip(names, fitted.coefficients.toArray().tolist(), strict=True)), float(fitted.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column score between 0 and 1 (replaced if there is one); only the text counts.

    A null or empty text scores as one without telling words. Rows stay as they are, repeated ones and
    columns of any other name too; very long texts are read whole; an empty table stays empty. Letters
    outside Latin-1 are one letter to the language model, so disguises in other scripts stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        find = _finder(model.costs, {f.rstrip("+") for f in model.weights})
        for texts in batches:
            out = []
            for text in texts:
                found = features(x for t in tokens(text or "") for x in find[t])
                odds = model.intercept + sum(sorted(model.weights.get(f, 0.0) for f in found))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            yield pd.Series(out, dtype="float64")

    return docs.drop("score").withColumn("score", scored(F.col(text_col).cast("string")))


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with the columns of ``docs``."""
    model = fit(docs, labels, id_col, text_col)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(text_col).alias("text_to_score"))
    return score(own, model, "text_to_score").filter(F.col("score") < most).select("own.*")
