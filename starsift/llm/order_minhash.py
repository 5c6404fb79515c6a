"""Near-duplicate documents by Order MinHash.

1. Documents of equal text become one text, told apart by two 64-bit hashes, and get a number.
2. A text's k-mers are runs of WORDS words, each labelled with the number of its earlier
   occurrences. SKETCHES times, the PICKED smallest labelled k-mers under another hash function are
   taken and kept in the order of the text; texts whose picks agree, order included, share a bucket.
   Short texts also have a bucket for each way of leaving out as many words as a link may change: two
   texts within that many edits have the rest in common, so no link between short texts is missed.
3. Leaders. Each bucket's smallest text leads it. A text is verified against every text that leads
   two or more of its buckets, so a large group of copies costs each text a few comparisons.
4. What still meets in a bucket from different groups is compared in blocks, by the number of
   sketches that agree (AGREE at least), by lengths and by word counts, which rule out no link. First,
   ROUNDS times, each text of a large bucket is verified against the nearest by agreeing sketches only, which
   joins most of a family at one comparison a text. Then the texts that still have a candidate of another
   group meet with their words, in small blocks. All their pairs are verified where they meet, each at its
   first common sketch, but for groups that were just joined there; only links that join groups leave.
5. Candidates are verified by banded alignment of their words: a link is an edit similarity, 1 minus
   edit distance over the longer length, of at least LEAST. Components of links are the classes.

Words are compared by 32 bits of a hash of their bytes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starsift.llm.components import connected_components
from starsift.storage import scratch, written

#: Words of a k-mer, sketches, k-mers that a sketch picks, and the least similarity of a link. One word
#: in five changed leaves at least 3/5 of the pairs of words, so a sketch agrees with chance 0.18 or more.
WORDS, SKETCHES, PICKED, LEAST = 2, 48, 2, 0.8
#: Sketches in which two texts of LONG words or more agree at least, if they are compared. At a chance
#: of 0.18 for each sketch, one pair in 1200 has fewer.
AGREE, LONG = 2, 20
#: Most words of a short text, whose links are all found.
SHORT = 14
#: Bins of the word counts that rule pairs out, texts of a block, of one whose pairs are aligned, and rows of a small block pair.
BINS, BLOCK, ALIGNED, SMALL = 256, 2048, 128, 32
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20
#: Rounds of nearest pairs in large buckets; a second one joined 16 more pairs of 1600 texts on check data.
ROUNDS = 1
#: What block pairs go by.
KEYS = ["bucket", "low", "high"]
SEED = 20240611

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 2**32, SKETCHES, dtype=np.uint32)
_PLACES = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: White space of ASCII, as str.split() has it; it counts nothing in a hash.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BYTES[_SPACE] = 0
#: Base of the hash of a word's bytes, and its inverse modulo 2 ** 64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, words being set apart as by str.split()."""
    data = np.frombuffer((text if text.isascii() else " ".join(text.split())).encode(), dtype=np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):  # a chunk of whole words, or one longer word
        at = int(starts[k])
        end = max(k + 1, int(np.searchsorted(starts, at + CHUNK)))
        stop = int(starts[end]) if end < len(starts) else len(data)
        size = 1 << max(12, (stop - at - 1).bit_length())
        own = starts[k:end] - at
        sums = np.add.reduceat(_BYTES[data[at:stop]] * _powers(_BASE, size)[: stop - at], own)
        out[k:end] = sums * _powers(_INVERSE, size)[own]
        k = end
    return _mixed(out)


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of WORDS words (of all words where there are fewer), labelled by occurrence."""
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += _mixed(words[j : j + n]) * _PLACES[j]
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    again = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(again):
        label = np.zeros(n, dtype=np.uint64)
        start = np.arange(n)
        start[again] = 0
        label[order] = (np.arange(n) - np.maximum.accumulate(start)).astype(np.uint64)
        out = out + label * np.uint64(0xD6E8FEB86659FD93)
    return _mixed(out)


def sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES bucket numbers of a text with at least one word."""
    grams = kmers(words)
    x = ((grams >> np.uint64(16)).astype(np.uint32) ^ _SHIFTS[:, None]) * _FACTORS[:, None]
    every = np.arange(SKETCHES)
    at = []
    for _ in range(min(PICKED, len(grams))):
        least = x.argmin(axis=1)
        at.append(least)
        x[every, least] = np.iinfo(np.uint32).max
    number = every.astype(np.uint64)
    for places in np.sort(np.stack(at), axis=0):  # in the order of the text
        gram = grams[places]
        number = (number * _MIX) ^ (gram >> np.uint64(7)) ^ (gram << np.uint64(23))
    return number.view(np.int64)


def allowed(n: int, least: float) -> int:
    """Edits that a link allows where the longer text has ``n`` words."""
    return int((1 - least) * n + 1e-9)


@functools.cache
def _left(n: int, out: int) -> np.ndarray:
    """The places that are left of ``n``, a row for each way of leaving ``out`` of them out."""
    return np.array(list(itertools.combinations(range(n), n - out)), dtype=np.int64)


def rests(words: np.ndarray, least: float) -> np.ndarray:
    """Bucket numbers of what is left of a text when it loses up to as many words as a link allows."""
    mixed = _mixed(words)
    found = []
    for out in range(min(allowed(len(words), least), len(words) - 1) + 1):
        kept = mixed[_left(len(words), out)]
        number = np.full(len(kept), SEED + kept.shape[1], dtype=np.uint64)
        for word in kept.T:
            number = _mixed((number ^ word) * _MIX)
        found.append(number)
    return np.unique(np.concatenate(found)).view(np.int64)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Equal ends are cut off; then the band about the diagonal is widened until the distance lies
    within it. The columns of a band are bit vectors of vertical differences, moved along the diagonal.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    n = len(b)
    differ = np.flatnonzero(a[:n] != b)
    first = int(differ[0]) if len(differ) else n
    a, b = a[first:], b[first:]
    differ = np.flatnonzero(a[len(a) - len(b) :] != b)
    last = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
    a, b = a[: len(a) - last].tolist(), b[: len(b) - last].tolist()
    if not b:
        return len(a)
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << k)
    band = max(8, len(a) - len(b))
    while True:
        band = min(band, most, len(a))
        found = _banded(places, len(a), b, band)
        if found <= band or band >= min(most, len(a)):
            return found if found <= band else most + 1
        band *= 4


def _banded(places: dict[int, int], m: int, b: list[int], band: int) -> int:
    """Edit distance within ``band`` of the diagonal; over ``band`` if it isn't there."""
    width = 2 * band + 1
    every = (1 << width) - 1
    top = 1 << (width - 1)
    up = every ^ ((1 << band) - 1)  # rows before the first have no difference
    down = 0
    now = band  # of row ``band`` in the column before the first
    edge = 0
    for j, x in enumerate(b):
        start = j - band
        bits = places.get(x, 0)
        eq = (bits << -start if start < 0 else bits >> start) & every
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & every
        right = (down | ~(diagonal | up)) & every
        left = diagonal & up
        if j + band < m:
            now += not diagonal & top
        else:
            edge += 1
            mark = top >> edge
            now += bool(right & mark) - bool(left & mark)
        moved = diagonal >> 1
        up = (left | ~(moved | right)) & every
        down = moved & right
    return now


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the edit similarity of two sequences is at least ``least``."""
    longest = max(len(a), len(b))
    most = allowed(longest, least)
    if longest - min(len(a), len(b)) > most:
        return False
    kinds, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = np.bincount(places[: len(a)], minlength=len(kinds)), np.bincount(places[len(a) :], minlength=len(kinds))
    if longest - int(np.minimum(*counts).sum()) > most:  # words that the other text lacks
        return False
    return distance(a, b, most) <= most


def _draw(least: float):
    """For distinct texts: number of words, buckets, the words as 32 bits each, compressed, and what rules
    pairs out: 16 bits of each sketch, and the word counts by bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = word_hashes(text)
                buckets = sketches(words) if len(words) else np.empty(0, dtype=np.int64)
                signs = buckets.astype("<u2").tobytes()
                if 0 < len(words) <= SHORT:
                    buckets = np.concatenate([buckets, rests(words, least)])
                words = words >> np.uint64(32)
                counts = np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)
                rows.append((len(words), buckets, pack.compress(words.astype("<u4").tobytes()), signs, counts.tobytes()))
            made = pd.DataFrame(rows, columns=["n", "buckets", "words", "signs", "counts"])
            yield pd.concat([batch.drop(columns="text").reset_index(drop=True), made], axis=1)

    return run


def _sequence(packed: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    return np.frombuffer(data, dtype="<u4").astype(np.int64)


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(_sequence(p), _sequence(q), least) for p, q in zip(batch["words_a"], batch["words_b"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of numbers of ``texts`` whose edit similarity is at least ``least``."""
    needed = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    # The words of these texts alone are written, and then read once for each side.
    words = written(texts.select("rid", "words").join(needed, "rid", "left_semi"), "words")
    first = words.select(F.col("rid").alias("a"), F.col("words").alias("words_a"))
    second = words.select(F.col("rid").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(first, "a").join(second, "b").mapInPandas(_verify(least), "a long, b long")


def _candidates(rows: pd.DataFrame, least: float, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in ``rows``, whole block pairs one after the other, of pairs of different groups that may be links.

    A pair is met at its first common sketch; the third array has the number of sketches that agree. With
    ``nearest`` each text of the smaller side gives only the pair of which most sketches agree.
    """
    if rows.empty:
        return
    rid, group, n, sketch, own, low, high = (rows[c].to_numpy() for c in ("rid", "group", "n", "sketch", "own", "low", "high"))
    signs = np.frombuffer(b"".join(rows["signs"]), dtype="<u2").reshape(-1, SKETCHES)
    counts = np.frombuffer(b"".join(rows["counts"]), dtype=np.uint8).reshape(-1, BINS)
    change = (rows[KEYS].to_numpy()[1:] != rows[KEYS].to_numpy()[:-1]).any(axis=1)
    ends = np.append(np.flatnonzero(change) + 1, len(rows))
    sizes = np.diff(ends, prepend=0)

    def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        end = np.repeat(np.where((sizes > SMALL) | nearest, 0, ends), sizes)
        at = np.arange(len(rows))
        for d in range(1, SMALL):  # of small block pairs together, each row and the d-th after it
            at = at[at + d < end[at]]
            yield at, at + d
        large = (sizes > SMALL) | nearest
        for size, end in zip(sizes[large], ends[large], strict=True):
            every = np.arange(end - size, end)
            one, other = every[own[every] == low[end - 1]], every[own[every] != low[end - 1]]
            if low[end - 1] == high[end - 1]:
                yield from ((every[k : k + 1], every if nearest else every[k + 1 :]) for k in range(size))
            else:
                one, other = (one, other) if len(one) < len(other) else (other, one)
                yield from ((one[k : k + 1], other) for k in range(len(one)))

    for i, j in met():
        good = (group[i] != group[j]) & ((own[i] != own[j]) | (low[i] == high[i]))
        i, j = np.broadcast_to(i, good.shape)[good], np.broadcast_to(j, good.shape)[good]
        most = (1 - least) * np.maximum(n[j], n[i]) + 1e-9
        near = np.abs(n[j] - n[i]) <= most
        i, j, most = i[near], j[near], most[near]
        agree = signs[j] == signs[i]
        times = agree.sum(axis=1)
        if nearest:
            near = np.lexsort((rid[j], -times))[:1]
        else:  # pairs of a bucket that is no sketch, of short texts, may repeat
            near = (times >= np.where(np.minimum(n[j], n[i]) < LONG, 0, AGREE)) & ((sketch[i] < 0) | (agree.argmax(axis=1) == sketch[i]))
        i, j, most, times = i[near], j[near], most[near], times[near]
        over = counts[j].astype(np.int16) - counts[i]
        lost = np.maximum(np.where(over > 0, over, 0).sum(axis=1), np.where(over < 0, -over, 0).sum(axis=1))
        if (lost <= most).any():
            yield i[lost <= most], j[lost <= most], times[lost <= most]


def _whole(made: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What ``made`` gives for batches of rows, whole block pairs at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        # Rows come sorted by block pair; the last pair of a batch may go on in the next one.
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            last = (rows[KEYS] == rows[KEYS].iloc[-1]).all(axis=1).to_numpy()
            yield from made(rows[~last])
            held = rows[last]
        if held is not None:
            yield from made(held)

    return run


def _rule_out(least: float, nearest: bool):
    """Pairs of different groups in a block pair that may be links, see ``_candidates``."""

    def pairs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rid, group = rows["rid"].to_numpy(), rows["group"].to_numpy()
        for i, j, _ in _candidates(rows, least, nearest):
            turned = rid[i] > rid[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            yield pd.DataFrame({"a": rid[i], "b": rid[j], "group_a": group[i], "group_b": group[j]})

    return _whole(pairs)


def _partnered(least: float):
    """The rows (bucket, sketch, rid, group) of a block pair that are in a pair which may be a link."""

    def found(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        has = np.zeros(len(rows), dtype=bool)
        for i, j, _ in _candidates(rows, least, False):
            has[i] = has[j] = True
        yield rows.loc[has, ["bucket", "sketch", "rid", "group"]]

    return _whole(found)


def _aligned(least: float):
    """Links (group_a, group_b) within block pairs whose rows have their words, fewer than there are rows.

    All pairs that may be links are verified, those of which most sketches agree first, but for pairs of groups
    that links of the same rows have joined already.
    """

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        met = list(_candidates(rows, least, False))
        if not met:
            return
        i, j, times = (np.concatenate(x) for x in zip(*met, strict=True))
        group, packed = rows["group"].tolist(), rows["words"].tolist()
        words = functools.lru_cache(4 * ALIGNED)(lambda k: _sequence(packed[k]))
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while x in joined:
                joined[x] = joined.get(joined[x], joined[x])
                x = joined[x]
            return x

        found = []
        for k in np.argsort(-times, kind="stable"):
            a, b = root(group[i[k]]), root(group[j[k]])
            if a != b and similar(words(int(i[k])), words(int(j[k])), least):
                joined[max(a, b)] = min(a, b)
                found.append((a, b))
        if found:
            yield pd.DataFrame(found, columns=["group_a", "group_b"])

    return _whole(links)


def _grouped(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, sketch, rid, group) of texts that share a bucket; ``groups`` has (rid, group) of those in a group of several."""
    return met.select("bucket", "sketch", "rid").join(groups, "rid", "left").withColumn("group", F.coalesce("group", "rid"))


def _block_pairs(grouped: DataFrame, texts: DataFrame, columns: list[str], block: int, over: int = 0) -> DataFrame:
    """The rows of buckets of several groups and more than ``over`` rows, once for each pair of blocks, with ``columns`` of their texts.

    Partitions have whole block pairs, one after the other. The largest group of a bucket is never held against
    itself: its blocks meet those of the rest.
    """
    n = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = grouped.groupBy("bucket", "group").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("group", F.struct("size", "group")).alias("main"), F.max("size").alias("most"), (F.sum("size") - F.max("size")).alias("rest")).filter("rest > 0")
    mixed = mixed.filter(F.col("most") + F.col("rest") > over) if over else mixed
    mixed = mixed.select("bucket", "main", F.ceil(F.col("rest") / block).alias("blocks"), F.ceil(F.col("most") / block).alias("main_blocks"))
    rows = grouped.join(mixed, "bucket").join(texts.select("rid", *columns), "rid")
    draw = F.xxhash64("rid")
    is_main = F.col("group") == F.col("main")
    rows = rows.withColumn("own", F.when(is_main, F.col("blocks") + F.pmod(draw, "main_blocks")).otherwise(F.pmod(draw, "blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1 + F.when(is_main, 0).otherwise(F.col("main_blocks")))))
    rows = rows.select("bucket", "sketch", "rid", "group", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *columns)
    return rows.repartition(n, *KEYS).sortWithinPartitions(*KEYS)


def _nearest_links(met: DataFrame, groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (group_a, group_b) of texts of large buckets with the nearest text of another group, one pair for each row."""
    rows = _block_pairs(_grouped(met, groups), texts, ["n", "signs", "counts"], BLOCK, SMALL)
    pairs = rows.mapInPandas(_rule_out(least, True), "a long, b long, group_a long, group_b long")
    pairs = written(pairs.dropDuplicates(["a", "b"]), "pairs")
    return verified(pairs.select("a", "b"), texts, least).join(pairs, ["a", "b"]).select("group_a", "group_b")


def _all_links(met: DataFrame, groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (group_a, group_b) that join all groups which candidates of different groups link.

    No table of pairs is made: its rows would be as many as the pairs of a family of texts just below ``least``.
    """
    rows = _block_pairs(_grouped(met, groups), texts, ["n", "signs", "counts"], BLOCK)
    found = rows.mapInPandas(_partnered(least), "bucket long, sketch int, rid long, group long")
    found = written(found.dropDuplicates(["bucket", "rid"]), "partnered")
    # The words of these texts alone are written and dealt to block pairs.
    columns = ["n", "signs", "counts", "words"]
    words = written(texts.select("rid", *columns).join(found.select("rid").distinct(), "rid", "left_semi"), "words")
    return _block_pairs(found, words, columns, ALIGNED).mapInPandas(_aligned(least), "group_a long, group_b long")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(rid, group) once ``links`` (group_a, group_b) join groups, or texts that were in none."""
    merged = written(connected_components(links, "group_a", "group_b").toDF("node", "component"), "merged")
    moved = groups.join(merged, F.col("group") == F.col("node"), "left").select("rid", F.coalesce("component", "group").alias("group"))
    alone = merged.join(groups.select("group").distinct(), F.col("node") == F.col("group"), "left_anti").select(F.col("node").alias("rid"), F.col("component").alias("group"))
    return written(moved.unionByName(alone), "groups")


def _key(text: Column) -> list[Column]:
    """Two hashes that tell texts apart, named text_hash and text_check."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("check"), text).alias("text_check")]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def _classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(text_hash, text_check, rid, class_id, n_texts, chosen) of every distinct text of ``docs``.

    ``chosen`` marks the text that stays of a class: of those that have a document ``class_id`` the first.
    The tables of words, buckets and pairs on the way go with the end.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_classed(docs, id_col, text_col, least), "classes")


def _classed(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    text = _text(text_col)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *_key(text))
    # Copies are joined before they are shuffled. The number of a text is written once and then read.
    distinct = own.groupBy("text_hash", "text_check").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text")).withColumn("rid", F.monotonically_increasing_id())
    kind = dict(distinct.dtypes)["first_id"]
    texts = written(distinct.mapInPandas(_draw(least), f"text_hash long, text_check long, first_id {kind}, rid long, n long, buckets array<long>, words binary, signs binary, counts binary"), "texts")

    dealt = texts.select("rid", "n", F.posexplode("buckets").alias("sketch", "bucket")).withColumn("sketch", F.when(F.col("sketch") < SKETCHES, F.col("sketch")).otherwise(-1))
    shared = dealt.groupBy("bucket").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).filter("leader <> last").drop("last")
    met = written(dealt.join(shared, "bucket"), "met")

    # Each text and those that lead its buckets, two at least where a link has as many.
    led = met.filter("rid <> leader").groupBy("leader", "rid").agg(F.count("*").alias("times"), F.min("n").alias("n")).filter((F.col("times") >= AGREE) | (F.col("n") < LONG))
    links = written(verified(led.select(F.col("leader").alias("a"), F.col("rid").alias("b")), texts, least), "links")
    groups = written(connected_components(links).toDF("rid", "group"), "groups")
    # Then what meets in a bucket and is of different groups so far: nearest pairs, at last all pairs.
    for more in [_nearest_links] * ROUNDS + [_all_links]:
        groups = _joined(groups, written(more(met, groups, texts, least).distinct(), "links"))

    # The smallest id of each component.
    labelled = texts.select("text_hash", "text_check", "rid", "first_id").join(groups, "rid", "left").withColumn("group", F.coalesce("group", "rid"))
    best = F.struct(F.col("first_id").isNull().alias("lacks"), F.col("first_id"), F.col("rid"))
    classes = labelled.groupBy("group").agg(F.min(best).alias("best"), F.count("*").alias("n_texts"))
    out = labelled.join(classes, "group")
    return out.select("text_hash", "text_check", "rid", F.col("best.first_id").alias("class_id"), "n_texts", (F.col("rid") == F.col("best.rid")).alias("chosen"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, rid, class_id, n_texts, kept) for every row of ``docs``.

    ``class_id`` is the smallest doc_id of the class, ``n_texts`` the number of different texts of the
    class, ``kept`` marks its rows with that id; ``rid`` is the text's number, another at each run. Rows
    of equal text (null counts as empty) are one class. A text without words is near to no other text;
    texts of fewer than 1 / (1 - least) words are near if their words are equal. A class of rows without
    an id has the id null. Repeated rows share a class; other columns of ``docs`` change nothing,
    whatever their names; very long texts are compared whole; an empty table gives no rows.
    """
    found = _classes(docs, id_col, text_col, least)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_key(_text(text_col)))
    return own.join(found, ["text_hash", "text_check"]).select("doc_id", "rid", "class_id", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of ``docs`` for each class of near copies, with the columns of ``docs`` whatever their names.

    It is a row with the smallest id of the class (rows without an id come last), of rows with that id
    the one whose text was numbered first, of equal ones any. See ``near_duplicates`` for odd rows.
    """
    chosen = _classes(docs, id_col, text_col, least).filter("chosen").select("text_hash", "text_check", "class_id")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{id_col}`").alias("own_id"), *_key(_text(text_col)))
    joined = own.join(chosen, ["text_hash", "text_check"]).filter(F.col("own_id").eqNullSafe(F.col("class_id")))
    return joined.dropDuplicates(["text_hash", "text_check"]).select("own.*")
