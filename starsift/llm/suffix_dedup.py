"""Removal of byte strings that an earlier document has too, by a distributed merge sort of suffixes.

A byte goes if a string of NEED bytes that covers it also starts in a document with a smaller id. The
suffixes that are sorted are a sample that no match can avoid: of the places of a NEED-byte string, the
one whose GRAM bytes hash least is its anchor, and equal strings have their anchors at the same place
within them. Neighbouring strings share anchors, so there is one suffix for some 17 bytes. Its record
holds the suffix from the anchor on, and the bytes on the left, as far as the strings that it stands for
reach.

1. Documents are packed in chunks of about ``chunk`` bytes, written in buckets by chunk number, so that
   later joins by chunk don't move the texts.
2. Duplicate detection: each chunk sends the distinct hashes of its anchors; the owner of a range of
   hashes answers which of them occur in another document too. All others are settled.
3. Each chunk sorts its other records, equal ones as one with their smallest document, and front-codes
   them: a record has the number of bytes that it shares with the one before and the rest.
4. Sampled splitters cut the sorted runs into ranges, and the pieces of a range meet in one task, where a
   loser tree merges them. It keeps for each run the length of its common prefix with the last string
   put out; where two differ, the longer one comes first without a look at the strings, and where they
   are equal the comparison begins behind the prefix. Bytes known as equal are never compared again.
5. Records that follow each other with a common prefix of GRAM bytes are one group; within it, equal
   strings are found by their bytes and get the smallest document that has them. What isn't the chunk's
   own smallest is sent back, and each chunk marks its bytes.

Hashes choose anchors and settle what is alone; strings are held equal by their bytes only. An anchor
with very many different surroundings (the edge of a passage in a third of all texts) would make a large
group, so beyond HOT records it is split: each of its strings is a record of its own, grouped by all its
bytes, and every chunk has it once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from starsift.storage import new_path, written

NEED, GRAM = 50, 16
#: The id that stands for none: larger than others, so its strings make nothing go.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk and of what is hashed at once; records of a run's rows; records of a group; bytes of a range; ranges at most.

    They bound memory and change no result. ``driver`` keys for each range are sampled at most.
    """

    chunk: int = 12 << 20
    step: int = 1 << 18
    segment: int = 256
    hot: int = 4096
    range: int = 32 << 20
    ranges: int = 20_000
    driver: int = 20


# --- chunks and anchors ----------------------------------------------------------------------------------------------


def _packed(batches: Iterator[pd.DataFrame], sizes: Sizes) -> Iterator[pd.DataFrame]:
    ids: list[int] = []
    lacks: list[bool] = []
    texts: list[bytes] = []
    held = seq = part = 0

    def done() -> pd.DataFrame:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        columns = {"ids": np.array(ids, dtype=np.int64).tobytes(), "lacks": np.array(lacks, dtype=bool).tobytes(), "lengths": lengths.tobytes(), "data": b"".join(texts)}
        return pd.DataFrame({"chunk": [(part << 33) + seq]} | {k: [v] for k, v in columns.items()})

    for batch in batches:
        part = int(batch["part"].iloc[0]) if len(batch) else part
        for rank, lack, text in zip(batch["rank"], batch["lack"], batch["text"], strict=True):
            ids.append(rank)
            lacks.append(lack)
            texts.append(text)
            held += len(text)
            if held >= sizes.chunk:
                yield done()
                ids, lacks, texts, held, seq = [], [], [], 0, seq + 1
    if ids:
        yield done()


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def anchors(data: bytes, ends: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first, last): the strings that start at first to last have the anchor at this place.

    ``ends`` are where documents end. ``step`` places are hashed at once; an anchor's strings that lie
    on both sides of a step are given twice, each time a part of them.
    """
    padded, n, window = data + bytes(2 * NEED), len(data), NEED - GRAM + 1
    low = np.uint64(int(2 * step + NEED).bit_length())  # bits for a place within a step; the hash's others give the order
    places = np.arange(step + window - 1, dtype=np.uint64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for s in range(0, n, step):
        e = min(n, s + step)
        v = np.empty(e - s + window - 1 + 8, dtype=np.uint64)
        for o in range(8):  # the eight bytes from each place on, as numbers
            some = v[o::8]
            some[:] = np.frombuffer(padded, dtype="<u8", count=len(some), offset=s + o)
        v *= _A
        v ^= v >> np.uint64(32)
        h = v[:-8] * _B
        h += v[8:]
        h ^= h >> np.uint64(29)
        h *= _C
        h ^= h >> np.uint64(32)
        least = h >> low
        least <<= low
        least |= places[: len(h)]
        size = 1
        while 2 * size <= window:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < window:
            least = np.minimum(least[: e - s], least[window - size :])
        ok = np.ones(e - s, dtype=bool)
        for nth in range(int(np.searchsorted(ends, s, side="right")), len(ends)):  # strings end within their document
            begins, end = int(ends[nth - 1]) if nth else 0, int(ends[nth])
            if begins >= e:
                break
            ok[max(0, begins - s, end - NEED + 1 - s) : max(0, end - s)] = False
        other = np.empty(e - s + 1, dtype=bool)
        other[0] = other[-1] = True
        np.not_equal(least[1:], least[:-1], out=other[1:-1])
        other[1:-1] |= ok[1:] != ok[:-1]
        first = np.flatnonzero(other[:-1] & ok)
        last = np.flatnonzero(other[1:] & ok)
        at = (least[first] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        for into, values in zip(out, (h[at], at + s, first + s, last + s), strict=True):
            into.append(values)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    return tuple(np.concatenate([np.empty(0, dtype=kind), *some]) for kind, some in zip(kinds, out, strict=True))


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted hashes begins, and the end."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])


# --- duplicate detection ---------------------------------------------------------------------------------------------

#: Surroundings of an anchor from which a chunk counts the different ones; the bit for two documents or more.
_COUNTED, _SEVERAL = 64, 1 << 15


def _detect(batches: Iterator[pd.DataFrame], sizes: Sizes, buckets: int) -> Iterator[pd.DataFrame]:
    """(bucket, chunk, hashes, counts): a chunk's distinct hashes in order, with the number of their records."""
    for batch in batches:
        for chunk, lengths, data in zip(batch["chunk"], batch["lengths"], batch["data"], strict=True):
            ends = np.cumsum(np.frombuffer(lengths, dtype=np.int64))
            h, at, first, last = anchors(data, ends, sizes.step)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            begins = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
            hashes, n = h[order][begins], np.diff(np.append(begins, len(h)))
            row = np.searchsorted(ends, first, side="right")[order]  # in order of the page within a hash
            several = row[begins] != row[begins + n - 1]
            for k in np.flatnonzero(n > _COUNTED).tolist():
                same = order[begins[k] : begins[k] + n[k]]
                n[k] = len({(at[i] - first[i], data[first[i] : last[i] + NEED]) for i in same.tolist()})
            counts = (np.minimum(n, _SEVERAL - 1) | several * _SEVERAL).astype(np.uint16)
            edges = _edges(hashes, buckets)
            some = np.flatnonzero(np.diff(edges)).tolist()
            cut = [(edges[b], edges[b + 1]) for b in some]
            yield pd.DataFrame({"bucket": some, "chunk": chunk, "hashes": [hashes[a:z].tobytes() for a, z in cut], "counts": [counts[a:z].tobytes() for a, z in cut]})


def _settle(batches: Iterator[pd.DataFrame], sizes: Sizes) -> Iterator[pd.DataFrame]:
    """(chunk, bucket, states) of a partition, which has one bucket."""
    rows = [batch for batch in batches if len(batch)]
    if rows:
        yield _states(pd.concat(rows, ignore_index=True), sizes)


def _states(rows: pd.DataFrame, sizes: Sizes) -> pd.DataFrame:
    """For each hash of a bucket 0 if no other document has it, 2 if its group would be large, else 1."""
    hashes = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["hashes"]])
    counts = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in rows["counts"]]).astype(np.int64)
    order = np.argsort(hashes)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
    n = np.diff(np.append(begins, len(hashes)))
    shared = (n > 1) | (np.maximum.reduceat(counts[order], begins) >= _SEVERAL)
    hot = np.add.reduceat(counts[order] % _SEVERAL, begins) > sizes.hot
    states = np.empty(len(hashes), dtype=np.uint8)
    states[order] = np.repeat(shared * (1 + hot), n)
    ends = np.cumsum([len(x) // 8 for x in rows["hashes"]])
    cut = [states[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
    some = [k for k, x in enumerate(cut) if x.any()]
    return pd.DataFrame({"chunk": rows["chunk"].iloc[some].tolist(), "bucket": rows["bucket"].iloc[some].tolist(), "states": [cut[k].tobytes() for k in some]})


# --- records and sorted runs -----------------------------------------------------------------------------------------


_HOT = 255
_BYTE = [bytes([k]) for k in range(256)]


@dataclass
class _Records:
    """The distinct records of a chunk, by number: key (bytes on the left, or HOT, and the bytes), smallest document.

    The arrays are in page order: number, first string's place, last one's place, anchor, document id.
    """

    keys: list[bytes]
    least: np.ndarray
    number: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    doc: np.ndarray


def _records(ids: bytes, lengths: bytes, data: bytes, flags: Iterable | None, sizes: Sizes, buckets: int) -> _Records:
    none = np.empty(0, dtype=np.int64)
    states = {f["bucket"]: np.frombuffer(f["states"], dtype=np.uint8) for f in (() if flags is None else flags)}
    if not states:
        return _Records([], none, none, none, none, none, none)
    ends = np.cumsum(np.frombuffer(lengths, dtype=np.int64))
    h, at, first, last = anchors(data, ends, sizes.step)
    order = np.argsort(h)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    edges = _edges(h[order[begins]], buckets)
    state = np.zeros(len(begins), dtype=np.uint8)
    for b, some in states.items():
        state[edges[b] : edges[b + 1]] = some
    of = np.empty(len(h), dtype=np.uint8)
    of[order] = np.repeat(state, np.diff(np.append(begins, len(h))))
    keep = np.flatnonzero(of)
    state, at, first, last = of[keep], at[keep], first[keep], last[keep]
    # Of a large group each string is a record, whose anchor is its beginning.
    times = np.where(state == 2, last - first + 1, 1)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    hot = np.repeat(state == 2, times)
    at, first, last = (np.repeat(x, times) for x in (at, first, last))
    first = np.where(hot, first + nth, first)
    at, last = np.where(hot, first, at), np.where(hot, first, last)
    doc = np.frombuffer(ids, dtype=np.int64)[np.searchsorted(ends, first, side="right")]
    numbers: dict[bytes, int] = {}
    put, number = numbers.setdefault, []
    for mark, f, z in zip(np.where(hot, _HOT, at - first).tolist(), first.tolist(), (last + NEED).tolist(), strict=True):
        number.append(put(_BYTE[mark] + data[f:z], len(numbers)))
    found = np.array(number, dtype=np.int64)
    least = np.full(len(numbers), NO_ID)
    np.minimum.at(least, found, doc)
    return _Records(list(numbers), least, found, first, last, at, doc)


def _sortable(key: bytes) -> tuple[bytes, bytes]:
    """(what is sorted, the bytes on the left) of a record: the kind of its group and the bytes from the anchor on."""
    return (b"\1" + key[1:], b"") if key[0] == _HOT else (b"\0" + key[1 + key[0] :], key[1 : 1 + key[0]])


def _group_bytes(key: bytes) -> int:
    """Leading bytes that all of a group have."""
    return 1 + (NEED if key[0] else GRAM)


def _common(a: bytes, b: bytes, n: int = 0) -> int:
    """How many leading bytes are equal; the first n are known to be."""
    most = min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


Record = tuple[bytes, bytes, int, int]  # sorted bytes, bytes on the left, number, smallest document


def encode_front(records: list[Record]) -> bytes:
    """Sorted records, each without the bytes that it shares with the one before."""
    n = len(records)
    width = max((len(r[0]) for r in records), default=0)
    table = np.frombuffer(b"".join(r[0].ljust(width, b"\0") for r in records), dtype=np.uint8).reshape(n, width)
    sizes = np.array([len(r[0]) for r in records], dtype=np.int64)
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        differ = table[1:] != table[:-1]
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(sizes[1:], sizes[:-1]))
    cut = shared.tolist()
    heads = [np.array([len(r[1]) for r in records], dtype=np.uint8), np.array([r[2] for r in records], dtype=np.uint32), np.array([r[3] for r in records], dtype=np.int64)]
    rests = [r[0][c:] for r, c in zip(records, cut, strict=True)]
    return b"".join([np.uint32(n).tobytes(), shared.astype(np.uint8).tobytes(), (sizes - shared).astype(np.uint8).tobytes(), *(x.tobytes() for x in heads), *rests, *(r[1] for r in records)])


def decode_front(data: bytes) -> Iterator[tuple[int, Record]]:
    """(bytes shared with the one before, record) of front-coded records; the first shares none."""
    n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    shared, rests, lefts = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=4).reshape(3, n).astype(np.int64).tolist()
    numbers = np.frombuffer(data, dtype=np.uint32, count=n, offset=4 + 3 * n).tolist()
    docs = np.frombuffer(data, dtype=np.int64, count=n, offset=4 + 7 * n).tolist()
    at = 4 + 15 * n
    left_at, key = at + sum(rests), b""
    for same, rest, left, number, doc in zip(shared, rests, lefts, numbers, docs, strict=True):
        key = key[:same] + data[at : at + rest]
        yield same, (key, data[left_at : left_at + left], number, doc)
        at += rest
        left_at += left


def _runs(batches: Iterator[pd.DataFrame], sizes: Sizes, buckets: int) -> Iterator[pd.DataFrame]:
    """(chunk, seq, first, last, n, data): each chunk's sorted run, in segments of front-coded records."""
    for batch in batches:
        for chunk, ids, lengths, data, flags in zip(batch["chunk"], batch["ids"], batch["lengths"], batch["data"], batch["flags"], strict=True):
            found = _records(ids, lengths, data, flags, sizes, buckets)
            run = sorted((*_sortable(key), number, doc) for number, (key, doc) in enumerate(zip(found.keys, found.least.tolist(), strict=True)))
            cut = [run[k : k + sizes.segment] for k in range(0, len(run), sizes.segment)]
            if cut:
                yield pd.DataFrame({"chunk": chunk, "seq": range(len(cut)), "first": [c[0][0] for c in cut], "last": [c[-1][0] for c in cut], "n": [len(c) for c in cut], "data": [encode_front(c) for c in cut]})


def _to_ranges(batches: Iterator[pd.DataFrame], splitters: list[bytes]) -> Iterator[pd.DataFrame]:
    """Segments with their range; one that crosses splitters is cut there."""

    def place(key: bytes) -> int:
        return bisect_right(splitters, key[: _group_bytes(key)])

    for batch in batches:
        rows = []
        for chunk, seq, first, last, data in zip(batch["chunk"], batch["seq"], batch["first"], batch["last"], batch["data"], strict=True):
            a, z = place(first), place(last)
            if a == z:
                rows.append((a, chunk, seq, data))
                continue
            records = [r for _, r in decode_front(data)]
            keys = [r[0][: _group_bytes(r[0])] for r in records]
            bounds = [0, *(bisect_left(keys, splitters[k]) for k in range(a, z)), len(records)]
            rows += [(a + k, chunk, seq, encode_front(records[i:j])) for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if i < j]
        yield pd.DataFrame(rows, columns=["range", "chunk", "seq", "data"])


# --- merging ---------------------------------------------------------------------------------------------------------

Run = tuple[list[int], list[Record]]


def _run(segments: list[bytes]) -> Run:
    """One run from its segments: for each record the bytes shared with the one before, and the record."""
    shared: list[int] = []
    records: list[Record] = []
    for data in segments:
        first = len(records)
        for same, record in decode_front(data):
            shared.append(same)
            records.append(record)
        if first:
            shared[first] = _common(records[first - 1][0], records[first][0])
    return shared, records


def merged(runs: list[Run]) -> Iterator[tuple[int, int, Record]]:
    """(run, bytes shared with the record put out before, record) in order, by a loser tree of common prefixes.

    ``shared[i]`` is how much the run's next record has in common with the record that won against it
    last, which on the way of the last one put out is that record itself; -1 once a run has ended.
    """
    k = len(runs)
    shared = [0 if records else -1 for _, records in runs]
    keys = [records[0][0] if records else b"" for _, records in runs]
    places, ends, loser = [0] * k, [len(records) for _, records in runs], [0] * max(k, 1)

    def beats(i: int, j: int) -> bool:
        """Whether run i comes before run j, where the prefixes are equal; the loser's is then that with the winner."""
        a, b, at = keys[i], keys[j], shared[i]
        at = len(a) if a[at:] == b[at:] else _common(a, b, at)
        if a[at : at + 1] <= b[at : at + 1]:
            shared[j] = at
            return True
        shared[i] = at
        return False

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        first = shared[i] > shared[j] if shared[i] != shared[j] else shared[i] < 0 or beats(i, j)
        winners[node], loser[node] = (i, j) if first else (j, i)
    i = winners[1] if k > 1 else 0
    while k and shared[i] >= 0:
        same, records = runs[i]
        at = places[i]
        yield i, shared[i], records[at]
        places[i] = at = at + 1
        if at < ends[i]:
            mine = shared[i] = same[at]
            keys[i] = records[at][0]
        else:
            mine = shared[i] = -1
        node = (i + k) >> 1
        while node:
            j = loser[node]
            other = shared[j]
            # The longer prefix with what was put out comes first; of equal ones the bytes behind it decide.
            if mine < other or (mine == other and mine >= 0 and not beats(i, j)):
                loser[node], i, mine = i, j, other
            node >>= 1


#: An answer: the record's number, and its anchor's first and last place within the strings.
ANSWER = np.dtype([("number", "<u4"), ("low", "u1"), ("high", "u1")])


def resolve(group: list[tuple[int, Record]]) -> Iterator[tuple[int, int, int, int]]:
    """(run, number, low, high): the strings with the anchor at low to high start in a document before the record's smallest."""
    if len(group) < 2:
        return
    least: dict[tuple[bytes, bytes], int] = {}
    for _, (key, left, _, doc) in group:
        if doc < least.get((key, left), NO_ID + 1):
            least[key, left] = doc
    partly: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
    if len(least) > 1:
        earliest: dict[bytes, int] = {}
        for (key, left), doc in sorted(least.items(), key=lambda x: x[1]):
            whole, high, some = left + key[1:], len(left), []
            for p in range(len(whole) - NEED + 1):
                if earliest.setdefault(whole[p : p + NEED], doc) < doc:
                    if some and some[-1][0] == high - p + 1:
                        some[-1] = (high - p, some[-1][1])
                    else:
                        some.append((high - p, high - p))
            partly[key, left] = some
    for run, (key, left, number, doc) in group:
        if least[key, left] < doc:
            yield run, number, NEED - len(key) + 1, len(left)
        else:
            for low, high in partly.get((key, left), ()):
                yield run, number, low, high


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chunk, data): the answers to each chunk, a row for each range. Rows come sorted by range, chunk and place in the run."""

    def solved(segments: dict[int, list[bytes]]) -> pd.DataFrame:
        chunks, found = list(segments), [[] for _ in segments]
        group: list[tuple[int, Record]] = []
        for run, same, record in merged([_run(x) for x in segments.values()]):
            if same <= GRAM or same < _group_bytes(record[0]):
                if len(group) > 1:
                    for i, *answer in resolve(group):
                        found[i].append(tuple(answer))
                group = []
            group.append((run, record))
        for i, *answer in resolve(group):
            found[i].append(tuple(answer))
        some = [i for i, x in enumerate(found) if x]
        return pd.DataFrame({"chunk": [chunks[i] for i in some], "data": [np.array(found[i], dtype=ANSWER).tobytes() for i in some]})

    now, segments = None, {}
    for batch in batches:
        for where, chunk, data in zip(batch["range"], batch["chunk"], batch["data"], strict=True):
            if where != now:
                if segments:
                    yield solved(segments)
                now, segments = where, {}
            segments.setdefault(chunk, []).append(data)
    if segments:
        yield solved(segments)


# --- marking ---------------------------------------------------------------------------------------------------------


def _marked(found: _Records, answers: Iterable | None) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places where strings begin that go, in page order."""
    gone = found.least[found.number] < found.doc if len(found.number) else np.empty(0, dtype=bool)
    first, last = [found.first[gone]], [found.last[gone]]
    more = np.concatenate([np.empty(0, dtype=ANSWER), *(np.frombuffer(data, dtype=ANSWER) for data in (() if answers is None else answers))])
    more = more[np.argsort(more["number"], kind="stable")]
    # The pieces of a record's smallest document meet the record's answers.
    rest = np.flatnonzero(~gone)
    low = np.searchsorted(more["number"], found.number[rest], side="left")
    times = np.searchsorted(more["number"], found.number[rest], side="right") - low
    piece = np.repeat(rest, times)
    answer = more[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    first.append(np.maximum(found.first[piece], found.at[piece] - answer["high"].astype(np.int64)))
    last.append(np.minimum(found.last[piece], found.at[piece] - answer["low"].astype(np.int64)))
    begins, ends = np.concatenate(first), np.concatenate(last)
    order = np.argsort(begins, kind="stable")
    return begins[order], ends[order]


def _spans(first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of maximal removed stretches; places count from the chunk's beginning."""
    if not len(first):
        return first, first, first
    doc, end = np.searchsorted(ends, first, side="right"), np.maximum.accumulate(last + NEED)
    new = np.concatenate([[True], (first[1:] > end[:-1]) | (doc[1:] != doc[:-1])])
    begins = np.flatnonzero(new)
    return doc[begins], first[begins], end[np.append(begins[1:] - 1, len(first) - 1)]


def _cut(batches: Iterator[pd.DataFrame], sizes: Sizes, buckets: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for ids, lacks, lengths, data, flags, answers in zip(*(batch[c] for c in ("ids", "lacks", "lengths", "data", "flags", "answers")), strict=True):
            found = _records(ids, lengths, data, flags, sizes, buckets)
            n = np.frombuffer(lengths, dtype=np.int64)
            ends = np.cumsum(n)
            spans: dict[int, list[tuple[int, int]]] = {}
            for doc, start, end in zip(*(x.tolist() for x in _spans(*_marked(found, answers), ends)), strict=True):
                spans.setdefault(doc, []).append((start, end))
            rows = []
            for doc, (rank, lack, size, stop) in enumerate(zip(np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(lacks, dtype=bool).tolist(), n.tolist(), ends.tolist(), strict=True)):
                begins, some = stop - size, spans.get(doc, [])
                bounds = [begins, *(x for span in some for x in span), stop]
                kept = b"".join(data[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True))
                rows.append((rank, lack, size, size - len(kept), [{"start": a - begins, "end": z - begins} for a, z in some], kept))
            yield pd.DataFrame(rows, columns=["rank", "lack", "n_bytes", "n_removed", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept) for every row of ``docs``.

    ``spans`` are the maximal removed stretches of the text's UTF-8 bytes, ends exclusive, and ``kept``
    the other bytes, which need not be whole characters. Matches never cross documents. Rows with equal
    ids remove nothing from each other; a row without an id is as one with the largest, and gives nothing
    to others without. A null text counts as empty, and texts below NEED bytes stay whole; very long texts
    are searched whole, each in one chunk. Ids are whole numbers. Other columns change nothing; an empty
    table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be a whole number to tell which document is earlier, not {kind.simpleString()}")
    rank = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.coalesce(rank, F.lit(NO_ID)).alias("rank"), rank.isNull().alias("lack"), text.alias("text"), F.spark_partition_id().alias("part"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # A chunk is one row; the table is laid out by chunk, so that flags and answers come to the texts.
    name, path = f"suffix_chunks_{uuid.uuid4().hex}", new_path(spark, "chunks")
    packed = rows.mapInPandas(partial(_packed, sizes=sizes), "chunk long, ids binary, lacks binary, lengths binary, data binary")
    packed.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(shuffles, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; the files are those of ``path``

    total = chunks.agg(F.sum(F.length("lengths")).alias("n"), F.sum(F.length("data")).alias("bytes")).first()
    buckets = max(shuffles, (total["bytes"] or 0) // (2 * sizes.range))
    hashes = chunks.select("chunk", "lengths", "data").mapInPandas(partial(_detect, sizes=sizes, buckets=buckets), "bucket int, chunk long, hashes binary, counts binary")
    # A partition for each bucket, whose share of the hashes is even.
    states = hashes.repartitionById(buckets, "bucket").mapInPandas(partial(_settle, sizes=sizes), "chunk long, bucket int, states binary")
    flags = written(states, "flags", "zstd").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "states")).alias("flags"))

    sorted_runs = chunks.select("chunk", "ids", "lengths", "data").join(flags, "chunk").mapInPandas(partial(_runs, sizes=sizes, buckets=buckets), "chunk long, seq int, first binary, last binary, n int, data binary")
    runs = written(sorted_runs, "runs", "zstd")
    sums = runs.agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("n")).first()
    ranges = min(sizes.ranges, max(shuffles, (sums["bytes"] or 0) // sizes.range))
    keys = runs.select("first")
    if sums["n"] > ranges * sizes.driver:
        keys = keys.sample(ranges * sizes.driver / sums["n"], seed=1)
    sample = sorted(k[: _group_bytes(k)] for k in (bytes(r[0]) for r in keys.toLocalIterator()))  # bounded by ranges
    splitters = sorted({sample[len(sample) * r // ranges] for r in range(1, ranges)}) if sample else []

    dealt = runs.select("chunk", "seq", "first", "last", "data").mapInPandas(partial(_to_ranges, splitters=splitters), "range int, chunk long, seq int, data binary")
    dealt = dealt.repartitionById(max(1, ranges), "range").sortWithinPartitions("range", "chunk", "seq")
    answers = written(dealt.mapInPandas(_answers, "chunk long, data binary"), "answers", "zstd").groupBy("chunk").agg(F.collect_list("data").alias("answers"))

    known = chunks.join(flags, "chunk", "left").join(answers, "chunk", "left").select("ids", "lacks", "lengths", "data", "flags", "answers")
    out = known.mapInPandas(partial(_cut, sizes=sizes, buckets=buckets), "rank long, lack boolean, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.when(~F.col("lack"), F.col("rank")).cast(kind).alias(id_col), "n_bytes", "n_removed", "spans", "kept")
