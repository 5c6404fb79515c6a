"""Byte-level BPE by a global distinct-word shuffle.

1. Every text is split into pre-tokens. Documents are gathered into blocks (about
   ``BLOCK_CHARS`` code points, all from one task); a block holds each of its words once, and per
   document the positions as places in the block's list of words. This is the exploded (document,
   position, word) table with the repeats of a word inside a block held once and packed.
2. The words are shuffled by hash, so that a word of all blocks meets in one bucket; each distinct
   word is encoded once, and its ids go back to every block that has it.
3. Each block joins its ids, and every document is put together by position. Decoding looks each id
   up in the token-byte table (bounded by the vocabulary).

A word occurs once per block at most, so no bucket grows with the frequency of a word.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of text that a block holds before the next block begins.
BLOCK_CHARS = 24_000_000
#: Code points whose pre-tokens are held as separate strings while a block is built.
CHUNK_CHARS = 1_000_000
#: Distinct words that a task remembers at least.
KNOWN = 1_000_000

#: Where ``re`` splits exactly as the Unicode pattern does: Latin-1 without the few code points
#: whose classes differ (separators 1C-1F and 85, superscript digits, fractions).
_LATIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@functools.lru_cache(maxsize=4)
def _splitter(pattern: str):
    return regex.compile(pattern)


def pretokens(text: str, pattern: str) -> list[str]:
    """The matches of ``pattern`` in ``text``, in order; they cover the text."""
    import public_tokenizers

    if pattern == public_tokenizers.PATTERN and _LATIN.fullmatch(text):
        return _FAST.findall(text)
    return _splitter(pattern).findall(text)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _whole(path: str) -> tiktoken.Encoding:
    """The encoding of a text as one pre-token, whatever is in it."""
    return tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: bytes of all tokens end to end, and where each id begins."""
    ranks = load_ranks(path)
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.frombuffer(b"".join(words), dtype=np.uint8), starts


def _gather(values: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """values[starts[p]:starts[p + 1]] for every p of ``picks``, end to end."""
    lengths = starts[picks + 1] - starts[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    return values[np.repeat(starts[picks] - (ends - lengths), lengths) + np.arange(total)]


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ``ids`` by the token-byte table."""
    values, starts = token_bytes(path)
    return _gather(values, starts, ids.astype(np.int64)).tobytes()


_BLOCKS = "block string, bucket int, doc_id long, n long, data binary"


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes before all second ones; larger numbers are an error."""
    if len(x) and int(x.max()) >> 8 * width:
        raise OverflowError(f"{int(x.max())} takes more than {width} bytes")
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.reshape(-1).view("<u4").astype(np.int64)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _block_rows(block: str, docs: list[tuple[int | None, int]], parts: list[pa.Array], buckets: int) -> Iterator[pa.RecordBatch]:
    """The words of a block with their places, a row per bucket; then a row for each document.

    Places follow frequency, and the alphabet among equals: small numbers and sorted words pack well.
    """
    coded = pa.chunked_array(parts, type=pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    words = coded.chunk(0).dictionary.to_pylist() if coded.num_chunks else []
    index = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks] or [np.zeros(0, np.int32)])
    counts = np.bincount(index, minlength=len(words)).tolist()
    order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    index = place[index]
    names = ["block", "bucket", "doc_id", "n", "data"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    dealt: dict[int, list[tuple[str, int]]] = {}
    for at, k in enumerate(order):
        dealt.setdefault(zlib.crc32(words[k].encode()) % buckets, []).append((words[k], at))
    rows = []
    for bucket, pairs in dealt.items():
        pairs.sort()
        own = [w.encode() for w, _ in pairs]
        data = _planes(np.array([len(w) for w in own]), 4) + _planes(np.array([at for _, at in pairs]), 3) + b"".join(own)
        rows.append((block, bucket, None, len(pairs), _squeeze(data)))
    at = 0
    for doc, n in docs:
        rows.append((block, None, doc, n, _squeeze(_planes(index[at : at + n], 3))))
        at += n
    for k in range(0, len(rows), 2000):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000], strict=True), kinds, strict=True)], names=names)


def _to_blocks(pattern: str, block_chars: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ordinal = TaskContext.get().partitionId(), 0
        docs: list[tuple[int | None, int]] = []
        parts: list[pa.Array] = []
        flat: list[str] = []
        held = chunk = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = pretokens(text, pattern)
                docs.append((doc, len(found)))
                flat += found
                held += len(text)
                chunk += len(text)
                if chunk >= CHUNK_CHARS or held >= block_chars:
                    parts.append(pa.array(flat, pa.string()).dictionary_encode())
                    flat, chunk = [], 0
                if held >= block_chars:
                    yield from _block_rows(f"{part}-{ordinal}", docs, parts, buckets)
                    docs, parts, held, ordinal = [], [], 0, ordinal + 1
        if docs:
            parts.append(pa.array(flat, pa.string()).dictionary_encode())
            yield from _block_rows(f"{part}-{ordinal}", docs, parts, buckets)

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of buckets, without the documents."""
    for batch in batches:
        yield batch.filter(pc.is_valid(batch.column("bucket"))).select(["block", "bucket", "n", "data"])


def _encode_words(path: str):
    """Encode each distinct word of a partition once, and give every block the ids of its words.

    Rows pass one by one; a task remembers KNOWN words, and encodes a word again that it forgot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = _whole(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for block, n, packed in ((b, n, p) for rows in batches for b, n, p in zip(rows.column("block"), rows.column("n").to_pylist(), rows.column("data"), strict=True)):
            data = _unsqueeze(packed.as_py())
            ends = np.cumsum(_numbers(data, n, 4)) + 7 * n
            ids: list[int] = []
            counts = []
            at = 7 * n
            if len(known) > KNOWN:
                known.clear()
            for end in ends.tolist():
                word = data[at:end]
                got = known.get(word)
                if got is None:
                    got = known[word] = encode_word(word.decode())
                ids += got
                counts.append(len(got))
                at = end
            coded = _squeeze(data[4 * n : 7 * n] + _planes(np.array(counts), 3) + _planes(np.array(ids), 3))
            yield pa.record_batch([pa.array([block.as_py()]), pa.array([n], pa.int64()), pa.array([coded], pa.binary())], names=["block", "n", "data"])

    return run


_IDS = "doc_id long, n_tokens long, ids binary"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _assemble(path: str, digest: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        places, counts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, packed in zip(words.column("n").to_pylist(), words.column("data").to_pylist(), strict=True):
            data = _unsqueeze(packed)
            places.append(_numbers(data, n, 3))
            counts.append(_numbers(data[3 * n :], n, 3))
            values.append(_numbers(data[6 * n :], int(counts[-1].sum()), 3))
        place, count, value = np.concatenate(places), np.concatenate(counts), np.concatenate(values)
        if len(place) and len(place) != place.max() + 1:
            raise ValueError("a block lacks words: its documents changed between two readings")
        order = np.argsort(place, kind="stable")
        began = np.cumsum(count) - count
        lengths = count[order]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        value = value[np.repeat(began[order] - starts[:-1], lengths) + np.arange(int(starts[-1]))].astype("<u4")
        doc_ids, totals, ids_out, texts_out = [], [], [], []
        for doc, n, bucket, packed in zip(docs.column("doc_id").to_pylist(), docs.column("n").to_pylist(), docs.column("bucket"), docs.column("data"), strict=True):
            if bucket.is_valid:
                continue
            ids = _gather(value, starts, _numbers(_unsqueeze(packed.as_py()), n, 3))
            doc_ids.append(doc)
            totals.append(len(ids))
            if digest:
                ids_out.append(hashlib.sha256(ids).hexdigest())
                texts_out.append(hashlib.sha256(decode(ids, path)).hexdigest())
            else:
                ids_out.append(ids.tobytes())
        out = [pa.array(doc_ids, pa.int64()), pa.array(totals, pa.int64())]
        if digest:
            return pa.table([*out, pa.array(ids_out, pa.string()), pa.array(texts_out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.table([*out, pa.array(ids_out, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of ``docs``.

    ``ids`` is little-endian unsigned 32-bit. With ``digest`` the ids are decoded at once and the
    digests of ids and bytes are returned in their place. A null or empty text has no ids; a very long
    text is encoded whole, as a block of its own; a block of more than 2 ** 24 distinct words is an error; a repeated
    row or id gives as many rows; other columns of ``docs`` are left out; an empty table gives no
    rows. ``path`` must be readable on every executor (an installed vocabulary file).
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One exchange holds the blocks for both uses: their words and their documents.
    blocks = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_to_blocks(pattern, block_chars, 2 * parts), _BLOCKS)
        .repartition(parts, "block")
    )
    words = blocks.mapInArrow(_word_rows, "block string, bucket int, n long, data binary")
    coded = words.repartition(2 * parts, "bucket").mapInArrow(_encode_words(path), "block string, n long, data binary")
    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(path, digest), _DIGESTS if digest else _IDS)


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of what :func:`encode` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(np.frombuffer(x.as_py(), dtype="<u4"), path).decode("utf-8") for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
