"""Media columns: audio features of 8-bit samples.

Payloads are stored as WAV files (mono, 8-bit) in a binary column. Features are computed from the
stored bytes: polyphase resampling, overlapped log-mel filterbanks, and segments by energy with
hysteresis. Filterbanks are stored as Arrow tensors of one fixed shape (half precision) with the span
of time that each covers.
"""

from __future__ import annotations

import functools
import hashlib
import io
import math
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second as stored, and after resampling.
RATE, TARGET_RATE = 16_000, 12_000
#: Window and step of a frame in samples after resampling (25 and 10 ms), transform length, mel bands.
WINDOW, STEP, FFT, BANDS = 300, 120, 512, 40
#: Frames of a tensor; the last one of a file is filled up with zeros.
FRAMES = 64
SHAPE = (FRAMES, BANDS)
#: Taps of the low-pass filter for each phase.
TAPS = 16
#: A segment begins where energy in dB is over the median by ENTER, and lasts while it is over by STAY.
ENTER, STAY = 0.5, 0.0
#: Frames that are transformed at once, which bounds memory.
AT_ONCE = 4096
PAD = 64
#: Rows whose results a task holds at once.
ROWS = 256


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as the samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


@functools.cache
def _phases(up: int, down: int) -> np.ndarray:
    """The taps of each phase of a windowed-sinc low-pass filter at the lower of both rates."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    taps = np.sinc(t * cut) * cut * np.hamming(n) * up
    return np.ascontiguousarray(taps.reshape(TAPS, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """``x`` at up/down of its rate: each output sample takes the taps of its phase only."""
    taps = _phases(up, down)
    n_out = len(x) * up // down
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(down + TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n_out, np.float32)
    for k in range(up):  # outputs k, k + up, ... have one phase and windows ``down`` apart
        count = len(range(k, n_out, up))
        if count:
            out[k::up] = windows[k * down // up :: down][:count] @ taps[k * down % up]
    return out


@functools.cache
def _mel() -> np.ndarray:
    """Triangles on the mel scale, (bins, bands)."""
    mel = np.linspace(0, 2595 * math.log10(1 + TARGET_RATE / 2 / 700), BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * TARGET_RATE / FFT
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) in natural logs, and each frame's energy in dB; a short end is filled with zeros."""
    frames = max(1, 1 + math.ceil((len(samples) - WINDOW) / STEP))
    padded = np.zeros(WINDOW + (frames - 1) * STEP, np.float32)
    padded[: len(samples)] = samples[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    shape, mel, energy = np.hanning(WINDOW).astype(np.float32), np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, AT_ONCE):
        some = windows[at : at + AT_ONCE]
        energy[at : at + AT_ONCE] = 10 * np.log10(np.einsum("ij,ij->i", some, some) / WINDOW + 1e-8)
        power = np.abs(np.fft.rfft(some * shape, FFT)).astype(np.float32) ** 2
        mel[at : at + AT_ONCE] = np.log(power @ _mel() + 1e-6)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of the runs over the lower threshold that pass the upper one."""
    middle = float(np.median(energy))
    over = np.concatenate([[False], energy > middle + STAY, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1]).reshape(-1, 2)
    if not len(edges):
        return []
    loud = np.concatenate([[0], np.cumsum(energy > middle + ENTER)])
    return [(int(a), int(b)) for a, b in edges[loud[edges[:, 1]] > loud[edges[:, 0]]]]


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """Tensors (n, FRAMES, BANDS), the span in seconds of each, and the spans of the loud segments."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    shared = math.gcd(RATE, TARGET_RATE)
    mel, energy = log_mel(resample(x, TARGET_RATE // shared, RATE // shared))
    n = math.ceil(len(mel) / FRAMES)
    tensors = np.zeros((n * FRAMES, BANDS), np.float16)
    tensors[: len(mel)] = mel
    second = lambda frame: round(frame * STEP / TARGET_RATE, 4)
    spans = [(second(k * FRAMES), second(min(len(mel), (k + 1) * FRAMES))) for k in range(n)]
    return tensors.reshape(n, FRAMES, BANDS), spans, [(second(a), second(b)) for a, b in segments(energy)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text, filled up to a positive multiple of PAD, as WAV.

    A null text is empty (PAD zeros); very long texts are stored whole, each by one task; repeated rows
    stay; other columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                sizes.append(len(data))
                media.append(to_wav(data + bytes(-len(data) % PAD or (0 if data else PAD))))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, tensor_no, start_s, end_s, tensor, loud) for every tensor of :func:`store`'s rows.

    ``tensor`` has FRAMES * BANDS numbers by rows; :func:`as_tensors` makes Arrow tensors of them.
    ``loud`` has the spans of the loud segments that begin within the tensor's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, spans, loud = features(from_wav(stored.as_py()))
                for at in range(0, len(spans), 256):
                    some = spans[at : at + 256]
                    begin = [[{"start_s": a, "end_s": b} for a, b in loud if s <= a < e] for s, e in some]
                    yield pa.record_batch(
                        [
                            pa.array([doc] * len(some), pa.int64()),
                            pa.array(range(at, at + len(some)), pa.int64()),
                            pa.array([s for s, _ in some], pa.float64()),
                            pa.array([e for _, e in some], pa.float64()),
                            pa.array(list(values[at : at + 256].reshape(len(some), -1).astype(np.float32)), pa.list_(pa.float32())),
                            pa.array(begin, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
                        ],
                        names=["doc_id", "tensor_no", "start_s", "end_s", "tensor", "loud"],
                    )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, tensor_no long, start_s double, end_s double, tensor array<float>, loud array<struct<start_s: double, end_s: double>>")


def as_tensors(table: pa.Table) -> pa.Table:
    """``table`` with its tensor column as Arrow tensors of the fixed shape SHAPE."""
    flat = pa.FixedSizeListArray.from_arrays(pa.concat_arrays([c.flatten() for c in table.column("tensor").chunks] or [pa.array([], pa.float32())]), FRAMES * BANDS)
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    return table.set_column(table.schema.get_field_index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, flat))


def pack(values: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """Tensors and their spans as an Arrow stream of one batch, the tensors as ones of the fixed shape SHAPE."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), FRAMES * BANDS)
    columns = [pa.array([s for s, _ in spans], pa.float64()), pa.array([e for _, e in spans], pa.float64())]
    columns.append(pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), SHAPE), flat))
    batch = pa.record_batch(columns, names=["start_s", "end_s", "tensor"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def unpack(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """What :func:`pack` was given."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    values = table.column("tensor").chunk(0).to_numpy_ndarray()
    return values, list(zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist(), strict=True))


def _by_batch(df: DataFrame, find, kinds: str) -> DataFrame:
    """The rows that ``find`` gives for each row of ``df``, which it gets as Python values."""
    schema = [(x.split(" ", 1)[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}.get(x.split(" ", 1)[1], _LOUD)) for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                rows = [find(*row) for row in zip(*(c.to_pylist() for c in some.columns), strict=True)]
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])

    return df.mapInArrow(run, kinds)


_LOUD = pa.list_(pa.list_(pa.float64()))
_KEPT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def described(media: DataFrame) -> DataFrame:
    """For each of :func:`store`'s rows: what its stored bytes hold, its tensors, and its loud segments.

    ``tensors`` is an Arrow stream with the columns start_s, end_s and tensor (see :func:`pack`), ``loud``
    has [start, end] in seconds of each segment. Very long media are described whole, each by one task;
    repeated rows stay; an empty table gives no rows.
    """

    def find(doc, n, stored):
        payload = from_wav(stored)
        values, spans, loud = features(payload)
        of_payload = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]))
        return doc, n, *of_payload, len(stored), hashlib.sha256(stored).hexdigest(), pack(values, spans), loud

    return _by_batch(media.select("doc_id", "n_bytes", "media"), find, f"{_KEPT}, tensors binary, loud array<array<double>>")


def digests(found: DataFrame) -> DataFrame:
    """A row for each of :func:`described`'s rows, its tensors and segments as a digest.

    ``feature`` is tensors:loud segments:loud seconds:digest of tensors, their spans and segments.
    """

    def find(*row):
        *kept, tensors, loud = row
        values, spans = unpack(tensors)
        sha = hashlib.sha256(values.tobytes() + repr((spans, loud)).encode()).hexdigest()
        return *kept, f"{len(values)}:{len(loud)}:{sum(b - a for a, b in loud):.2f}:{sha[:32]}"

    return _by_batch(found, find, f"{_KEPT}, feature string")
