"""Media columns: bytes stored as 8-bit audio, and features of what is read back.

A payload is kept losslessly as unsigned 8-bit mono PCM in a WAV container.
Features of the stored samples: polyphase resampling by 5/8, overlapped log-mel
filterbanks and hysteresis segmentation of the frame energy.  Log-mel values
are tensors of one fixed shape, (FRAMES, MELS) of int16 in hundredths of a
decibel, each with the time span it covers.

Two tables below a path hold them, both Parquet that Spark writes and reads, so
they can be in any store:

* ``media``: doc_id, n_bytes, media (:func:`store_media`).
* ``features``: a row for a slice of documents (:func:`store_features`), with their
  figures and ``tensors``, an Arrow stream of doc, start, end and tensor, which has
  Arrow's fixed-shape tensor type; doc is the document's place in the slice.
  :func:`read_features` and :func:`read_tensors` give them by document and by tensor.

Long payloads are worked through in runs of BLOCK samples with the context that
filters need, so memory does not follow their length.  Every value is a function
of the payload alone: no operation joins two payloads.

Defined results: a null or empty text is a payload of 64 zero bytes; an empty
table gives an empty result; further input columns are ignored; the tail of
a last tensor is filled with FLOOR.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, ensure_columns, quoted, slices, utf8

RATE = 16_000
UP, DOWN = 5, 8
OUT_RATE = RATE * UP // DOWN
TAPS = 8
FRAME, HOP = 256, 128
MELS, FRAMES = 20, 32
FLOOR = -10_000
PAD = 64
BLOCK = DOWN * HOP * 512  # a multiple of what one hop takes in before resampling
HIGH_DB, LOW_DB = 3.0, -3.0

SLICE = 1 << 20
SPAN = "struct<start:double,end:double>"
FIGURES = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<{SPAN}>, feature string"
TENSORS = "doc_id long, start double, end double, tensor array<short>"
_SLICE = f"documents array<struct<{', '.join(': '.join(f.split(' ', 1)) for f in FIGURES.split(', '))}>>, tensors binary"
_SPAN = pa.struct([("start", pa.float64()), ("end", pa.float64())])
_FIGURES = pa.struct([(n, {"array": pa.list_(_SPAN), "string": pa.string(), "long": pa.int64()}[t.split("<")[0]]) for n, t in (f.split(" ") for f in FIGURES.split(", "))])


def encode_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return r.readframes(r.getnframes())


@lru_cache(1)
def _phases() -> np.ndarray:
    """A windowed-sinc low-pass filter, dealt into UP phases of TAPS taps."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return h.reshape(TAPS, UP).T[:, ::-1].copy()


@lru_cache(1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """Window of a frame, and triangular filters over its spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    freqs = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((freqs - lo) / (mid - lo), (hi - freqs) / (hi - mid)))
    return np.hanning(FRAME + 1)[:-1], bank.T.copy()


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP/DOWN of samples that start with TAPS - 1 samples of context."""
    n_in = len(x) - (TAPS - 1)
    n_out = n_in * UP // DOWN
    seen = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    y = np.empty(n_out)
    for p, h in enumerate(_phases()):
        # outputs n with n * DOWN mod UP == p: every UP-th, from the first such n
        first = next(n for n in range(UP) if n * DOWN % UP == p)
        count = len(range(first, n_out, UP))
        y[first::UP] = seen[first * DOWN // UP :: DOWN][:count] @ h
    return y


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames, in hundredths of a decibel, and the frames' energy in decibels."""
    window, bank = _mel()
    out, energies = [], []
    tail = np.zeros(FRAME - HOP)
    context = np.full(TAPS - 1, 128, np.uint8)
    for at in range(0, len(samples), BLOCK):
        part = samples[at : at + BLOCK]
        y = np.concatenate([tail, resample((np.concatenate([context, part]).astype(np.float64) - 128) / 128)])
        if at + BLOCK >= len(samples):
            y = np.concatenate([y, np.zeros(-len(y) % HOP)])
        context = np.concatenate([context, part])[-(TAPS - 1) :]
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] if len(y) >= FRAME else np.zeros((0, FRAME))
        power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
        mel = np.empty((len(frames), MELS))
        for i in range(0, len(frames), 64):  # products of one shape for all but a last one
            mel[i : i + 64] = power[i : i + 64] @ bank
        out.append(np.maximum(FLOOR, np.rint(1000 * np.log10(mel + 1e-10))).astype(np.int16))
        energies.append(10 * np.log10((frames**2).mean(axis=1) + 1e-10) if len(frames) else np.zeros(0))
        tail = y[len(y) - (FRAME - HOP) :]
    return np.concatenate(out), np.concatenate(energies)


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Spans that start above the median energy plus HIGH_DB and last until it falls below that plus LOW_DB."""
    if not len(energy):
        return []
    level = np.median(energy)
    state = np.where(energy > level + HIGH_DB, 1, np.where(energy < level + LOW_DB, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(last >= 0, state[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return [(round(a * HOP / OUT_RATE, 4), round(b * HOP / OUT_RATE, 4)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def features(media: bytes) -> tuple[dict, np.ndarray, list[tuple[float, float]]]:
    """Figures of stored media, its tensors (number, FRAMES, MELS) and their time spans."""
    payload = decode_wav(media)
    mel, energy = log_mel(np.frombuffer(payload, np.uint8))
    tensors = np.full((-(-len(mel) // FRAMES), FRAMES, MELS), FLOOR, np.int16)
    tensors.reshape(-1, MELS)[: len(mel)] = mel
    at = lambda frame: round(frame * HOP / OUT_RATE, 4)
    times = [(at(i), at(min(i + FRAMES, len(mel)))) for i in range(0, len(mel), FRAMES)]
    spans = segments(energy)
    digest = hashlib.sha256(tensors.tobytes()).hexdigest()[:16]
    mean = ",".join(str(int(v)) for v in np.rint(mel.mean(axis=0)))
    loud = sum(b - a for a, b in spans)
    figures = {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-PAD:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "segments": [{"start": a, "end": b} for a, b in spans],
        "feature": f"logmel{FRAMES}x{MELS}x{len(tensors)}:{digest};segments={len(spans)};loud={loud:.4f};mean={mean}",
    }
    return figures, tensors, times


def store_media(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each text as audio below ``path``."""
    ensure_columns(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                raw = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                media = [encode_wav(x + bytes(-len(x) % PAD or (0 if x else PAD))) for x in raw]
                yield batch_of(schema, batch.column(0).slice(i, j - i), [len(x) for x in raw], media)

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    rows.mapInArrow(work, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(f"{path}/media")


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(f"{path}/media")


def _stream(owner: list[int], times: list[tuple[float, float]], tensors: np.ndarray) -> bytes:
    """Tensors and their spans as an Arrow stream."""
    kind = pa.fixed_shape_tensor(pa.int16(), (FRAMES, MELS))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel()), FRAMES * MELS)
    columns = [pa.array(owner, pa.int32()), pa.array([a for a, _ in times], pa.float64()), pa.array([b for _, b in times], pa.float64()), pa.ExtensionArray.from_storage(kind, storage)]
    batch = pa.RecordBatch.from_arrays(columns, names=["doc", "start", "end", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> pa.Table:
    """doc (place in the slice), start, end and tensor, of Arrow's fixed-shape type, of a stored slice."""
    with pa.ipc.open_stream(stream) as source:
        return source.read_all()


def store_features(media: DataFrame, path: str) -> None:
    """Compute the features of stored media (doc_id, n_bytes, media) and write them below ``path``."""
    ensure_columns(media, "doc_id", "n_bytes", "media")
    schema = pa.schema([("documents", pa.list_(_FIGURES)), ("tensors", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_bytes, stored = batch.column(0), batch.column(1), batch.column(2)
            _, offsets = utf8(stored)
            for i, j in slices(offsets, SLICE):
                rows, owner, times, tensors = [], [], [], []
                for k in range(i, j):
                    figures, values, spans = features(stored[k].as_py())
                    rows.append({"doc_id": ids[k].as_py(), "n_bytes": n_bytes[k].as_py()} | figures)
                    owner += [k - i] * len(spans)
                    times += spans
                    tensors.append(values)
                yield batch_of(schema, [rows], [_stream(owner, times, np.concatenate(tensors))])

    rows = media.select("doc_id", "n_bytes", "media").mapInArrow(work, _SLICE)
    rows.write.option("compression", "zstd").parquet(f"{path}/features")


def _slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SLICE).parquet(f"{path}/features")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The stored figures, a row for each document: see FIGURES."""
    return _slices(spark, path).select(F.explode("documents").alias("d")).select("d.*")


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """The stored tensors, a row for each, with its document and time span: see TENSORS."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("tensor", pa.list_(pa.int16()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, stream in zip(batch.column(0), batch.column(1), strict=True):
                table = tensors_of(stream.as_py()).combine_chunks()
                for part in table.to_batches(max_chunksize=4096):
                    values = part.column("tensor").storage.cast(pa.list_(pa.int16()))
                    yield pa.RecordBatch.from_arrays([ids.values.take(part.column("doc")), part.column("start"), part.column("end"), values], schema=schema)

    return _slices(spark, path).select(F.col("documents.doc_id").alias("ids"), "tensors").mapInArrow(work, TENSORS)


def media_features(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store texts as audio below ``path``, read them back, store their features and give the stored figures: see FIGURES."""
    spark = docs.sparkSession
    store_media(docs, path, id_col=id_col, text_col=text_col)
    store_features(read_media(spark, path), path)
    return read_features(spark, path)
