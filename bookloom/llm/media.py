"""Media columns: texts stored losslessly as WAV, and spectral-peak fingerprints of what the WAV holds.

A text's UTF-8 bytes, filled up with blanks to whole frames, become the 8-bit samples of a mono WAV written by the
wave module. The stored form is read back, a short-time Fourier transform is taken over frames of FRAME samples every
HOP samples, each frame keeps its strongest bins, and peaks of neighbouring frames are paired into codes. One pass
over the rows, no shuffle; a long text is transformed in steps of STEP frames.

Defined cases: a null or empty text is one frame of blanks; equal texts give equal values, as of bins of equal power
the lower one is taken; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import small_batches

UNIT = 192
RATE = 8000
FRAME, HOP = 192, 96
PEAKS, REACH = 3, 2
STEP = 4096
FILL = 32


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def stored(text: bytes) -> bytes:
    """The WAV of a text."""
    return to_wav(text + bytes([FILL]) * (-len(text) % UNIT if text else UNIT))


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def spectral_peaks(samples: np.ndarray) -> np.ndarray:
    """The PEAKS strongest bins of each frame, the lower one of equals, in order of frequency: an array of frames x PEAKS."""
    shape = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    found = np.empty((len(shape), PEAKS), np.int32)
    for at in range(0, len(shape), STEP):
        part = shape[at : at + STEP].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(part * window, axis=1)
        power = np.square(spectrum.real) + np.square(spectrum.imag)
        power[:, 0] = -1
        each = np.arange(len(power))
        for k in range(PEAKS):
            best = power.argmax(axis=1)
            found[at : at + STEP, k] = best
            power[each, best] = -2
    return np.sort(found, axis=1)


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame of the first peak) and codes (first bin, second bin, distance) of pairs over 1 to REACH frames."""
    times, codes = [], []
    for gap in range(1, REACH + 1):
        if len(peaks) > gap:
            a, b = peaks[:-gap], peaks[gap:]
            code = (a[:, :, None] << 10 | b[:, None, :] << 2 | gap).reshape(len(a), -1)
            times.append(np.repeat(np.arange(len(a), dtype=np.int32), code.shape[1]))
            codes.append(code.ravel().astype(np.int32))
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(t, kind="stable")
    return t[order], c[order]


def fingerprint(media: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What the stored form holds: the payload, and times and codes of its peak pairs."""
    payload = from_wav(media)
    return payload, *peak_pairs(spectral_peaks(np.frombuffer(payload, np.uint8)))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (the WAV file), one row per row."""
    small_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [t.as_py() for t in part.column(1)]
                media = [stored(t) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, media binary")


def media_fingerprints(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored bytes back: id_col, n_bytes, media, payload, times array<int>, codes array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [fingerprint(m.as_py()) for m in part.column(2)]
                ends = np.cumsum([0] + [len(f[1]) for f in found], dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[k] for f in found]))) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.binary()), *lists], [id_col, "n_bytes", "media", "payload", "times", "codes"])

    rows = media.select(id_col, "n_bytes", "media")
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What store_media and media_fingerprints give, the media as digests and the fingerprint as times and codes: one pass, in which no file leaves its task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"))
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def digested(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out, found = [], []
        for value in texts:
            text = value.as_py()
            media = stored(text)
            payload, times, codes = fingerprint(media)
            code = hashlib.md5(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
            out.append((len(text), len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), f"{len(codes)}:{len(np.unique(codes))}:{code}"))
            found.append((times, codes))
        ends = pa.array(np.cumsum([0] + [len(t) for t, _ in found], dtype=np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out), types)), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield digested(part.column(0), part.column(1))

    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    return rows.mapInArrow(run, f"`{id_col}` {rows.dtypes[0][1]}, {kinds}")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
