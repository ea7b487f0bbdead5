"""Media columns: sound kept as WAV bytes in a binary column, and spectral-peak fingerprints read from it."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

RATE = 8_000
#: Samples of a frame, and from one frame to the next.
FRAME, HOP = 192, 96
#: Peaks kept of a frame, later peaks that each is paired with, and frames between the two at most.
PEAKS, FAN, REACH = 2, 3, 12
#: Frames transformed at once: bounds the memory of a long sound.
FRAMES_AT_ONCE = 8_192


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of the strongest local maxima of each frame's spectrum, by frame, the stronger first."""
    x = np.frombuffer(samples, np.uint8)
    n = (len(x) - FRAME) // HOP + 1 if len(x) >= FRAME else 0
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for a in range(0, n, FRAMES_AT_ONCE):
        b = min(n, a + FRAMES_AT_ONCE)
        part = x[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        spectrum = np.fft.rfft(frames * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mid = power[:, 1:-1]
        mid = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]) & (mid > 1), mid, 0)
        rows = np.arange(b - a)
        found = []
        for _ in range(PEAKS):
            k = mid.argmax(axis=1)
            found.append(np.where(mid[rows, k] > 0, k + 1, 0))
            mid[rows, k] = 0
        grid = np.stack(found, axis=1)
        t, j = np.nonzero(grid)
        times.append(t + a)
        bins.append(grid[t, j])
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(times).astype(np.int32), np.concatenate(bins).astype(np.int32)


def peak_pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each peak with the next FAN peaks of later frames: the first one's frame, and bin, bin and distance in one number."""
    t, code = [], []
    for step in range(1, PEAKS + FAN):
        gap = times[step:] - times[:-step]
        ok = (gap > 0) & (gap <= REACH)
        t.append(times[:-step][ok])
        code.append((bins[:-step][ok] << 16) | (bins[step:][ok] << 8) | gap[ok])
    t, code = np.concatenate(t), np.concatenate(code)
    order = np.lexsort((code, t))
    return t[order], code[order]


def _store(rows):
    for batch in rows:
        data = [(t or "").encode() for t in batch.column("text").to_pylist()]
        media = [to_wav(x.ljust(-(-max(len(x), 1) // FRAME) * FRAME)) for x in data]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, data)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of docs(doc_id, text): the UTF-8 bytes, followed by spaces up to a positive multiple of FRAME, as WAV."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peak_time array<int>, peak_code array<int>"


def _features(rows):
    for batch in rows:
        out = []
        for media in batch.column("media").to_pylist():
            payload = from_wav(media)
            t, code = peak_pairs(*spectral_peaks(payload))
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), t, code))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=[x.split()[0] for x in _FEATURES.split(", ")],
        )


def media_features(media: DataFrame) -> DataFrame:
    """What the media column holds, read with the wave module: sizes, digests, and peak-pair fingerprints as time-coded arrays.

    peak_time[i] is the frame at which the pair peak_code[i] starts.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)


def media_fingerprints(docs: DataFrame) -> DataFrame:
    """Stores every whole text of docs(doc_id, text) as a media column in the shared folder and returns its features, one row for each row.

    peak_time and peak_code are the fingerprint; feature is the SHA-256 of both arrays, written as numbers with commas.
    Null and empty text: 192 spaces. Equal texts have equal values. Repeated rows and rows without doc_id keep a row
    each; an empty table gives none; other columns are left out.
    """
    rows = media_features(stored(media_column(docs.select(F.col("doc_id").cast("long"), "text")), "media"))
    numbers = F.concat_ws(";", F.concat_ws(",", F.col("peak_time").cast("array<string>")), F.concat_ws(",", F.col("peak_code").cast("array<string>")))
    return rows.select(*(c for c in rows.columns if not c.startswith("peak_")), F.sha2(numbers, 256).alias("feature"), F.size("peak_time").alias("n_pairs"), "peak_time", "peak_code")
