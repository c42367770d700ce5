"""Operator 8: media columns: text stored as WAV, read back, and fingerprinted by its spectrum.

The samples that the wave module reads back go through short-time Fourier transforms (Hann
window).  In each frame the strongest bin of each of four bands is a peak if no frame within two
steps has a stronger one in that band; each peak is paired with the next ones within reach, and a
pair is stored as a time code and a hash of both frequencies and the time between.

Defined results: a null text is empty; its payload is 64 zero bytes.  Equal texts give equal
values.  A spectrum without any strength has no peaks.  Of bands or frames that tie the first is
taken.  Rows that repeat, also a doc_id, keep a row each; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
BANDS = ((2, 16), (16, 40), (40, 76), (76, 129))
FAN, REACH = 3, 24
SKETCH = 16
FRAMES_AT_ONCE = 4096


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and frequency bin of each spectral peak, by frame, then frequency."""
    x = samples.astype(np.float32) - np.float32(128)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best, level = [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        found = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * window, axis=1)
        power = found.real**2 + found.imag**2
        top = np.stack([power[:, a:b].argmax(1) + a for a, b in BANDS], 1)
        best.append(top)
        level.append(np.take_along_axis(power, top, 1))
    top, strength = np.concatenate(best), np.concatenate(level)
    keep = strength > 0
    for d in (1, 2):
        keep[d:] &= strength[d:] > strength[:-d]
        keep[:-d] &= strength[:-d] >= strength[d:]
    time, band = np.nonzero(keep)
    return time, top[time, band]


def pairs(time: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and hashes of peak pairs."""
    times, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, FAN + 1):
        gap = time[step:] - time[:-step]
        near = np.flatnonzero(gap <= REACH)
        times.append(time[near])
        hashes.append(frequency[near] << 13 | frequency[near + step] << 5 | gap[near])
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("times", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int32())), ("media", pa.binary()),
    ]
)
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "times array<int>, hashes array<int>, media binary"
)


def fingerprint_media(docs: DataFrame, *, keep_media: bool = True) -> DataFrame:
    """Digests and features of each text as WAV, the time-coded pair arrays (times, hashes) and, with
    ``keep_media``, the WAV bytes (media)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw = (text or "").encode()
                    media = to_wav(payload_of(raw))
                    back = from_wav(media)
                    time, frequency = peaks(np.frombuffer(back, np.uint8))
                    times, hashes = pairs(time, frequency)
                    least = np.unique(hashes)
                    spread = np.sort((least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))[:SKETCH]
                    feature = f"{len(time)}:{len(times)}:" + ",".join(f"{x:08x}" for x in spread.tolist())
                    rows.append(
                        [
                            doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                            times.astype(np.int32), hashes.astype(np.int32), media if keep_media else None,
                        ]
                    )
                yield record_batch(_OUT, *map(list, zip(*rows)))

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)
    return out if keep_media else out.drop("media")
