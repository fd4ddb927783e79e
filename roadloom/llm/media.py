"""Media columns: WAV samples, short-time Fourier transforms, and spectral-peak pair fingerprints.

A payload (bytes, padded with zeros to a positive multiple of 64) is stored losslessly as an unsigned 8-bit mono
WAV by the wave module and read back by it. Frames of FRAME samples start every HOP samples, so that they overlap
and each sample beyond the first tenth of a frame is near the middle of some; they are windowed and transformed. A
*peak* is a bin that is the largest of its band in the frame and above the frame's mean; each peak is paired with
the peaks of the bands in reach in its own frame and in those that start 1 to FAN whole frame lengths later, and a
pair's hash packs both frequencies and their distance in frame lengths. The fingerprint is the array of (time code,
hash), where the time code is the frame of the first peak. As frames overlap, a passage shares most of its hashes
with a copy of it that stands at another offset.

Defined results: a null text counts as empty, and an empty payload is 64 zero bytes; equal payloads have equal
results; frames that reach beyond the end are filled with zeros; long payloads are transformed in blocks of
BLOCK_FRAMES frames, so memory stays bounded, with no change at the seams; repeated rows are each stored; an empty
table gives no rows; columns of `docs` named as a result are replaced by it, all others stay untouched.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, session

UNIT, RATE = 64, 8000
FRAME, HOP, FAN, BLOCK_FRAMES = 1024, 128, 2, 512
#: Band edges in bins; one peak a band and frame.
BANDS = (4, 24, 64, 160, 512)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def spectra(samples: np.ndarray):
    """Magnitudes (frames x bins) of 8-bit samples, a block of frames at a time."""
    frames = max(1, -(-len(samples) // HOP))
    for lo in range(0, frames, BLOCK_FRAMES):
        hi = min(frames, lo + BLOCK_FRAMES)
        part = samples[lo * HOP : (hi - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (hi - lo - 1) * HOP + FRAME - len(part)))
        view = np.lib.stride_tricks.as_strided(part, (hi - lo, FRAME), (HOP * 4, 4))
        yield np.abs(np.fft.rfft(view * _WINDOW, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, present), frames x bands: the loudest bin of each band where it is above the frame's mean."""
    bins, present = [], []
    for m in spectra(samples):
        mean = m[:, BANDS[0] : BANDS[-1]].mean(axis=1)
        cols, ok = [], []
        for a, b in zip(BANDS, BANDS[1:], strict=False):
            k = m[:, a:b].argmax(axis=1)
            cols.append(k + a)
            ok.append(m[np.arange(len(m)), k + a] > mean + 1e-3)
        bins.append(np.stack(cols, axis=1))
        present.append(np.stack(ok, axis=1))
    return np.concatenate(bins), np.concatenate(present)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time codes, hashes) of all pairs of peaks in neighbouring bands 0 to FAN frame lengths apart, by time, then hash."""
    b, p = peaks(samples)
    times, hashes = [], []
    bands = b.shape[1]
    for far in range(FAN + 1):
        gap = far * (FRAME // HOP)
        if gap >= len(b):
            break
        for i in range(bands):
            for j in (range(i + 1, bands) if far == 0 else range(max(0, i - 1), min(bands, i + 2))):
                t = np.flatnonzero(p[: len(b) - gap, i] & p[gap:, j])
                times.append(t)
                hashes.append(b[t, i].astype(np.int64) << 20 | b[t + gap, j] << 8 | far)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order]


def summary(times: np.ndarray, hashes: np.ndarray) -> str:
    """A similarity-preserving digest of a fingerprint: landmarks, then the 64 majority bits of their hashes."""
    if not len(hashes):
        return "0:" + "0" * 16
    x = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) * 2 > len(x)
    return f"{len(x)}:{np.packbits(bits).tobytes().hex()}"


_STORED = "n_bytes long, fingerprint array<struct<time:int,hash:long>>, media binary"
_DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_PAIR = pa.struct([("time", pa.int32()), ("hash", pa.int64())])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def store(docs: DataFrame) -> DataFrame:
    """All columns of `docs` with the stored text's record: n_bytes, digests, fingerprint and the WAV as media.

    The digests are taken from the media and fingerprint columns, the payload being read back from the WAV.
    """
    session(docs)

    @F.arrow_udf(_STORED)
    def stored(text: pa.Array) -> pa.Array:
        sizes, ends, times, hashes, wavs = [], [0], [], [], []
        for t in text:
            data = (t.as_py() or "").encode()
            wavs.append(to_wav(pad(data)))
            at, h = fingerprint(np.frombuffer(from_wav(wavs[-1]), np.uint8))
            sizes.append(len(data))
            ends.append(ends[-1] + len(h))
            times.append(at.astype(np.int32))
            hashes.append(h)
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *times])), pa.array(np.concatenate([np.zeros(0, np.int64), *hashes]))], fields=list(_PAIR))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(wavs, pa.binary())], names=_names(_STORED))

    @F.arrow_udf(_DIGESTS)
    def digests(media: pa.Array, pairs: pa.Array) -> pa.Array:
        out, flat, ends = [], pairs.flatten(), np.cumsum([0, *pairs.value_lengths().to_pylist()])
        times, hashes = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("time", "hash"))
        for m, a, b in zip(media, ends, ends[1:], strict=False):
            wav = m.as_py()
            payload = from_wav(wav)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), summary(times[a:b], hashes[a:b])))
        kinds = [pa.string() if x.endswith(" string") else pa.int64() for x in _DIGESTS.split(", ")]
        cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_names(_DIGESTS))

    out = attach(docs, stored(docs["text"]), _names(_STORED))
    out = attach(out, digests(out["media"], out["fingerprint"]), _names(_DIGESTS))
    mine = ["n_bytes", *_names(_DIGESTS), "fingerprint", "media"]
    return out.select(*(F.col(f"`{c}`") for c in out.columns if c not in mine), *mine)


def query(spark, sf_dir: str) -> DataFrame:
    """The digests and the fingerprint; the WAV is made, stored as a column and digested, and left out of the result."""
    return store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "media")
