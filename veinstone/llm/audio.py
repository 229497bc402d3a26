"""Audio features of 8-bit mono PCM columns.

Each payload is stored losslessly as a WAV file of unsigned 8-bit samples and read back before use. The chain is a
polyphase resampler (2/3), overlapped log-mel filterbanks and hysteresis energy segmentation. Tensors have the fixed
shape (FRAMES, MELS) with the time span that they cover.

Defined cases: a null text counts as empty; an empty text becomes one padded block; a very long text is processed
whole, in some 30 bytes of memory for each of its bytes, one text at a time; frames of equal energy have no segments;
repeated rows each get their own values, equal for equal payloads; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RATE, UP, DOWN, TAPS = 12000, 2, 3, 16
RATE_OUT = RATE * UP // DOWN
WINDOW, HOP, FFT, MELS, FRAMES = 200, 100, 256, 16, 64
#: A segment opens above HIGH standard deviations of the frame energy and closes below LOW.
HIGH, LOW = 0.5, -0.25
BLOCK = 192


def to_wav(payload: bytes) -> bytes:
    """A canonical 44-byte header, then the samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(stored: bytes) -> bytes:
    """The samples, found by walking the chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(stored):
        kind, n = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if kind == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pad(raw: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of BLOCK."""
    return raw + b" " * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


@cache
def _phases() -> np.ndarray:
    """A windowed-sinc low pass split into UP phases of TAPS coefficients."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hanning(UP * TAPS + 2)[1:-1]
    return (h * UP / h.sum()).reshape(TAPS, UP).T.copy()


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase rational resampling: only the outputs that are kept are computed."""
    n_out = len(x) * UP // DOWN
    padded = np.concatenate([np.zeros(TAPS - 1), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)[:, ::-1]
    out = np.empty(n_out)
    for r in range(UP):  # outputs r, r + UP, ...: their phase and step in the input are fixed
        first = r * DOWN
        mine, taken = out[r::UP], windows[first // UP :: DOWN]
        for k in range(0, len(mine), 1 << 16):  # bounds memory for long rows
            mine[k : k + (1 << 16)] = taken[k : min(k + (1 << 16), len(mine))] @ _phases()[first % UP]
    return out


@cache
def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(60), mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE_OUT / FFT
    up = (bins[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - bins[None]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.copy()


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames by MELS; the last frame is zero-padded, and there is one frame at least."""
    n = max(1, -(-max(0, len(y) - WINDOW) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(y)))])
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
    window, out = np.hanning(WINDOW), np.empty((n, MELS))
    for k in range(0, n, 1024):  # bounds memory for long rows
        spectrum = np.fft.rfft(frames[k : k + 1024] * window, FFT)
        out[k : k + 1024] = np.log(spectrum.real**2 @ _mel_bank() + spectrum.imag**2 @ _mel_bank() + 1e-6)
    return out


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that open above the high energy level and last until it falls below the low one."""
    energy = mel.mean(axis=1)
    level = energy.std()
    if level < 1e-9:
        return []
    z = (energy - energy.mean()) / level
    state = np.where(z > HIGH, 1, np.where(z < LOW, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(z)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def features(samples: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and segments of unsigned 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x))
    return mel, segments(mel)


def tensors(mel: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(start ms, end ms, FRAMES x MELS), the last one padded with the floor value."""
    out = []
    for k in range(0, len(mel), FRAMES):
        part = mel[k : k + FRAMES].astype(np.float32)
        full = np.full((FRAMES, MELS), np.float32(np.log(1e-6)))
        full[: len(part)] = part
        out.append((k * HOP * 1000 // RATE_OUT, ((k + len(part) - 1) * HOP + WINDOW) * 1000 // RATE_OUT, full))
    return out


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def tensor_array(parts: list[np.ndarray]) -> pa.ExtensionArray:
    """An Arrow fixed-shape tensor column."""
    flat = np.concatenate([p.ravel() for p in parts]) if parts else np.empty(0, np.float32)
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), FRAMES * MELS))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))


def audio_tensors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window of FRAMES frames: doc_id, part, start_ms, end_ms, tensor (FRAMES * MELS floats, row-major)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = tensors(features(from_wav(to_wav(pad(raw.as_py()))))[0])
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int32()), pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64()), tensor_array([p[2] for p in some]).storage.cast(pa.list_(pa.float32()))], ["doc_id", "part", "start_ms", "end_ms", "tensor"])

    return _rows(df, id_col, text_col).mapInArrow(run, "doc_id long, part int, start_ms long, end_ms long, tensor array<float>")


def write_tensor_file(table: pa.Table, sink) -> None:
    """Writes an audio_tensors() batch with the Arrow fixed-shape tensor type."""
    import pyarrow.parquet as pq

    flat = table.column("tensor").combine_chunks()
    fixed = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(flat.flatten(), FRAMES * MELS))
    pq.write_table(table.set_column(table.schema.get_field_index("tensor"), "tensor", fixed), sink)


def feature_string(mel: np.ndarray, segs: list[tuple[int, int]]) -> str:
    """Frames, mean and deviation of each band in tenths, then the segments in ms."""
    ms = lambda k: k * HOP * 1000 // RATE_OUT
    tenths = lambda v: " ".join(str(int(round(x * 10))) for x in v)
    return f"frames={len(mel)};mean={tenths(mel.mean(axis=0))};dev={tenths(mel.std(axis=0))};segments={','.join(f'{ms(a)}-{ms(b)}' for a, b in segs)}"


#: Payload bytes in one batch of results.
BATCH_BYTES = 8 << 20
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_spans string, tensor_sha256 string, tensors array<array<float>>"


def audio_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: sizes and digests of the stored file and what is read back, its features, and its
    tensors (FRAMES * MELS floats each, row-major) with the spans in ms that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]

        def made(cols: list[list]) -> pa.RecordBatch:
            plain = [pa.array(c, pa.string() if n.endswith(("sha256", "feature", "spans")) else pa.int64()) for n, c in zip(names, cols[:-1])]
            each = pa.concat_arrays([t.storage for t in cols[-1]]).cast(pa.list_(pa.float32()))
            offsets = np.cumsum([0] + [len(t) for t in cols[-1]]).astype(np.int32)
            return pa.RecordBatch.from_arrays([*plain, pa.ListArray.from_arrays(offsets, each)], names)

        for batch in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_py()
                stored = to_wav(pad(raw))
                back = from_wav(stored)
                mel, segs = features(back)
                parts = tensors(mel)
                fixed = tensor_array([p for *_, p in parts])
                spans = ",".join(f"{a}-{b}" for a, b, _ in parts)
                digest = hashlib.sha256(fixed.storage.flatten().buffers()[1]).hexdigest()
                row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_string(mel, segs), spans, digest, fixed)
                for col, v in zip(cols, row):
                    col.append(v)
                held += len(back)
                if held > BATCH_BYTES:
                    yield made(cols)
                    cols, held = [[] for _ in names], 0
            if cols[0]:
                yield made(cols)

    return _rows(df, id_col, text_col).mapInArrow(run, DIGEST)
