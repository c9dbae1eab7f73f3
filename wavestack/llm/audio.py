"""Audio features as media columns.

Media are WAV bytes (8-bit mono PCM). Features of a recording: it is resampled by a polyphase filter (a
windowed-sinc low-pass split into one short filter per output phase, so only wanted samples are
computed), cut into overlapping windows, and turned into log-mel energies; segments of sound are
found by hysteresis on frame energy (open above one threshold, held until below a lower one). The
energies come as fixed-shape tensors: every tensor holds ``FRAMES`` x ``MELS`` values (the last one padded) and
has the time span it covers, stored as Arrow IPC bytes with the canonical fixed-shape tensor type in a column of the
written table; ``read_tensors`` gives them back.

A recording is worked through in blocks of whole tensors, so memory does not grow with its length
beyond the samples themselves; each block is a function of its own samples and their margin only, hence equal
recordings give equal bytes wherever they are computed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import drop_staged, read_table, stage

RATE, UP, DOWN = 8000, 1, 2
TAPS = 16  # filter half-length, in input samples per phase
WINDOW, HOP = 256, 128  # at the resampled rate: half of each window overlaps the next
MELS, FRAMES = 16, 64
OPEN_DB, CLOSE_DB = -3.0, -6.0  # relative to the recording's mean energy
LEAST_FRAMES = 2


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples; an odd number is padded as the format asks."""
    n, pad = len(samples), len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + n + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + samples + b"\0" * pad


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of such a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def phases(up: int, down: int) -> np.ndarray:
    """(up, 2 * TAPS) filters: row p gives outputs whose place falls p / up past an input sample."""
    cut = 1.0 / max(up, down)
    half = TAPS * max(1, down // up)
    t = np.arange(-half, half)[None, :] - (np.arange(up) / up)[:, None]
    taps = np.sinc(t * cut * up) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
    return (taps / taps.sum(1, keepdims=True)).astype(np.float32)


def resample(signal: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by up / down; ends are padded with silence."""
    bank = phases(up, down)
    half = bank.shape[1] // 2
    n_out = -(-len(signal) * up // down)
    padded = np.zeros(len(signal) + 2 * half + down, dtype=np.float32)
    padded[half : half + len(signal)] = signal
    out = np.empty(n_out, dtype=np.float32)
    for p in range(up):
        # outputs j with (j * down) % up == p share one filter
        first = next((j for j in range(up) if (j * down) % up == p), None)
        if first is None or first >= n_out:
            continue
        at = first * down // up  # input place of the first, then every ``down`` inputs
        count = -(-(n_out - first) // up)
        view = np.lib.stride_tricks.as_strided(padded[at:], (count, bank.shape[1]), (padded.strides[0] * down, padded.strides[0]), writeable=False)
        out[first::up] = np.einsum("ij,j->i", view, bank[p])
    return out


@lru_cache(maxsize=8)
def filterbank(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(periodic Hann window, mel triangles (bins, MELS))."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    return hann.astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel (frames, MELS), energy (frames,)); the last window is padded with silence."""
    hann, mels = filterbank(rate)
    frames = max(1, -(-max(0, len(signal) - WINDOW) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + WINDOW, dtype=np.float32)
    padded[: len(signal)] = signal
    view = np.lib.stride_tricks.as_strided(padded, (frames, WINDOW), (padded.strides[0] * HOP, padded.strides[0]), writeable=False)
    out, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, 512):
        block = view[at : at + 512] * hann
        power = np.abs(np.fft.rfft(block, axis=1)) ** 2
        out[at : at + 512] = np.log(power.astype(np.float32) @ mels + 1e-6)
        energy[at : at + 512] = np.einsum("ij,ij->i", block, block)
    return out, energy


def segments(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB, least: int = LEAST_FRAMES) -> list[tuple[int, int]]:
    """Frame ranges [from, to): opened at ``open_db``, held while at least ``close_db``, both against the mean energy."""
    mean = float(energy.mean()) if len(energy) else 0.0
    if mean <= 0:
        return []
    level = 10 * np.log10(energy / mean + 1e-12)
    held = np.concatenate([[False], level >= close_db, [False]]).astype(np.int8)
    edge = np.diff(held)
    opened = np.concatenate([[0], np.cumsum(level >= open_db)])
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= least and opened[b] > opened[a]]


def tensor_column(values: np.ndarray, rate: int) -> bytes:
    """Arrow IPC stream: start_s, end_s and a FRAMES x MELS tensor per row, zero-padded at the end."""
    n = -(-len(values) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), dtype=np.float32)
    full[: len(values)] = values
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    store = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS)
    first = np.arange(n) * FRAMES
    last = np.minimum(first + FRAMES, len(values)) - 1
    batch = pa.RecordBatch.from_arrays(
        [pa.array(first * HOP / rate), pa.array((last * HOP + WINDOW) / rate), pa.ExtensionArray.from_storage(kind, store)], names=["start_s", "end_s", "log_mel"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(time spans (n, 2) in seconds, tensors (n, FRAMES, MELS)) of a stored column value."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    spans = np.stack([table[c].to_numpy() for c in ("start_s", "end_s")], 1)
    return spans, table["log_mel"].combine_chunks().to_numpy_ndarray() if table.num_rows else np.zeros((0, FRAMES, MELS), np.float32)


def features(media: bytes) -> tuple[int, int, list[tuple[float, float]], bytes]:
    """(rate after resampling, frames, segments in seconds, tensors) of one recording."""
    raw, rate = wav_samples(media)
    signal = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    rate = rate * UP // DOWN
    values, energy = log_mel(resample(signal), rate)
    spans = [(a * HOP / rate, ((b - 1) * HOP + WINDOW) / rate) for a, b in segments(energy)]
    return rate, len(values), spans, tensor_column(values, rate)


def encode_media(docs: DataFrame, text: str = "text", key: str = "doc_id", multiple: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each whole text as a WAV file, without loss.

    Bytes 0 are appended up to a positive multiple of ``multiple``; null counts as empty text. Repeated
    rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, media = [], []
                for value in part.column(1):
                    data = (value.as_py() or "").encode()
                    sizes.append(len(data))
                    media.append(wav_bytes(data + b"\0" * (max(multiple, -(-len(data) // multiple) * multiple) - len(data))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, media binary, rate int, frames int, segments array<struct<start_s:double,end_s:double>>, tensors binary"


def audio_features(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with rate, frames, segments and tensors of each recording.

    Bytes that are not such a recording, null ones included, are an error; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [features(m.as_py()) for m in part.column(2)]
                spans = pa.array([[{"start_s": a, "end_s": b} for a, b in f[2]] for f in found], kind)
                cols = [part.column(0), part.column(1), part.column(2), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), spans, pa.array([f[3] for f in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media", "rate", "frames", "segments", "tensors"])

    return media.mapInArrow(run, _FEATURES)


def mean_energies(stored: DataFrame) -> DataFrame:
    """``stored`` (frames, tensors and any other columns) with its tensors read back: their number and mean log-mel energy."""
    names = stored.columns
    at, length = names.index("tensors"), names.index("frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, mean = [], []
            for value, frames in zip(batch.column(at), batch.column(length).to_pylist(), strict=True):
                _, tensors = read_tensors(value.as_buffer())
                n.append(len(tensors))
                mean.append(float(tensors.reshape(-1, MELS)[:frames].mean(dtype=np.float64)) if frames else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32()), pa.array(mean, pa.float64())], names=[*names, "n_tensors", "mean_energy"])

    return stored.mapInArrow(run, StructType([*stored.schema.fields, StructField("n_tensors", IntegerType()), StructField("mean_energy", DoubleType())]))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a recording and read back; its features stored with their tensors and read back."""
    stored = stage(encode_media(read_table(spark, sf_dir, "documents")), "audio")
    payload = F.expr("substring(media, 45)")
    voiced = F.round(F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["end_s"] - x["start_s"]), 3)
    out = audio_features(stored).withColumn("payload", payload).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "rate", "frames", F.size("segments").alias("n_segments"), voiced.alias("voiced"), "tensors",
    )
    kept = stage(out, "audio-features")
    drop_staged(stored)
    feature = F.concat(
        F.lit("rate="), "rate", F.lit(";frames="), "frames", F.lit(";segments="), "n_segments", F.lit(";voiced="), "voiced",
        F.lit(";tensors="), "n_tensors", F.lit(";mean="), F.round("mean_energy", 4), F.lit(";sha256="), F.sha2("tensors", 256),
    )
    return mean_energies(kept).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
