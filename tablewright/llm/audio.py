"""Texts as audio: lossless 8-bit samples, and features of what is read back.

encode() stores the UTF-8 bytes of a text, filled with spaces to a positive multiple of
BLOCK, as an unsigned 8-bit mono WAV.  features() walks the RIFF chunks of the stored
bytes and, on the samples found,
1. resamples by UP/DOWN with a polyphase windowed-sinc filter,
2. takes log-mel filterbanks of frames that overlap by half,
3. segments by frame energy with hysteresis: a segment starts at the upper of two
   levels (quantiles of the text's own frames) and ends under the lower one.
The log-mels are stored as fixed-shape Arrow tensors (FRAMES x MELS, int16) with the
time span of each, in one Arrow IPC stream a row.

All arithmetic is on integers that a double holds exactly (integer filter, window,
transform and mel tables, and a logarithm read off the binary exponent), so equal texts
have equal features whatever batch they are computed in.

Defined results: null text counts as empty and is one block of spaces.  Repeated rows
give equal values.  An empty table gives no rows.  Very long texts are one WAV each, worked
on in frames.  Only doc_id and text are looked at, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.session import prepared, table

BLOCK, RATE = 192, 16_000
UP, DOWN, TAPS = 3, 4, 24
HOP = BLOCK * UP // DOWN
FRAME = 2 * HOP
MELS, FRAMES = 20, 16
HOP_MS = 1000 * HOP * DOWN // (UP * RATE)
UPPER, LOWER = 0.6, 0.4


def _tables():
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    taps = np.round(np.sinc(n * cutoff) * cutoff * np.hanning(UP * TAPS) * UP * 256)
    phases = [taps[(p * DOWN) % UP :: UP][::-1] for p in range(UP)]
    window = np.hanning(FRAME + 1)[:FRAME]
    k = np.arange(FRAME // 2 + 1)
    angle = 2 * np.pi * np.outer(np.arange(FRAME), k) / FRAME
    turn = np.round(np.concatenate((np.cos(angle), np.sin(angle)), axis=1) * window[:, None] * 256)
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1) / top * (FRAME // 2)
    bank = np.maximum(0, np.minimum((k[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - k[:, None]) / (edge[2:] - edge[1:-1])))
    bank[np.maximum(1, np.round(edge[1:-1]).astype(int)), np.arange(MELS)] += 1e-3
    return phases, turn, np.ceil(bank * 64)


PHASES, TURN, BANK = _tables()


def level(x: np.ndarray) -> np.ndarray:
    """An integer logarithm: eighths of an octave, from exponent and leading bits."""
    mantissa, exponent = np.frexp(x + 1.0)
    return (exponent * 8 + np.floor((mantissa - 0.5) * 16)).astype(np.int16)


def wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def log_mels(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-mels (frames x MELS), frame energies, and each payload's number of frames.

    Payloads are laid out with two blocks of silence before each, so that one matrix
    product serves many of them and none hears another.
    """
    counts = np.array([len(p) // BLOCK for p in payloads])
    starts = np.cumsum(counts + 2) - counts  # in blocks, after the silence
    x = np.zeros((int(counts.sum()) + 2 * len(counts) + 3) * BLOCK)
    for p, s, c in zip(payloads, starts, counts):
        x[s * BLOCK : (s + c) * BLOCK] = np.frombuffer(p, np.uint8).astype(np.float64) - 128
    blocks = len(x) // BLOCK - 1
    y = np.empty(blocks * HOP)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(TAPS // 2), x)), TAPS)
    for p in range(UP):
        first = p * DOWN // UP
        y[p::UP] = windows[first::DOWN][: len(y[p::UP])] @ PHASES[p]
    y = np.floor(y / 256)
    frames = np.lib.stride_tricks.sliding_window_view(np.concatenate((y, np.zeros(HOP))), FRAME)[::HOP]
    keep = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    mels, energy = np.empty((len(keep), MELS), np.int16), np.empty(len(keep))
    for a in range(0, len(keep), 2048):
        f = np.ascontiguousarray(frames[keep[a : a + 2048]])
        energy[a : a + 2048] = (f * f).sum(axis=1)
        z = np.floor((f @ TURN) / 256)
        half = z.shape[1] // 2
        power = np.floor((z[:, :half] ** 2 + z[:, half:] ** 2) / 64)
        mels[a : a + 2048] = level(np.minimum(power, 2.0**38) @ BANK)
    return mels, energy, counts


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges between reaching the upper level and falling under the lower one."""
    ordered = np.sort(energy)
    hi, lo = ordered[int(UPPER * (len(ordered) - 1))], ordered[int(LOWER * (len(ordered) - 1))]
    mark = np.where(energy >= hi, 1, np.where(energy < lo, -1, 0))
    mark[0] = mark[0] or -1
    held = mark[np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), 0))] == 1
    edges = np.flatnonzero(np.diff(np.concatenate(([False], held, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(mels: np.ndarray) -> bytes:
    """Patches of FRAMES frames as fixed-shape tensors with their time spans, as an Arrow stream."""
    n = -(-len(mels) // FRAMES)
    filled = np.zeros((n * FRAMES, MELS), np.int16)
    filled[: len(mels)] = mels
    first = np.arange(n) * FRAMES
    patches = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, FRAMES, MELS))
    spans = [pa.array((first * HOP_MS).astype(np.int64)), pa.array((np.minimum(first + FRAMES, len(mels)) * HOP_MS).astype(np.int64))]
    batch = pa.RecordBatch.from_arrays([*spans, patches], names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _encode(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            media = [wav(r + b" " * ((-len(r)) % BLOCK or (0 if r else BLOCK))) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


FEATURES = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, segments array<struct<start_ms:long,end_ms:long>>, tensors binary"


def _features(batches):
    span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            payloads = [samples(m) for m in part.column("media").to_pylist()]
            mels, energy, counts = log_mels(payloads)
            ends = np.cumsum(counts)
            own = [(slice(e - c, e)) for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("n_bytes"),
                    part.column("media"),
                    pa.array(list(map(len, payloads)), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                    pa.array([[{"start_ms": s * HOP_MS, "end_ms": e * HOP_MS} for s, e in segments(energy[x])] for x in own], span),
                    pa.array([tensors(mels[x]) for x in own], pa.binary()),
                ],
                names=[x.split()[0] for x in ("doc_id n_bytes media payload_bytes payload_sha256 tail_crc32 segments tensors").split()],
            )


def encode(docs: DataFrame) -> DataFrame:
    prepared(docs.sparkSession)
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return at.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    return media.mapInArrow(_features, FEATURES)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(encode(table(prepared(spark), sf_dir, "documents")))
    digest = F.concat_ws(";", F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("spans="), F.substring(F.sha2(F.to_json("segments"), 256), 1, 16)), F.concat(F.lit("log_mel="), F.sha2("tensors", 256)))
    return f.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), digest.alias("feature"))
