"""WAV files: a codec, and audio as blocks of samples.

A block row holds a channel's samples from t0 on; never one row a sample.
"""

from __future__ import annotations

import io
import struct
import wave

import numpy as np

BLOCKS = "path string, channel int, block_id long, t0 double, sr int, samples array<float>"
BLOCK = 4096


def decode(data: bytes, start: float = 0.0, seconds: float | None = None) -> tuple[int, np.ndarray]:
    """(samples a second, samples x channels in -1 to 1) of 8, 16, 24 or 32 bit PCM; of a section, nothing
    outside it is decoded."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
        a = min(max(int(start * rate), 0), n)
        w.setpos(a)
        raw = w.readframes(n - a if seconds is None else min(n - a, int(seconds * rate)))
    return rate, samples(raw, width).reshape(-1, channels)


def samples(raw: bytes, width: int) -> np.ndarray:
    """-1 to 1 from little-endian PCM of so many bytes a sample; of one byte without sign."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    return np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)


def encode(rate: int, x: np.ndarray) -> bytes:
    """16-bit PCM: cut to -1 to 1, negative samples scaled by 32768, others by 32767."""
    x = np.clip(np.atleast_2d(x.T).T, -1, 1)
    pcm = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
    channels = x.shape[1]
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(pcm), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(pcm))
    return head + pcm


def duration(data: bytes) -> float | None:
    """Seconds from the header; None where it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def read_blocks(spark, path: str, start: float = 0.0, seconds: float | None = None):
    """Blocks of all files under a path, of a section if asked for: what lies outside is never decoded
    into rows. Times are those of the file."""
    import pandas as pd

    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def blocks(frames):
        for frame in frames:
            out = []
            for p, data in zip(frame["path"], frame["content"]):
                rate, x = decode(bytes(data), start, seconds)
                a = int(start * rate)
                for channel in range(x.shape[1]):
                    out += [(p, channel, k // BLOCK, (a + k) / rate, rate, x[k : k + BLOCK, channel].tolist()) for k in range(0, len(x), BLOCK)]
            yield pd.DataFrame(out, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(blocks, BLOCKS)


def to_files(blocks):
    """blocks(song_id, stem, channel, block_id, sr, samples) -> (song_id, stem, wav binary): a file for each
    stem, its channels side by side."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.concatenate([np.asarray(s, np.float32) for s in g.sort_values("block_id")["samples"]]) for _, g in pdf.groupby("channel")]
        n = min(map(len, parts))
        data = encode(int(pdf["sr"].iloc[0]), np.stack([p[:n] for p in parts], 1))
        return pd.DataFrame({"song_id": [pdf["song_id"].iloc[0]], "stem": [pdf["stem"].iloc[0]], "wav": [data]})

    return blocks.groupBy("song_id", "stem").applyInPandas(one, "song_id long, stem string, wav binary")
