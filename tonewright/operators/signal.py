"""Operators on audio blocks and on onset strength, and matching of notes.

Blocks: (song_id, stem, channel, block_id, t0, sr, samples). Sums and levels are SQL on arrays;
spectra and resampling are numpy by stem.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LAG_WINDOW, TRACK

STEM = ["song_id", "stem"]
PART = 20_000  # points whose runs are matched together


def _sum(samples: str | Column, f) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: 0.5 * (a + b))


def rms(blocks: DataFrame, keys: list[str] = STEM) -> DataFrame:
    """Root mean square, and its level in dB."""
    a = blocks.groupBy(*keys).agg(F.sum(_sum("samples", lambda x: x * x)).alias("s"), F.sum(F.size("samples")).alias("n"))
    r = F.sqrt(F.col("s") / F.col("n"))
    return a.select(*keys, r.alias("rms"), (20 * F.log10(F.greatest(r, F.lit(1e-9)))).alias("db"))


def stem_levels(blocks: DataFrame, seconds: float) -> DataFrame:
    """Level in dB of windows of so many seconds, by the blocks that begin in them."""
    return rms(blocks.withColumn("window", F.floor(F.col("t0") / F.lit(seconds))), [*STEM, "window"])


def louder_than(blocks: DataFrame, db: float) -> DataFrame:
    return blocks.join(rms(blocks).where(F.col("db") >= db).select(*STEM), STEM, "left_semi")


def mixdown(blocks: DataFrame, leave_out: tuple[str, ...] = ("vocals",), peak: float = 0.99) -> DataFrame:
    """The sum of a song's stems but those left out, by block; scaled where its peak is above ``peak``.
    Stems that end early are silent there."""
    # Whole blocks are added up, a stem at a time; no sample is a row.
    add = lambda a, x: F.zip_with(a, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
    listed = blocks.where(~F.col("stem").isin(*leave_out)).groupBy("song_id", "channel", "block_id").agg(F.array_sort(F.collect_list(F.struct("stem", F.col("samples").cast("array<double>").alias("x")))).alias("all"), F.min("t0").alias("t0"), F.min("sr").alias("sr"))
    total = F.aggregate(F.transform("all", lambda e: e["x"]), F.array().cast("array<double>"), add)
    whole = listed.select("song_id", "channel", "block_id", total.alias("samples"), "t0", "sr").where(F.size("samples") > 0)
    top = whole.groupBy("song_id").agg(F.max(F.array_max(F.transform("samples", lambda x: F.abs(x)))).alias("top"))
    gain = F.when(F.col("top") > peak, F.lit(peak) / F.col("top")).otherwise(1.0)
    return whole.join(top, "song_id").withColumn("gain", gain).withColumn("samples", F.transform("samples", lambda x: x * F.col("gain"))).drop("top")


def normalised(blocks: DataFrame) -> DataFrame:
    """Samples less their song's mean over its deviation, as a separator's input; songs without any are left out."""
    sums = blocks.groupBy("song_id").agg((F.sum(_sum("samples", lambda x: x)) / F.sum(F.size("samples"))).alias("_m"))
    centred = blocks.join(sums, "song_id")
    spread = centred.groupBy("song_id").agg(F.sqrt(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))) / (F.sum(F.size("samples")) - 1)).alias("_d"))
    return centred.join(spread, "song_id").withColumn("samples", F.transform("samples", lambda x: (x - F.col("_m")) / F.col("_d"))).drop("_m", "_d")


def wave_peaks(blocks: DataFrame, buckets: int, stride: int = 16) -> DataFrame:
    """Largest size of every ``stride``-th sample in each of so many equal parts of a stem, over all channels."""
    total = blocks.groupBy(*STEM, "channel").agg(F.sum(F.size("samples")).alias("n")).groupBy(*STEM).agg(F.max("n").alias("n"))
    first = Window.partitionBy(*STEM, "channel").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("at", F.coalesce(F.sum(F.size("samples")).over(first), F.lit(0))).withColumn("_i", F.pmod(-F.col("at"), F.lit(stride)).cast("int")).where(F.col("_i") < F.size("samples"))
    # Only the samples that count become rows.
    placed = placed.select(*STEM, "at", "samples", F.explode(F.sequence("_i", F.size("samples") - 1, F.lit(stride))).alias("i")).select(*STEM, (F.col("at") + F.col("i")).alias("at"), F.get("samples", "i").alias("x"))
    return placed.join(total, STEM).groupBy(*STEM, F.floor(F.col("at") * buckets / F.col("n")).alias("bucket")).agg(F.max(F.abs("x")).cast("double").alias("peak"))


def silence_bounds(blocks: DataFrame, top_db: float = 50.0) -> DataFrame:
    """Begin and end, in seconds, of what is less than ``top_db`` below the loudest block; null for silence."""
    level = blocks.groupBy("song_id", "block_id").agg(F.min("t0").alias("t0"), F.max(F.col("t0") + F.size("samples") / F.col("sr")).alias("t1"), F.sqrt(F.sum(_sum("samples", lambda x: x * x)) / F.sum(F.size("samples"))).alias("r"))
    top = F.max("r").over(Window.partitionBy("song_id"))
    loud = (F.col("top") > 0) & (20 * F.log10(F.greatest("r", F.lit(1e-10)) / F.col("top")) > -top_db)
    return level.withColumn("top", top).groupBy("song_id").agg(F.min(F.when(loud, F.col("t0"))).alias("begin"), F.max(F.when(loud, F.col("t1"))).alias("end"))


def z_score(env: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Onset strength less its mean over its deviation, by track."""
    level = env.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_d"))
    return env.join(level, keys).withColumn("v", (F.col("v") - F.col("_m")) / (F.col("_d") + F.lit(1e-9))).drop("_m", "_d")


#: Seconds of a track whose onsets meet their strength in one task.
LAG_PIECE = 20.0


def audio_lag(onsets: DataFrame, env: DataFrame, hop: float, window: float = LAG_WINDOW, step: float = 0.001) -> DataFrame:
    """The lag (positive: notes come later) at which a track's onsets meet the most strength, and that
    mean. env(song_id, track, frame, v), a frame every ``hop`` seconds; between frames strength is a
    straight line, outside of them 0. Pieces of a track give sums for each lag, which add up."""
    n = int(np.floor(2 * window / step + 1e-6)) + 1
    piece = lambda t: F.floor(t / F.lit(LAG_PIECE))
    t = F.col("frame") * F.lit(hop)
    margin = window + 2 * hop
    asked = onsets.select(*TRACK, "t", piece(F.col("t")).alias("piece"))
    near = env.select(*TRACK, "frame", F.col("v").cast("double").alias("v"), F.explode(F.sequence(piece(t - margin), piece(t + margin))).alias("piece"))

    def sums(on: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        if not len(on):
            return pd.DataFrame({"song_id": np.zeros(0, int), "track": np.zeros(0, object), "i": np.zeros(0, int), "s": np.zeros(0), "n": np.zeros(0, int)})
        total = np.zeros(n)
        if len(frames):
            frames = frames.sort_values("frame")
            first, v = int(frames["frame"].iloc[0]), frames["v"].to_numpy()
            for k in range(0, len(on), 256):
                x = (on["t"].to_numpy()[k : k + 256, None] - (-window + np.arange(n) * step)) / hop - first
                total += np.interp(np.where(np.abs(x - np.rint(x)) < 1e-9, np.rint(x), x), np.arange(len(v)), v, left=0.0, right=0.0).sum(0)
        return pd.DataFrame({"song_id": on["song_id"].iloc[0], "track": on["track"].iloc[0], "i": np.arange(n), "s": total, "n": len(on)})

    parts = asked.groupBy(*TRACK, "piece").cogroup(near.groupBy(*TRACK, "piece")).applyInPandas(sums, "song_id long, track string, i int, s double, n long")
    score = parts.groupBy(*TRACK, "i").agg((F.sum("s") / F.sum("n")).alias("score"))
    best = score.groupBy(*TRACK).agg(F.max_by(F.struct("i", "score"), F.struct(F.round("score", 9), -F.col("i"))).alias("b"))
    return best.select(*TRACK, (F.lit(-window) + F.col("b.i") * F.lit(step)).alias("lag"), F.col("b.score").alias("score"))


def greedy(t: np.ndarray, estimated: np.ndarray, ids: np.ndarray, tolerance: float) -> list[tuple[int, int, float]]:
    """(reference id, estimate id, distance) of points sorted by time, kind and id, nearest first, of equals by
    time and id. Points of one kind at one time are a stack, and the nearest two stacks of unlike kinds
    are always neighbours among those left: a heap of neighbours stands for all pairs."""
    first = np.flatnonzero(np.r_[True, (np.diff(t) != 0) | (np.diff(estimated) != 0)]) if len(t) else np.zeros(0, np.int64)
    time, kind, at, end = t[first].tolist(), estimated[first].tolist(), first.tolist(), [*first[1:].tolist(), len(t)]
    n = len(time)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, float, float, int, int]] = []

    def meet(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and kind[a] != kind[b]:
            d = abs(time[a] - time[b])
            if d <= tolerance:
                r, e = (b, a) if kind[a] else (a, b)
                heapq.heappush(heap, (d, time[r], time[e], r, e))

    for k in range(n - 1):
        meet(k, k + 1)
    out = []
    while heap:
        d, _, _, r, e = heapq.heappop(heap)
        many = min(end[r] - at[r], end[e] - at[e])
        if many <= 0:  # one of them is used up
            continue
        out += [(r_id, e_id, d) for r_id, e_id in zip(ids[at[r] : at[r] + many].tolist(), ids[at[e] : at[e] + many].tolist())]
        for k in (r, e):
            at[k] += many
        for k in (r, e):
            if at[k] == end[k]:
                x, y = before[k], after[k]
                if x >= 0:
                    after[x] = y
                if y >= 0:
                    before[y] = x
                meet(x, y)
    return out


def match_notes(reference: DataFrame, estimate: DataFrame, tolerance: float, same_pitch: bool = False) -> DataFrame:
    """Greedy one-to-one pairs (r_id, e_id, d) of onsets at most ``tolerance`` apart, nearest first, of equals by
    time and id. Pairs are never listed: a row stands for a note until it is matched."""
    kind = lambda df, e: df.select(*TRACK, F.col("pitch") if same_pitch else F.lit(0).alias("pitch"), F.col("start_s").alias("t"), F.lit(e).alias("e"), F.col("note_id").alias("id"))
    keys = [*TRACK, "pitch"]
    points = kind(reference, 0).unionByName(kind(estimate, 1)).dropna(subset=[*keys, "t", "id"])
    order = Window.partitionBy(*keys).orderBy("t", "e", "id")
    # Points further apart than the tolerance part runs that are independent: runs that begin in one stretch of PART points are one group.
    apart = F.coalesce(F.col("t") - F.lag("t").over(order) > tolerance, F.lit(True))
    runs = points.withColumns({"_new": apart, "_n": F.row_number().over(order)})
    runs = runs.withColumn("part", F.max(F.when(F.col("_new"), F.floor(F.col("_n") / PART))).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "e", "id"])
        found = greedy(pdf["t"].to_numpy(), pdf["e"].to_numpy(), pdf["id"].to_numpy(), tolerance)
        out = pd.DataFrame(found, columns=["r_id", "e_id", "d"])
        for k, c in enumerate(TRACK):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return runs.select(*keys, "part", "t", "e", "id").groupBy(*keys, "part").applyInPandas(matched, "song_id long, track string, r_id long, e_id long, d double")


def onset_f1(reference: DataFrame, estimate: DataFrame, tolerance: float = 0.05, same_pitch: bool = False) -> DataFrame:
    """Matches over both counts, twice; 1 where both are empty."""
    m = match_notes(reference, estimate, tolerance, same_pitch).groupBy(*TRACK).agg(F.count("*").alias("m"))
    count = lambda df, name: df.groupBy(*TRACK).agg(F.count("*").alias(name))
    both = count(reference, "r").join(count(estimate, "e"), TRACK, "full").join(m, TRACK, "left").na.fill(0, ["r", "e", "m"])
    return both.select(*TRACK, "r", "e", "m", F.when(F.col("r") + F.col("e") > 0, 2 * F.col("m") / (F.col("r") + F.col("e"))).otherwise(1.0).alias("f1"))


def decode_tokens(tokens: DataFrame) -> DataFrame:
    """tokens(clip_id, tokens array<int>) -> notes. Times are 4 to 299 (hundredths from 0), pitches 300 to
    399, velocities from 400; a pitch counts right after a time, a velocity two after one; the three
    lists are then paired in order, without velocities all are 100."""

    listed = F.col("tokens")
    timed = lambda i: F.get(listed, i).between(4, 299)
    on = F.filter(listed, lambda t: t.between(4, 299))
    pitch = F.filter(listed, lambda t, i: t.between(300, 399) & timed(i - 1))
    loud = F.filter(listed, lambda t, i: (t >= 400) & timed(i - 2))
    loud = F.when(F.size(loud) > 0, loud).otherwise(F.array_repeat(F.lit(500), F.size(on)))
    n = F.least(F.size(on), F.size(pitch), F.size(loud))
    cut = lambda a: F.slice(a, F.lit(1), n)
    each = tokens.select("clip_id", F.posexplode(F.arrays_zip(cut(on).alias("on"), cut(pitch).alias("pitch"), cut(loud).alias("loud"))).alias("k", "e"))
    start = (F.col("e.on") - 4) / F.lit(100.0)
    return each.select("clip_id", F.col("k").cast("long").alias("note_id"), (F.col("e.pitch") - 300).cast("int").alias("pitch"), (F.col("e.loud") - 400).cast("int").alias("velocity"), start.alias("start_s"), (start + 0.1).alias("end_s"))


def chunked(blocks: DataFrame, size: int) -> DataFrame:
    """blocks(song_id, stem, channel, block_id, samples, first), ``first`` the place of a block's first sample,
    as chunks of ``size`` samples, the last filled up with zeros: song_id, stem, channel, chunk, samples."""
    k = lambda c: F.floor(c / size)
    n = F.size("samples")
    spread = blocks.where(n > 0).withColumn("chunk", F.explode(F.sequence(k(F.col("first")), k(F.col("first") + n - 1))))
    a = F.greatest(F.col("chunk") * size - F.col("first"), F.lit(0))
    b = F.least((F.col("chunk") + 1) * size - F.col("first"), n)
    part = F.struct((F.col("first") + a).alias("at"), F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("x"))
    listed = spread.groupBy(*STEM, "channel", "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["x"]))
    return listed.select(*STEM, "channel", "chunk", F.concat(whole, F.array_repeat(F.lit(0).cast(blocks.schema["samples"].dataType.elementType), F.lit(size) - F.size(whole))).alias("samples"))


def mel_filters(rate: int, n_fft: int, n_mels: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters at equal steps of the mel scale, of equal area."""
    high = high or rate / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high), n_mels + 2) / 2595) - 1)
    freq = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (freq - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 256, n_mels: int = 64) -> np.ndarray:
    if len(x) < n_fft:
        x = np.pad(x, (0, n_fft - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * np.hanning(n_fft + 1)[:-1]
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.log(np.maximum(power @ mel_filters(rate, n_fft, n_mels).T, 1e-10))


def spectral_share(x: np.ndarray, rate: int, low: float = 5000.0, high: float = 10000.0) -> tuple[float, float]:
    """Share of the power between two frequencies, and flatness (geometric over arithmetic mean)."""
    power = np.abs(np.fft.rfft(x)) ** 2 + 1e-12
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    return float(power[(freq >= low) & (freq < high)].sum() / power.sum()), float(np.exp(np.log(power).mean()) / power.mean())


def resample(x: np.ndarray, old: int, new: int, width: int = 6) -> np.ndarray:
    """Band-limited by a Hann-windowed sinc of ``width`` zero crossings, phase by phase."""
    g = np.gcd(old, new)
    up, down = new // g, old // g
    scale = min(1.0, up / down) * 0.99
    reach = int(np.ceil(width / scale))
    n = int(np.ceil(len(x) * up / down))
    place = np.arange(n) * down / up
    left = np.floor(place).astype(int) - reach
    taps = left[:, None] + np.arange(2 * reach + 2)
    t = (place[:, None] - taps) * scale
    weight = np.sinc(t) * np.where(np.abs(t) < width, np.cos(np.pi * t / (2 * width)) ** 2, 0) * scale
    padded = np.pad(x, (reach + 1, 2 * reach + 3))
    return (padded[taps + reach + 1] * weight).sum(1)


def by_stem(blocks: DataFrame, f, schema: str) -> DataFrame:
    """f(rate, samples) -> rows of dicts, for each stem and channel, with its keys."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_id")
        x = np.concatenate([np.asarray(s, dtype=float) for s in pdf["samples"]])
        out = pd.DataFrame(f(int(pdf["sr"].iloc[0]), x))
        for k, c in enumerate((*STEM, "channel")):
            out.insert(k, c, pdf[c].iloc[0])
        return out

    return blocks.groupBy(*STEM, "channel").applyInPandas(one, f"song_id long, stem string, channel int, {schema}")
