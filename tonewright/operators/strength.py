"""Onset strength, tempo and silence from audio blocks; no task sees a whole stem.

Blocks: (song_id, stem, channel, block_id, t0, sr, samples). A stem's frames are cut into pieces of
PIECE frames; every block sends each piece the samples that it needs, the margins that neighbouring
frames share included, so a piece is worked on by itself, in numpy, and what spans pieces (the
loudest level, sums over frames) is an aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_BPM, MIN_BPM, TEMPO_PRIOR
from . import grid, tempo
from .signal import STEM, mel_filters

PIECE = 4096  # frames of a piece


def hop_of(sr: Column | int, seconds: float = 0.003):
    """Samples from one frame to the next, the whole number nearest to ``seconds``."""
    if isinstance(sr, int):
        return max(1, round(sr * seconds))
    return F.greatest(F.lit(1), F.rint(sr * F.lit(seconds)).cast("int"))


def mono_blocks(blocks: DataFrame) -> DataFrame:
    """Mean of the channels of each block."""
    add = lambda a, x: F.zip_with(a, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
    listed = blocks.groupBy(*STEM, "block_id", "t0", "sr").agg(F.collect_list(F.col("samples").cast("array<double>")).alias("_all"))
    total = F.aggregate("_all", F.array().cast("array<double>"), add)
    return listed.select(*STEM, "block_id", "t0", "sr", F.transform(total, lambda x: x / F.size("_all")).alias("samples"))


def pieces(blocks: DataFrame, hop: Column, before: Column, after: int, size: int = PIECE) -> DataFrame:
    """For each piece of ``size`` frames the samples from ``before`` ahead of its first frame to ``after`` past
    its last one: song_id, stem, piece, channel, sr, hop, at (place of the first sample), samples."""
    placed = blocks.where(F.size("samples") > 0).withColumns({"hop": hop, "_first": F.rint(F.col("t0") * F.col("sr")).cast("long")}).withColumn("_end", F.expr("_first + size(samples)"))
    low = F.floor((F.col("_first") - after) / F.col("hop") / size) - 1
    high = F.floor((F.col("_end") + before) / F.col("hop") / size) + 1
    spread = placed.withColumn("piece", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))))
    spread = spread.withColumns({"_a": F.greatest(F.col("piece") * size * F.col("hop") - before, F.col("_first")), "_b": F.least(((F.col("piece") + 1) * size - 1) * F.col("hop") + after, F.col("_end"))}).where("_a < _b")
    part = F.slice("samples", (F.col("_a") - F.col("_first") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int"))
    return spread.select(*STEM, "piece", "channel", "sr", "hop", F.col("_a").alias("at"), part.alias("samples"))


def _line(pdf: pd.DataFrame, begin: int, n: int) -> tuple[np.ndarray, int]:
    """(the mean of all channels from sample ``begin`` on, where the sound ends)."""
    x = np.zeros(n)
    for at, samples in zip(pdf["at"], pdf["samples"]):
        x[at - begin : at - begin + len(samples)] += samples
    return x / pdf["channel"].nunique(), int(max(a + len(s) for a, s in zip(pdf["at"], pdf["samples"])))


def _mel(pdf: pd.DataFrame, n_fft: int, n_mels: int, size: int) -> tuple[np.ndarray, int, int]:
    """(mel levels in dB of the frames from one before the piece's first on, hop, where the sound ends)."""
    hop, sr = int(pdf["hop"].iloc[0]), int(pdf["sr"].iloc[0])
    begin = int(pdf["piece"].iloc[0]) * size * hop - hop - n_fft // 2
    x, end = _line(pdf, begin, size * hop + n_fft)
    weight, bands = np.hanning(n_fft + 1)[:-1], mel_filters(sr, n_fft, n_mels).T
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    power = np.concatenate([np.abs(np.fft.rfft(frames[k : k + 512] * weight, axis=1)) ** 2 @ bands for k in range(0, len(frames), 512)])
    return 10 * np.log10(np.maximum(power, 1e-10)), hop, end


def onset_strength(blocks: DataFrame, seconds: float = 0.003, n_fft: int = 2048, n_mels: int = 128, range_db: float = 80.0, size: int = PIECE) -> DataFrame:
    """(song_id, stem, frame, t, v): by how much the mel bands rise from frame to frame, in dB, on the mean of
    all bands; a frame every ``seconds`` or the whole number of samples nearest to it. Levels are cut
    at ``range_db`` below the stem's loudest. A window tells of an onset when it first reaches it, so
    frames count from half a window later."""
    each = pieces(blocks, hop_of(F.col("sr"), seconds), F.col("hop") + n_fft // 2, n_fft // 2, size)

    def loudest(pdf: pd.DataFrame) -> pd.DataFrame:
        mel, hop, end = _mel(pdf, n_fft, n_mels, size)
        first = int(pdf["piece"].iloc[0]) * size - 1
        inside = [k for k in range(len(mel)) if 0 <= (first + k) * hop <= end]
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[:1], "stem": pdf["stem"].iloc[:1], "top": [float(mel[inside].max()) if inside else None]})

    def rises(pdf: pd.DataFrame) -> pd.DataFrame:
        mel, hop, end = _mel(pdf, n_fft, n_mels, size)
        mel = np.maximum(mel, float(pdf["top"].iloc[0]) - range_db)
        first, shift = int(pdf["piece"].iloc[0]) * size, n_fft // (2 * hop)
        g = np.arange(first, first + size)
        rise = np.maximum(0.0, np.diff(mel, axis=0)).mean(1)
        rise[g < 1] = 0.0  # nothing comes before the first frame
        frame = g + shift
        if not first:  # the frames that no window has reached yet
            frame, rise = np.concatenate([np.arange(shift), frame]), np.concatenate([np.zeros(shift), rise])
        known = frame * hop <= end
        frame, rise = frame[known], rise[known]
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[0], "stem": pdf["stem"].iloc[0], "frame": frame, "t": frame * hop / int(pdf["sr"].iloc[0]), "v": rise})

    keys = [*STEM, "piece"]
    top = each.groupBy(*keys).applyInPandas(loudest, "song_id long, stem string, top double").groupBy(*STEM).agg(F.max("top").alias("top"))
    return each.join(top.where("top is not null"), STEM).groupBy(*keys).applyInPandas(rises, "song_id long, stem string, frame long, t double, v double")


def tempogram(env: DataFrame, window: int = 384, size: int = PIECE) -> DataFrame:
    """env(song_id, stem, frame, v) -> (song_id, stem, lag, strength): the autocorrelation of the ``window``
    frames around each frame, under a Hann window and over its largest value, on the mean of all
    frames. Pieces give sums for each lag, which add up."""
    half = window // 2
    around = F.sequence(F.greatest(F.floor((F.col("frame") - half) / size), F.lit(0)), F.floor((F.col("frame") + half) / size))
    each = env.select(*STEM, "frame", "v", F.explode(around).alias("piece"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["piece"].iloc[0]) * size
        x, there = np.zeros(size + window), np.zeros(size + window, bool)
        at = pdf["frame"].to_numpy() - first + half
        x[at], there[at] = pdf["v"].to_numpy(), True
        centre = np.flatnonzero(there[half : half + size])
        weight, total = np.hanning(window + 1)[:-1], np.zeros(window)
        for k in range(0, len(centre), 256):
            held = x[centre[k : k + 256, None] + np.arange(window)] * weight
            spectrum = np.fft.rfft(held, 2 * window, axis=1)
            corr = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :window]
            top = np.abs(corr).max(1, keepdims=True)
            total += (corr / np.where(top > 1e-12, top, 1.0)).sum(0)
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[0], "stem": pdf["stem"].iloc[0], "lag": np.arange(window), "s": total, "n": len(centre)})

    parts = each.groupBy(*STEM, "piece").applyInPandas(sums, "song_id long, stem string, lag int, s double, n long")
    return parts.groupBy(*STEM, "lag").agg((F.sum("s") / F.sum("n")).alias("strength"))


def onsets_of(env: DataFrame, seconds: float) -> DataFrame:
    """(song_id, track, t): peaks of the onset strength above its mean by its deviation, between the frames
    by the parabola through three of them; one for every 30 ms at most."""
    near = max(1, round(0.03 / seconds))
    order = Window.partitionBy(*STEM).orderBy("frame")
    level = env.groupBy(*STEM).agg((F.avg("v") + F.stddev_pop("v")).alias("level"))
    told = env.withColumns({"_a": F.lag("v").over(order), "_b": F.lead("v").over(order), "_top": F.max("v").over(order.rowsBetween(-near, near)), "_before": F.coalesce(F.max("v").over(order.rowsBetween(-near, -1)), F.lit(-1.0))})
    peaks = told.join(level, STEM).where("v > level AND v = _top AND v > _before AND _a IS NOT NULL AND _b IS NOT NULL")
    bend = F.col("_a") - 2 * F.col("v") + F.col("_b")
    return peaks.select("song_id", F.col("stem").alias("track"), (F.col("t") + F.when(bend < 0, 0.5 * (F.col("_a") - F.col("_b")) / bend).otherwise(0.0) * seconds).alias("t"))


def audio_tempo(blocks: DataFrame, seconds: float = 512 / 22050, window: int = 384, n_fft: int = 2048, n_mels: int = 128) -> tuple[DataFrame, DataFrame]:
    """(tempi, candidates) from the sound: (song_id, stem, bpm), null without onsets, and (song_id, stem,
    candidate, ratio, score), the tempo and its octaves by the tempogram's strength over the best one's.

    The strongest lag under a prior around TEMPO_PRIOR gives the tempo to a few per cent; the grid that the
    onsets fit near it gives it exactly."""
    env = grid.hold(onset_strength(blocks, seconds, n_fft, n_mels))
    step = env.where("frame = 1").select(*STEM, F.col("t").alias("step"))
    by_lag = Window.partitionBy(*STEM).orderBy("lag")
    lags = tempogram(env, window).join(step, STEM).withColumns({"_a": F.lag("strength").over(by_lag), "_b": F.lead("strength").over(by_lag)}).where("lag > 0")
    bend = F.col("_a") - 2 * F.col("strength") + F.col("_b")
    peak = F.coalesce(F.when((bend < 0) & (F.col("strength") >= F.greatest("_a", "_b")), 0.5 * (F.col("_a") - F.col("_b")) / bend), F.lit(0.0))
    lags = grid.hold(lags.withColumn("bpm", 60 / ((F.col("lag") + peak) * F.col("step"))))
    prior = F.log1p(F.greatest("strength", F.lit(0.0)) * 1e6) - 0.5 * F.pow(F.log2(F.col("bpm") / TEMPO_PRIOR), 2)
    coarse = lags.where(F.col("bpm").between(MIN_BPM * 0.97, MAX_BPM * 1.03)).groupBy(*STEM).agg(F.max_by("bpm", F.struct(prior, F.col("bpm"))).alias("near"), F.max("strength").alias("top")).where("top > 0")
    # Songs and stems are one key for the fit.
    name = F.concat(F.col("song_id").cast("string"), F.lit("|"), F.col("stem"))
    keyed = coarse.withColumn("name", name).select(*STEM, "name", F.xxhash64("name").alias("key"), "near")
    found = onsets_of(env, seconds).withColumnRenamed("track", "stem").join(keyed, STEM).select(F.col("key").alias("song_id"), F.col("name").alias("track"), "t")
    fitted = grid.fit(found, keyed.select(F.col("key").alias("song_id"), F.col("near").alias("bpm")), least=3)
    fitted = keyed.join(fitted.select(F.col("track").alias("name"), "bpm", "r"), "name", "left").select(*STEM, F.when(F.col("r") >= 0.3, F.col("bpm")).otherwise(F.col("near")).alias("bpm"))
    tempi = blocks.select(*STEM).distinct().join(fitted, STEM, "left").select(*STEM, tempo.octave_fold(F.col("bpm")).alias("bpm"))
    # Each candidate's strength is that of the lag whose tempo is nearest.
    ratios = tempo.candidates(keyed.join(fitted, STEM).select(F.col("key").alias("song_id"), "bpm"), F.lit(1.0)).select(F.col("song_id").alias("key"), "candidate", "ratio")
    place = 60 / (F.col("candidate") * F.col("step"))
    low = F.greatest(F.floor(place), F.lit(1))
    near = F.when(60 / (low * F.col("step")) - F.col("candidate") <= F.col("candidate") - 60 / ((low + 1) * F.col("step")), low).otherwise(low + 1)
    asked = ratios.join(keyed.select(*STEM, "key"), "key").join(step, STEM).withColumn("lag", F.least(near, F.lit(window - 1)).cast("int"))
    scored = asked.join(lags.select(*STEM, "lag", "strength"), [*STEM, "lag"], "left").withColumn("strength", F.greatest(F.coalesce("strength", F.lit(0.0)), F.lit(0.0)))
    top = F.max("strength").over(Window.partitionBy(*STEM))
    return tempi, scored.select(*STEM, "candidate", "ratio", F.when(top > 0, F.col("strength") / top).otherwise(F.lit(1.0)).alias("score"))


def trim_bounds(blocks: DataFrame, top_db: float = 50.0, hop: int = 512, cells: int = 4) -> DataFrame:
    """Begin and end in seconds of what is less than ``top_db`` below the loudest frame of a song, null for
    silence: frames of ``cells`` hops (an even number) centred on every hop. Blocks send sums of
    squares for each hop they touch, so frames cross blocks and nothing is put in order."""
    mono = mono_blocks(blocks).withColumns({"_first": F.rint(F.col("t0") * F.col("sr")).cast("long"), "_n": F.size("samples")}).where("_n > 0")
    spread = mono.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_first") / hop), F.floor((F.col("_first") + F.col("_n") - 1) / hop))))
    a = F.greatest(F.col("cell") * hop - F.col("_first"), F.lit(0))
    b = F.least((F.col("cell") + 1) * hop - F.col("_first"), F.col("_n"))
    power = F.aggregate(F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")), F.lit(0.0), lambda s, x: s + x * x)
    sums = spread.groupBy("song_id", "cell").agg(F.sum(power).alias("p"), F.max(F.col("_first") + F.col("_n")).alias("end"), F.min("sr").alias("sr"))
    ends = sums.groupBy("song_id").agg(F.max("end").alias("n"), F.min("sr").alias("sr"))
    frames = sums.select("song_id", "p", F.explode(F.sequence(F.col("cell") - cells // 2 + 1, F.col("cell") + cells // 2)).alias("frame")).where("frame >= 0")
    level = frames.groupBy("song_id", "frame").agg((F.sum("p") / (hop * cells)).alias("m")).join(ends, "song_id").where(F.col("frame") * hop <= F.col("n"))
    top = level.groupBy("song_id").agg(F.max("m").alias("top"))
    db = lambda c: 10 * F.log10(F.greatest(F.col(c), F.lit(1e-10)))
    loud = (F.col("top") > 0) & (db("m") - db("top") > -top_db)
    end = F.least((F.col("frame") + 1) * hop, F.col("n"))
    return level.join(top, "song_id").groupBy("song_id").agg(F.min(F.when(loud, F.col("frame") * hop / F.col("sr"))).alias("begin"), F.max(F.when(loud, end / F.col("sr"))).alias("end"))
