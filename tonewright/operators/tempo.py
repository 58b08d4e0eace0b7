"""Tempo: from beats, from onsets, octave candidates, delays, and how one is decided."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_TEMPO, MAX_BPM, MIN_BPM, OCTAVE_RATIOS, SUBDIVISIONS, TRACK, dealt


def in_range(bpm: Column) -> Column:
    return bpm.between(MIN_BPM, MAX_BPM)


def regression(beats: DataFrame) -> DataFrame:
    """Tempo from a least-squares line through three or more beats; null out of range."""
    a = beats.groupBy("song_id").agg(F.count("*").alias("n"), F.regr_slope(F.col("t"), F.col("k").cast("double")).alias("slope"))
    bpm = F.lit(60.0) / F.col("slope")
    return a.select("song_id", "n", F.when((F.col("n") >= 3) & (F.col("slope") > 0) & in_range(bpm), bpm).alias("bpm"))


def octave_fold(bpm: Column) -> Column:
    """Doubled or halved until in range, in closed form."""
    up = F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(MIN_BPM) / bpm)))
    down = F.pow(F.lit(2.0), F.ceil(F.log2(bpm / F.lit(MAX_BPM))))
    return F.when(bpm <= 0, bpm).when(bpm < MIN_BPM, bpm * up).when(bpm > MAX_BPM, bpm / down).otherwise(bpm)


def candidates(tempi: DataFrame, strength: Column) -> DataFrame:
    """tempi(song_id, bpm) times the octave ratios: those in range, one for each whole tempo (in the
    order of the ratios), scored by ``strength`` of ``candidate`` over the best. Out of range
    altogether, the folded tempo alone."""
    ratios = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(float(r)).alias("ratio")) for k, r in enumerate(OCTAVE_RATIOS)])
    rows = tempi.select("song_id", "bpm", F.explode(ratios).alias("r")).select("song_id", "bpm", "r.i", "r.ratio").withColumn("candidate", F.col("bpm") * F.col("ratio"))
    once = F.row_number().over(Window.partitionBy("song_id", F.rint("candidate")).orderBy("i"))
    kept = rows.where(in_range(F.col("candidate"))).withColumn("_r", once).where("_r = 1").withColumn("score", strength)
    none = tempi.join(kept.select("song_id").distinct(), "song_id", "left_anti").withColumn("candidate", octave_fold(F.col("bpm"))).select("song_id", "candidate", (F.col("candidate") / F.col("bpm")).alias("ratio"), F.lit(1.0).alias("score"))
    out = kept.select("song_id", "candidate", "ratio", "score").unionByName(none)
    top = F.max("score").over(Window.partitionBy("song_id"))
    return out.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def circular_phase(notes: DataFrame, period: float) -> DataFrame:
    """Phase of a period from a weighted circular mean of the onsets, in [0, period)."""
    turn, w = F.lit(2 * math.pi / period) * F.col("start_s"), 0.3 + 0.7 * F.col("velocity") / 127.0
    a = notes.groupBy(*TRACK).agg(F.sum(w * F.cos(turn)).alias("x"), F.sum(w * F.sin(turn)).alias("y"))
    return a.select(*TRACK, F.pmod(F.atan2("y", "x") / (2 * math.pi) * F.lit(period) + F.lit(period), F.lit(period)).alias("phase"))


def onset_delay(onsets: DataFrame, beats: DataFrame, bpm: float) -> DataFrame:
    """How late a song's onsets sit against the subdivision they share, where that can be told:
    40 onsets or more, a concentration of a half, at most 40 ms."""
    from .tempo_map import position

    period = 60.0 / bpm
    ends = beats.groupBy("song_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    rounded = onsets.select("song_id", (F.floor(F.col("t") * 1000 + 0.5) / 1000).alias("t")).distinct().join(ends, "song_id").where("t >= a AND t <= b").select("song_id", "t")
    placed = position(rounded, beats)
    used = F.array(*[F.lit(s) for s in SUBDIVISIONS if period / (2 * s) >= 0.04])
    turn = F.lit(2 * math.pi) * F.pmod(F.col("position") * F.col("s"), F.lit(1.0))
    a = placed.withColumn("s", F.explode(used)).groupBy("song_id", "s").agg(F.avg(F.cos(turn)).alias("x"), F.avg(F.sin(turn)).alias("y"), F.count("*").alias("n"))
    best = a.withColumn("c", F.hypot("x", "y")).groupBy("song_id").agg(F.max_by(F.struct("s", "c", "x", "y", "n"), F.struct("c", -F.col("s"))).alias("b")).select("song_id", "b.*")
    delay = F.atan2("y", "x") / (2 * math.pi * F.col("s")) * F.lit(period)
    return best.select("song_id", F.col("s").alias("subdivision"), F.col("c").alias("concentration"), F.when((F.col("n") >= 40) & (F.col("c") >= 0.5) & (F.abs(delay) <= 0.04), delay).alias("delay"))


def autocorrelation(times: np.ndarray, weights: np.ndarray, seconds: float, low: float = 60.0, high: float = 200.0, prior: float = 120.0, rate: int = 100) -> tuple[float, float] | None:
    """(bpm, first beat) from the autocorrelation of a smoothed onset train under a log-normal prior."""
    n = max(1, math.ceil(seconds * rate) + 1)
    w = 0.3 + 0.7 * weights
    at = np.floor(times * rate + 0.5).astype(int)
    inside = (at >= 0) & (at < n)
    env = np.bincount(at[inside], w[inside], n)
    env = np.convolve(env, [0.05, 0.24, 0.4, 0.24, 0.05], mode="same") if n >= 5 else env
    env = env - env.mean()
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(env, size)
    corr = np.fft.irfft(spectrum * np.conj(spectrum), size)[:n] / np.maximum(n - np.arange(n), 1)
    corr[0] = 0.0

    def score(bpm: np.ndarray) -> np.ndarray:
        total = np.zeros_like(bpm)
        for multiple, part in ((1, 1.0), (2, 0.5), (3, 0.25)):
            lag = multiple * 60.0 / bpm * rate
            k = np.floor(lag).astype(int)
            a = np.where(k < n, corr[np.minimum(k, n - 1)], 0.0)
            b = np.where(k + 1 < n, corr[np.minimum(k + 1, n - 1)], 0.0)
            total += part * ((1 - (lag - k)) * a + (lag - k) * b)
        return total * np.exp(-0.5 * np.log2(bpm / prior) ** 2)

    coarse = np.arange(low, high + 1e-9, 0.25)
    best = coarse[np.argmax(score(coarse))]
    if len(times) < 8 or score(np.array([best]))[0] <= 0:
        return None
    fine = np.concatenate([[best], np.arange(best - 0.25, best + 0.25 + 1e-9, 0.01)])
    bpm = round(float(fine[np.argmax(score(fine))]), 2)
    turn = 2 * math.pi * times / (60.0 / bpm)
    phase = math.atan2(float((w * np.sin(turn)).sum()), float((w * np.cos(turn)).sum()))
    return bpm, (phase / (2 * math.pi) * 60.0 / bpm + 60.0 / bpm) % (60.0 / bpm)


def onset_tempo(notes: DataFrame) -> DataFrame:
    """autocorrelation() of each song's notes: song_id, bpm, beat0; null where it can't be told."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_s", "note_id"])
        found = autocorrelation(pdf["start_s"].to_numpy(), pdf["velocity"].to_numpy() / 127.0, float(pdf["end_s"].max()))
        return pd.DataFrame([[pdf["song_id"].iloc[0], *(found or (None, None))]], columns=["song_id", "bpm", "beat0"])

    return dealt(notes.select("song_id", "note_id", "start_s", "end_s", "velocity"), "song_id").groupBy("song_id").applyInPandas(one, "song_id long, bpm double, beat0 double")


def resolve(songs: DataFrame) -> DataFrame:
    """songs(song_id, user_bpm, drums_bpm, mix_bpm): what the user says, else the drums, else the mix,
    else the default; with where it came from."""
    bpm = F.coalesce("user_bpm", "drums_bpm", "mix_bpm", F.lit(DEFAULT_TEMPO))
    source = F.when(F.col("user_bpm").isNotNull(), "user").when(F.col("drums_bpm").isNotNull() | F.col("mix_bpm").isNotNull(), "detected").otherwise("default")
    stem = F.when(F.col("user_bpm").isNotNull(), None).when(F.col("drums_bpm").isNotNull(), "drums").when(F.col("mix_bpm").isNotNull(), "mix")
    return songs.select("song_id", bpm.alias("bpm"), source.alias("source"), stem.alias("analyzed_stem"))


def beat_histogram(notes: DataFrame, bpm: float, anchor: float, bins: int = 12) -> DataFrame:
    """Onsets by place within the pulse."""
    pos = (F.col("start_s") - F.lit(anchor)) / F.lit(60.0 / bpm)
    k = F.pmod(F.rint(F.pmod(pos, F.lit(1.0)) * bins), F.lit(float(bins))).cast("int")
    return notes.groupBy(*TRACK, k.alias("bin")).agg(F.count("*").alias("n"))


def subdivision_offsets(notes: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """Mean distance to the nearest half, third, quarter and sixth of a pulse, in its units."""
    q = (F.col("start_s") - F.lit(anchor)) / F.lit(60.0 / bpm) * F.col("division")
    return notes.withColumn("division", F.explode(F.array(*[F.lit(d) for d in (2, 3, 4, 6)]))).groupBy(*TRACK, "division").agg(F.avg(F.abs(q - F.rint(q))).alias("offset"))


def pulse_histogram(notes: DataFrame, bpm: float, anchor: float, pulses: int, near: float = 0.2) -> DataFrame:
    """Onsets near each pulse of the bar (of a kit, the kick only), all pulses listed."""
    pos = (F.col("start_s") - F.lit(anchor)) / F.lit(60.0 / bpm)
    used = notes.where(~F.col("is_drum") | F.col("pitch").isin(35, 36)).withColumn("pos", pos).where(F.abs(F.col("pos") - F.rint("pos")) < near)
    n = used.groupBy(*TRACK, F.pmod(F.rint("pos"), F.lit(float(pulses))).cast("int").alias("pulse")).agg(F.count("*").alias("n"))
    spine = notes.select(*TRACK).distinct().withColumn("pulse", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1))))
    return spine.join(n, [*TRACK, "pulse"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def tempo_per_bars(bars: DataFrame, pulses: int, size: int = 8) -> DataFrame:
    """Tempo by regression over groups of bar lines. bars(song_id, bar, t)."""
    a = bars.groupBy("song_id", F.floor(F.col("bar") / size).alias("part")).agg(F.count("*").alias("n"), F.regr_slope(F.col("t"), F.col("bar").cast("double")).alias("slope")).where("n >= 2")
    return a.select("song_id", "part", "n", (F.lit(60.0 * pulses) / F.col("slope")).alias("bpm"))
