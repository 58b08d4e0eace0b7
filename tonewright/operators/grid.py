"""The constant-tempo grid: alignment, fit, search, pulse, bar one, latency and snapping.

A grid is (bpm, anchor) with four steps ("sixteenths") to a pulse. Per-song choices are
columns, so many songs are fitted in one job.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACCENT_WEIGHT, FINER_GAIN, FIT_SPAN, FIT_STEPS, GROUP_WEIGHT, LAG_MIN_SCORE, MAP_GAIN, MAP_THRESHOLD, MIN_ALIGNMENT, MIN_ONSETS, OFF_FILL, PHASE_WARN, PULSE_TOL, RESOLUTION, SEARCH_HIGH, SEARCH_LOW, SEARCH_STEP, SOURCE_LAG_WARN, TEMPO_PRIOR, TRACK, dealt
from .measure import onset_dedupe


def over(x: Column, s: Column) -> Column:
    """What x has over a whole number of s, taken off in one step as the SQL does: ``pmod`` rounds otherwise
    in the last bit, which decides where a note lies half-way between two steps."""
    return x - s * F.floor(x / s)


def signed(t: Column, anchor: Column, six: Column) -> Column:
    """Signed distance to the nearest sixteenth, in seconds."""
    return over(t - anchor + six / 2, six) - six / 2


def step_of(t: Column, anchor: Column, six: Column) -> Column:
    return F.rint((t - anchor) / six)


def alignment(onsets: DataFrame, six: float | Column, keys: list[str] = TRACK) -> DataFrame:
    """How tightly onsets share one phase of a period (r, 0 to 1), and that phase."""
    turn = F.lit(2 * np.pi) * F.col("t") / (F.lit(six) if isinstance(six, float) else six)
    a = onsets.groupBy(*keys).agg(F.avg(F.cos(turn)).alias("_x"), F.avg(F.sin(turn)).alias("_y"), F.count("*").alias("n"))
    return a.select(*keys, "n", F.hypot("_x", "_y").alias("r"), F.atan2("_y", "_x").alias("phase"))


#: A stretch of time in seconds; within it the sums of a band of periods are a polynomial of TERMS terms.
STRETCH, TERMS = 16.0, 14
BAND = 2 / (math.pi * STRETCH)  # Hz from one band to the next


def moments(onsets: DataFrame, low: float | Column, high: float | Column, keys: list[str] = TRACK) -> DataFrame:
    """What the periods of frequencies [low, high] Hz, of all or of each onset's song, need to know of each
    track: per stretch of time and band of frequencies (around ``f0``, wide enough that a stretch turns by
    one radian either way), the sums of u**m cos and u**m sin, u an onset's place in its stretch and the
    angle at f0.

    A candidate's sum over all onsets is then a few terms for each stretch, however many onsets there are.
    All sums add up, so they are taken before the shuffle and no task sees a track."""
    place = lambda f: F.floor((f if isinstance(f, Column) else F.lit(float(f))) / BAND)
    s = F.floor(F.col("t") / STRETCH)
    bands = F.transform(F.sequence(place(low), place(high)), lambda k: (k + 0.5) * BAND)
    here = onsets.select(*keys, s.alias("stretch"), (F.col("t") - (s + 0.5) * STRETCH).alias("v"), F.explode(bands).alias("f0"))
    turned = here.select(*keys, "stretch", "f0", (F.col("v") / (STRETCH / 2)).alias("u"), F.cos(2 * np.pi * F.col("f0") * F.col("v")).alias("c"), F.sin(2 * np.pi * F.col("f0") * F.col("v")).alias("s"))
    sums, power = [F.count("*").alias("n")], F.lit(1.0)
    for m in range(TERMS):
        turned = turned.withColumns({f"p{m}": F.col(f"p{m - 1}") * F.col("u") if m else F.lit(1.0)})
        sums += [F.sum(F.col(f"p{m}") * F.col(x)).alias(f"{x}{m}") for x in ("c", "s")]
    return turned.groupBy(*keys, "stretch", "f0").agg(*sums)


class Spectrum:
    """One track's moments; r and phase of any candidate within their frequencies."""

    def __init__(self, pdf: pd.DataFrame):
        self.bands, at = np.unique(pdf["f0"].to_numpy(), return_inverse=True)
        stretches, row = np.unique(pdf["stretch"].to_numpy(), return_inverse=True)
        self.centre = (stretches + 0.5) * STRETCH
        self.sums = np.zeros((len(self.bands), TERMS, len(stretches)), complex)
        for m in range(TERMS):
            self.sums[at, m, row] = (pdf[f"c{m}"].to_numpy() + 1j * pdf[f"s{m}"].to_numpy()) * 1j**m / math.factorial(m)
        self.n = int(pdf.loc[pdf["f0"] == self.bands[0], "n"].sum())

    def of(self, sixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = 1 / sixes
        z = np.zeros(len(f), complex)
        band = np.clip(np.floor((f - self.bands[0]) / BAND + 0.5).astype(int), 0, len(self.bands) - 1)
        if np.abs(f - self.bands[band]).max() > 0.51 * BAND:  # the series holds within a band only
            raise ValueError(f"periods of {sixes.min():.4f} to {sixes.max():.4f} s lie outside of the bands at hand")
        for b in np.unique(band):
            mine = np.flatnonzero(band == b)
            x = np.pi * STRETCH * (f[mine] - self.bands[b])
            inner = np.power(x[:, None], np.arange(TERMS)) @ self.sums[b]
            # The stretches' own phases; their centres are even multiples of half a stretch.
            z[mine] = (inner * np.exp(2j * np.pi * np.mod(f[mine, None] * self.centre, 1.0))).sum(1)
        z /= self.n
        r = np.abs(z)
        assert r.max() <= 1 + 1e-6
        return np.minimum(r, 1.0), np.angle(z)


def best_period(track: Spectrum, bpm: float, span: float = FIT_SPAN, steps: int = FIT_STEPS) -> tuple[float, float, float]:
    """(bpm, anchor, r) of the grid near ``bpm`` that fits best; the first of equals."""
    sixes = 60.0 / bpm / 4 * np.linspace(1 - span, 1 + span, steps)
    r, phase = track.of(sixes)
    k = int(np.argmax(r))
    return 60.0 / (4 * sixes[k]), phase[k] / (2 * np.pi) * sixes[k] % sixes[k], float(r[k])


def free_tempo(track: Spectrum) -> tuple[float, float, float]:
    """The same without a guess: of the near-best tempi the one nearest the prior, refined."""
    bpms = np.exp(np.arange(np.log(SEARCH_LOW), np.log(SEARCH_HIGH), SEARCH_STEP))
    r, _ = track.of(15.0 / bpms)
    good = np.flatnonzero(r >= 0.95 * r.max())
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    peaks = np.array([run[np.argmax(r[run])] for run in runs])
    best = peaks[np.argmin(np.abs(np.log(bpms[peaks] / TEMPO_PRIOR)))]
    return best_period(track, float(bpms[best]), 0.002, 2001)


_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def hold(df: DataFrame) -> DataFrame:
    """A table that is read several times: a checkpoint where the session has a folder for them, so that
    lost executors cost nothing; else a cache, noted for this thread."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    if _held.get() is None:
        _held.set([])
    _held.get().append(df.cache())
    return _held.get()[-1]


def release() -> None:
    """Gives back what ``hold`` cached in this thread; tables made from it are computed anew if they are
    read again."""
    free(_held.get() or [])


def free(held: list[DataFrame]) -> None:
    while held:
        held.pop().unpersist()


@contextmanager
def holding():
    """What is held meanwhile is noted in a list of its own, which is returned: ``free`` gives it back."""
    own: list[DataFrame] = []
    token = _held.set(own)
    try:
        yield own
    finally:
        _held.reset(token)


FITTED = "song_id long, track string, n long, bpm double, anchor double, r double"


def fit(onsets: DataFrame, bpm: float | DataFrame | None = None, least: int = 1, factor: int = 1) -> DataFrame:
    """Best grid of every track with at least so many onsets, near ``factor`` times a tempo: one for all
    songs, or one for each (song_id, bpm); without ``bpm`` a free search. Onsets become moments in
    Spark; candidates are held against a track's few moments in numpy."""
    given = float(bpm) if isinstance(bpm, (int, float)) else None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        track = Spectrum(pdf)
        if track.n < least:
            return pd.DataFrame(columns=["song_id", "track", "n", "bpm", "anchor", "r"])
        near = float(pdf["near"].iloc[0]) if "near" in pdf else given
        found = free_tempo(track) if near is None else best_period(track, near * factor)
        return pd.DataFrame([[pdf["song_id"].iloc[0], pdf["track"].iloc[0], track.n, *found]], columns=["song_id", "track", "n", "bpm", "anchor", "r"])

    keys, rows = list(TRACK), onsets.select(*TRACK, "t")
    if isinstance(bpm, DataFrame):  # a song's onsets meet the bands around its own tempo alone
        keys.append("near")
        rows = rows.join(bpm.where("bpm > 0").select("song_id", F.col("bpm").alias("near")), "song_id")
    around = F.col("near") if isinstance(bpm, DataFrame) else given
    low, high = (SEARCH_LOW * 0.95, SEARCH_HIGH * 1.05) if bpm is None else (around * (factor * (1 - FIT_SPAN)), around * (factor / (1 - FIT_SPAN)))
    known = moments(rows, low / 15, high / 15, keys)
    return dealt(known, *TRACK).groupBy(*TRACK).applyInPandas(one, FITTED)


def search(onsets: DataFrame, least: int = MIN_ONSETS) -> DataFrame:
    """(song_id, bpm) by a free search on the track with most onsets, the first by name of equals."""
    counts = onsets.groupBy(*TRACK).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy("song_id").orderBy(F.desc("n"), "track")
    most = counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*TRACK)
    return fit(onsets.join(most, TRACK, "left_semi")).select("song_id", "bpm")


#: r is exact to about twelve digits; tracks nearer than this to the best are equals.
R_TIE = 1e-11


def best_track(fits: DataFrame) -> DataFrame:
    """Per song: its best-aligned track's fit (the first by name of equals), and how many tracks there are. Tracks
    with the same onsets have an r that differs in its last bits by the order in which Spark adds up."""
    top = F.max("r").over(Window.partitionBy("song_id"))
    first = F.min(F.when(F.col("r") >= F.col("_top") - R_TIE, F.struct("track", "bpm", "anchor", "r", "n")))
    return fits.withColumn("_top", top).groupBy("song_id").agg(first.alias("b"), F.count("*").alias("n_tracks")).select("song_id", "b.track", "b.bpm", "b.anchor", "b.r", "b.n", "n_tracks")


def fit_tracks(onsets: DataFrame, bpm: float | DataFrame, least: int = MIN_ONSETS, factor: int = 1) -> DataFrame:
    """Per song: the grid of its best-aligned track (the first by name of equals), and which it is."""
    return best_track(fit(onsets, bpm, least, factor))


def map_source(notes: DataFrame, onsets: DataFrame, bpm: float | DataFrame, factor: int = 1) -> DataFrame:
    """(song_id, track) that a tempo map follows: the best-aligned kit, and where a song has none with
    enough onsets its best-aligned track (of equals the first by name)."""
    kit = notes.groupBy(*TRACK).agg(F.max("is_drum").alias("is_drum"))
    fits = fit(onsets, bpm, MIN_ONSETS, factor).join(kit, TRACK).withColumn("_kits", F.max("is_drum").over(Window.partitionBy("song_id")))
    return best_track(fits.where(F.col("is_drum") == F.col("_kits"))).select(*TRACK)


def align_to_beats(onsets: DataFrame, grids: DataFrame) -> DataFrame:
    """Grids with the anchor on the sixteenth of the pulse that most onsets start on (the lowest of equals)."""
    k = F.pmod(step_of(F.col("t"), F.col("anchor"), 15.0 / F.col("bpm")), F.lit(4.0)).cast("int")
    # The counts are taken first; the grid is joined to a row per song and place.
    joined = onsets.select("song_id", "t").join(grids, "song_id").groupBy("song_id", k.alias("k")).agg(F.count("*").alias("n"))
    best = joined.groupBy("song_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("k"))
    return grids.join(best, "song_id").withColumn("anchor", F.col("anchor") + F.col("k") * 15.0 / F.col("bpm"))


def pulse_offset(onsets: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Mean distance of onsets to the nearest pulse, in seconds."""
    p = 60.0 / F.col("bpm")
    return onsets.join(grids.select("song_id", "bpm", "anchor"), "song_id").groupBy(*keys).agg(F.avg(F.abs(over(F.col("t") - F.col("anchor") + p / 2, p) - p / 2)).alias("pulse_offset"))


def off_fill(onsets: DataFrame, grids: DataFrame) -> DataFrame:
    """Share of the fine pulses between the coarse ones that have an onset near.

    grids(song_id, track, fine_bpm, fine_anchor, coarse_bpm, coarse_anchor). Pulses and onsets are
    one sorted stream, in which each pulse looks one onset back and one ahead.
    """
    p, c = 60.0 / F.col("fine_bpm"), 60.0 / F.col("coarse_bpm")
    ends = onsets.groupBy(*TRACK).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).where("n >= 2").join(grids, TRACK)
    k0, k1 = F.ceil((F.col("a") - F.col("fine_anchor")) / p), F.floor((F.col("b") - F.col("fine_anchor")) / p)
    pulses = ends.where(k1 >= k0).select("*", F.explode(F.sequence(k0, k1)).alias("k")).withColumn("x", F.col("fine_anchor") + F.col("k") * p)
    off = pulses.where(F.abs(over(F.col("x") - F.col("coarse_anchor") + c / 2, c) - c / 2) > p / 4).select(*TRACK, F.col("x").alias("s"), F.lit(1).alias("q"), (p / 4).alias("near"))
    stream = off.unionByName(onsets.select(*TRACK, F.col("t").alias("s"), F.lit(0).alias("q"), F.col("t").alias("onset")), allowMissingColumns=True)
    order = Window.partitionBy(*TRACK).orderBy("s", "q")
    before = F.last("onset", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("onset", True).over(Window.partitionBy(*TRACK).orderBy(F.desc("s"), F.desc("q")).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.least(F.abs(F.col("s") - F.col("before")), F.abs(F.col("after") - F.col("s")))
    return stream.withColumns({"before": before, "after": after}).where("q = 1").groupBy(*TRACK).agg(F.avg((gap <= F.col("near")).cast("double")).alias("off_fill"))


def fit_pulse(onsets: DataFrame, bpm: float | DataFrame, den: int = 4, fixed: bool = False, min_alignment: float = MIN_ALIGNMENT) -> DataFrame:
    """Per song the grid in the meter's pulse: the tracked beat, or in x/8 the coarsest of it, its half
    and its third, unless a finer one is clearly needed (nearer by FINER_GAIN and PULSE_TOL, and its
    own pulses mostly played)."""
    kept = None
    for d in (1, 2, 3) if den >= 8 and not fixed else (1,):
        # A row per song, read several times below and dear to fit.
        found = hold(fit_tracks(onsets, bpm, factor=d).where(F.col("r") >= min_alignment))
        aligned = align_to_beats(onsets, found).select("song_id", "track", "bpm", "anchor", "r")
        source = onsets.join(aligned.select("song_id", "track"), TRACK, "left_semi")
        aligned = aligned.join(pulse_offset(source, aligned, ["song_id"]), "song_id").withColumn("factor", F.lit(d))
        if kept is None:
            kept = aligned
            continue
        fine = F.struct("track", "bpm", "anchor", "r", "pulse_offset", "factor")
        both = kept.select("song_id", fine.alias("k")).join(aligned.select("song_id", fine.alias("f")), "song_id", "full")
        asked = both.where("k is not null and f is not null").select("song_id", "f.track", F.col("f.bpm").alias("fine_bpm"), F.col("f.anchor").alias("fine_anchor"), F.col("k.bpm").alias("coarse_bpm"), F.col("k.anchor").alias("coarse_anchor"))
        both = both.join(off_fill(onsets, asked).select("song_id", "off_fill"), "song_id", "left")
        finer = (F.col("f.pulse_offset") < FINER_GAIN * F.col("k.pulse_offset")) & (F.col("f.pulse_offset") < F.col("k.pulse_offset") - PULSE_TOL) & (F.coalesce("off_fill", F.lit(0.0)) >= OFF_FILL)
        kept = hold(both.select("song_id", F.when(F.col("k").isNull() | F.coalesce(finer, F.lit(False)), F.col("f")).otherwise(F.col("k")).alias("b")).select("song_id", "b.*"))
    return kept


def chroma(notes: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """Seconds that each pitch class sounds in each pulse (kits left out); pulse 0 is the first at or
    after time 0 less one pulse. Notes are dealt to the pulses they overlap, not range-joined."""
    p = 60.0 / bpm
    first = anchor - np.ceil(anchor / p) * p
    pitched = notes.where(~F.col("is_drum"))
    last = pitched.groupBy("song_id").agg((F.ceil((F.max("end_s") - F.lit(first)) / F.lit(p)) - 1).alias("last"))
    k = lambda c: F.floor((F.col(c) - F.lit(first)) / F.lit(p))
    spread = pitched.join(last, "song_id").withColumns({"a": F.greatest(k("start_s"), F.lit(0)), "b": F.least(k("end_s"), F.col("last"))}).where("b >= a")
    each = spread.select("song_id", "pitch", "start_s", "end_s", F.explode(F.sequence("a", "b")).alias("beat"))
    begin = F.lit(first) + F.col("beat") * F.lit(p)
    overlap = F.least("end_s", begin + F.lit(p)) - F.greatest("start_s", begin)
    return each.withColumn("w", overlap).where("w > 0").groupBy("song_id", "beat", (F.col("pitch") % 12).alias("pc")).agg(F.sum("w").alias("w"))


def beats_spine(notes: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """All pulses of each song, with or without notes."""
    p = 60.0 / bpm
    first = anchor - np.ceil(anchor / p) * p
    ends = notes.where(~F.col("is_drum")).groupBy("song_id").agg((F.ceil((F.max("end_s") - F.lit(first)) / F.lit(p)) - 1).alias("last"))
    return ends.where("last >= 0").select("song_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("beat"))


def harmonic_change(notes: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """1 less the cosine of each pulse's chroma and the one before; 0 if either is silent."""
    c = chroma(notes, bpm, anchor)
    norm = c.groupBy("song_id", "beat").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    before = c.select("song_id", (F.col("beat") + 1).alias("beat"), "pc", F.col("w").alias("v"))
    dot = c.join(before, ["song_id", "beat", "pc"]).groupBy("song_id", "beat").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    last = norm.select("song_id", (F.col("beat") + 1).alias("beat"), F.col("norm").alias("norm0"))
    change = norm.join(last, ["song_id", "beat"]).join(dot, ["song_id", "beat"], "left").select("song_id", "beat", (1 - F.coalesce("dot", F.lit(0.0)) / F.col("norm") / F.col("norm0")).alias("change"))
    return beats_spine(notes, bpm, anchor).join(change, ["song_id", "beat"], "left").withColumn("change", F.coalesce("change", F.lit(0.0)))


def accent_profile(notes: DataFrame, bpm: float, anchor: float, pulses: int) -> DataFrame:
    """Loudness of the onsets nearest each pulse of the bar, all pulses listed."""
    k = F.pmod(F.rint((F.col("start_s") - F.lit(anchor)) / F.lit(60.0 / bpm)), F.lit(float(pulses))).cast("int")
    sums = notes.groupBy("song_id", k.alias("pulse")).agg(F.sum(F.col("velocity") / F.lit(127.0)).alias("accent"))
    spine = notes.select("song_id").distinct().select("song_id", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1))).alias("pulse"))
    return spine.join(sums, ["song_id", "pulse"], "left").withColumn("accent", F.coalesce("accent", F.lit(0.0)))


def bar_phase(notes: DataFrame, bpm: float, anchor: float, groups: tuple[int, ...] = (1, 1, 1, 1)) -> DataFrame:
    """Bar "one" of each song: the pulse where the harmony changes most; in meters other than 4/4 with
    the other group starts and the accents. Returns phase, confidence and the anchor on it."""
    pulses = sum(groups)
    offset = int(np.ceil(anchor * bpm / 60.0))
    at = F.pmod(F.col("beat") - offset, F.lit(pulses)).cast("int")
    mean = harmonic_change(notes, bpm, anchor).groupBy("song_id", at.alias("pulse")).agg(F.avg("change").alias("score"))
    spine = notes.where(~F.col("is_drum")).select("song_id").distinct().select("song_id", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1))).alias("pulse"))
    harmony = spine.join(mean, ["song_id", "pulse"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    if groups != (1, 1, 1, 1):
        accents = accent_profile(notes, bpm, anchor, pulses).withColumnRenamed("accent", "score")
        unit = lambda df, name: with_groups(df, groups).withColumn("_top", F.max("score").over(Window.partitionBy("song_id"))).select("song_id", "pulse", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.col("score")).alias(name))
        harmony = unit(harmony, "h").join(unit(accents, "a"), ["song_id", "pulse"]).select("song_id", "pulse", (F.col("h") + ACCENT_WEIGHT * F.col("a")).alias("score"))
    # On exact ties the last pulse wins, as a reversed sort has it.
    rank = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("score"), F.desc("pulse")))
    two = harmony.withColumn("r", rank).where("r <= 2").groupBy("song_id").agg(F.max(F.when(F.col("r") == 1, F.col("pulse"))).alias("phase"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    confidence = F.when(F.lit(pulses < 2), 1.0).when(F.col("best") > 0, (F.col("best") - F.col("second")) / F.col("best")).otherwise(0.0)
    return two.select("song_id", "phase", confidence.alias("confidence"), (F.lit(anchor) + F.col("phase") * F.lit(60.0 / bpm)).alias("anchor"))


def with_groups(scores: DataFrame, groups: tuple[int, ...]) -> DataFrame:
    """Each pulse's own score and, at GROUP_WEIGHT, the mean at the group starts that it implies."""
    if all(g == 1 for g in groups):
        return scores
    pulses, starts = sum(groups), np.cumsum([0, *groups[:-1]])[1:].tolist()
    listed = scores.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pulse", "score"))), lambda x: x["score"]).alias("s"))
    mean = lambda k: F.aggregate(F.array(*[F.pmod(k + s, F.lit(pulses)) for s in starts]), F.lit(0.0), lambda a, j: a + F.element_at("s", (j + 1).cast("int"))) / len(starts) if starts else F.lit(0.0)
    return listed.select("song_id", "s", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1))).alias("pulse")).select("song_id", "pulse", (F.element_at("s", F.col("pulse") + 1) + GROUP_WEIGHT * mean(F.col("pulse"))).alias("score"))


def latency(notes: DataFrame, bpm: float, anchor: float, hint: Column | None = None) -> DataFrame:
    """Median signed offset of each track; a hint picks the whole number of sixteenths."""
    six = 15.0 / bpm
    m = notes.groupBy(*TRACK).agg(F.median(signed(F.col("start_s"), F.lit(anchor), F.lit(six))).alias("latency"))
    return m if hint is None else m.withColumn("latency", F.col("latency") + F.rint((hint - F.col("latency")) / F.lit(six)) * F.lit(six))


def fit_ms(notes: DataFrame, late: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """Median distance to the grid once the latency is removed, in milliseconds."""
    d = F.abs(signed(F.col("start_s") - F.col("latency"), F.lit(anchor), F.lit(15.0 / bpm)))
    return notes.join(late, TRACK).groupBy(*TRACK).agg((F.median(d) * 1000).alias("grid_fit_ms"))


def offset_16th(notes: DataFrame, bpm: float, anchor: float) -> DataFrame:
    six = 15.0 / bpm
    return notes.groupBy(*TRACK).agg(F.avg(F.abs(signed(F.col("start_s"), F.lit(anchor), F.lit(six)) / F.lit(six))).alias("offset_16th"))


def use_map(offset: Column, gain: Column) -> Column:
    """Whether the automatic mode follows a tempo map."""
    return offset.isNull() | ((offset > MAP_THRESHOLD) & (gain.isNull() | (gain >= MAP_GAIN)))


def snap(notes: DataFrame, late: DataFrame, bpm: float, anchor: float) -> DataFrame:
    """Latency removed, starts on sixteenths, ends on half of them and never nearer than that; a kit
    keeps one hit for each step and pitch, the loudest, of equals the first."""
    six, half = 15.0 / bpm, 7.5 / bpm
    to = lambda c, unit: F.lit(anchor) + F.rint((F.col(c) - F.col("latency") - F.lit(anchor)) / F.lit(unit)) * F.lit(unit)
    on = F.greatest(F.lit(0.0), to("start_s", six))
    moved = notes.join(late, TRACK).withColumns({"_on": on, "_off": to("end_s", half)}).withColumn("_off", F.greatest(F.col("_on") + F.lit(half), F.col("_off")))
    moved = moved.withColumn("step", step_of(F.col("_on"), F.lit(anchor), F.lit(six)).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*TRACK, "step", "pitch").orderBy(F.desc("velocity"), "note_id"))
    kit = moved.where("is_drum").withColumn("_r", rank).where("_r = 1").drop("_r")
    out = moved.where(~F.col("is_drum")).unionByName(kit)
    return out.withColumns({"start_s": F.col("_on"), "end_s": F.col("_off")}).drop("_on", "_off", "latency")


def warp(notes: DataFrame, grids: DataFrame) -> DataFrame:
    """Notes with starts and ends in pulses of their song's grid; pulse 0 is the first at or after time
    0 less one, so ``base`` is the anchor's place."""
    p = 60.0 / F.col("bpm")
    base = F.ceil(F.col("anchor") / p)
    joined = notes.join(grids.select("song_id", "bpm", "anchor"), "song_id")
    return joined.withColumns({"start_s": (F.col("start_s") - F.col("anchor")) / p + base, "end_s": (F.col("end_s") - F.col("anchor")) / p + base, "base": base}).drop("bpm", "anchor")


def apply(notes: DataFrame, bpm: float | DataFrame | None = None, groups: tuple[int, ...] = (1, 1, 1, 1), den: int = 4, mode: str = "constant", downbeat: int | None = None, shift_pulses: int = 0,
          snap_notes: bool = True, fixed_pulse: bool = False, audio: DataFrame | None = None, hop: float = 0.003) -> tuple[DataFrame, DataFrame]:
    """The whole grid stage for songs near a tempo, one for all or one for each (song_id, bpm), searched
    for where none is given: (info, notes).

    Per song: the grid in the meter's pulse (``bpm`` itself if ``fixed_pulse``), bar one from the harmony
    (or ``downbeat`` from 1), moved by ``shift_pulses``; per track: its latency; notes snapped unless
    ``snap_notes`` is false. ``mode`` map follows a tempo map instead, of the kit where there is one; auto
    does so where no constant grid fits, or its track is off it and a map, fitted on every other note,
    is clearly nearer to the rest. audio(song_id, track, frame, v) is the onset strength of each track's
    own sound, z-scored, a frame every ``hop`` seconds: tracks that line up with theirs, as the grid's
    own track does, have their latency told apart beyond half a sixteenth.

    Notes are warped to pulses, where every song has one and the same grid, so each step is one job over
    all songs. Songs without a fit keep their notes and have ``fitted`` false; ``warnings`` says what to
    look at. What is read several times is written to checkpoints if the session has a folder for
    them, else cached; ``release`` gives the cache back.
    """
    found = fit_songs(notes, bpm, groups, den, mode, downbeat, shift_pulses, snap_notes, fixed_pulse, audio, hop)
    return found.info, found.notes


@dataclass(frozen=True)
class Fitted:
    """Songs on their grids: the report, the notes, and the pulses (song_id, k, t) of those that follow a map."""

    info: DataFrame
    notes: DataFrame
    beats: DataFrame | None
    pulses: int
    den: int

    def stamps(self, resolution: int = RESOLUTION) -> DataFrame:
        """Tempo changes (song_id, tick, qpm) that put bar lines on the grid and move no note: a pickup bar,
        then the grid's tempo, or one change for each pulse of a map. Songs without a fit have none."""
        from . import tempo_map as P

        known = self.info.where("fitted")
        out = P.stamp_constant(known.where("tempo = 'constant'").select("song_id", "bpm", F.col("first_bar").alias("anchor")), self.pulses, self.den, resolution)
        out = out.select("song_id", F.col("tick").cast("long").alias("tick"), "qpm")
        if self.beats is None:
            return out
        each = self.beats.join(known.where("tempo = 'map'").select("song_id", F.col("bar_one").alias("_one")), "song_id")
        return out.unionByName(P.stamp_map(each, self.pulses, self.den, F.col("_one"), resolution))


def fit_songs(notes: DataFrame, bpm: float | DataFrame | None = None, groups: tuple[int, ...] = (1, 1, 1, 1), den: int = 4, mode: str = "constant", downbeat: int | None = None, shift_pulses: int = 0,
              snap_notes: bool = True, fixed_pulse: bool = False, audio: DataFrame | None = None, hop: float = 0.003) -> Fitted:
    """``apply`` with what a file needs besides."""
    from . import signal as A
    from . import tempo_map as P

    pulses = sum(groups)
    onsets = hold(onset_dedupe(notes))
    if bpm is None:
        bpm = hold(search(onsets))
    found = hold(fit_pulse(onsets, bpm, den, fixed=fixed_pulse, min_alignment=0.0 if mode == "map" else MIN_ALIGNMENT))
    songs = notes.select("song_id").distinct()
    flat = warp(notes, found)
    measured = songs.select("song_id", F.lit(None).cast("double").alias("constant_offset"), F.lit(None).cast("double").alias("map_gain"), F.lit(mode == "map").alias("follows"))
    mapped = None
    if mode != "constant":
        tried = found if mode == "map" else hold(fit_pulse(onsets, bpm, den, fixed=fixed_pulse, min_alignment=0.0))
        followed = notes.join(map_source(notes, onsets, bpm), TRACK, "left_semi")
        beats = hold(P.fit_map(followed, notes, tried))
        if mode == "auto":
            own = notes.join(found.select(*TRACK, "bpm", "anchor"), TRACK)
            six = 15.0 / F.col("bpm")
            constant = own.groupBy("song_id").agg(F.avg(F.abs(signed(F.col("start_s"), F.col("anchor"), six) / six)).alias("constant_offset"))
            gain = P.map_gain(followed, notes, found).select("song_id", F.col("gain").alias("map_gain"))
            measured = songs.join(constant, "song_id", "left").join(gain, "song_id", "left").withColumn("follows", use_map(F.col("constant_offset"), F.col("map_gain")))
        measured = hold(measured)
        mapped = hold(beats.join(measured.where("follows").select("song_id"), "song_id", "left_semi"))
        chosen = mapped.select("song_id").distinct()
        inside = notes.join(chosen, "song_id", "left_semi")
        at = lambda c: P.position(inside, mapped, c, c + "_p").select(*TRACK, "note_id", c + "_p")
        placed = inside.join(at("start_s"), [*TRACK, "note_id"]).join(at("end_s"), [*TRACK, "note_id"]).withColumns({"start_s": F.col("start_s_p"), "end_s": F.col("end_s_p"), "base": F.lit(0).cast("long")}).drop("start_s_p", "end_s_p")
        flat = flat.join(chosen, "song_id", "left_anti").unionByName(placed)
        known = tried.join(chosen, "song_id", "left_semi").join(found.select("song_id"), "song_id", "left_anti")
        found = hold(found.unionByName(known))
    flat = hold(flat)
    phase = bar_phase(flat, 60.0, 0.0, groups).select("song_id", F.col("phase").alias("bar_one"), "confidence")
    one = F.lit(downbeat - 1) if downbeat else F.col("bar_one")
    late = latency(flat, 60.0, 0.0)
    lags = None
    if audio is not None:
        lags = hold(A.audio_lag(onsets, audio, hop).where(F.col("score") >= LAG_MIN_SCORE).select(*TRACK, "lag"))
        lead = lags.join(found.select(*TRACK, "bpm"), TRACK).select("song_id", F.col("lag").alias("_lead"), "bpm")
        hinted = lags.join(lead, "song_id").select(*TRACK, ((F.col("lag") - F.col("_lead")) * F.col("bpm") / 60).alias("hint"))
        late = late.join(hinted, TRACK, "left").withColumn("latency", F.col("latency") + F.coalesce(F.rint((F.col("hint") - F.col("latency")) / 0.25) * 0.25, F.lit(0.0))).drop("hint")
    late = hold(late)
    fitted = fit_ms(flat, late, 60.0, 0.0).withColumnRenamed("grid_fit_ms", "_fit")
    tempo = found.select("song_id", "bpm", "anchor", "r", F.col("track").alias("source_track"))
    has = mapped.select("song_id").distinct() if mapped is not None else None
    back = notes
    if snap_notes:
        snapped = snap(flat, late, 60.0, 0.0)
        seconds = lambda c: F.greatest(F.lit(0.0), F.col("anchor") + (F.col(c) - F.col("base")) * 60.0 / F.col("bpm"))
        back = snapped.join(tempo.drop("source_track"), "song_id").withColumns({c: seconds(c) for c in ("start_s", "end_s")}).drop("bpm", "anchor", "r", "base", "step")
        if has is not None:
            timed = P.time_at(P.time_at(snapped.join(has, "song_id", "left_semi"), mapped, "start_s", "_on"), mapped, "end_s", "_off").withColumns({"start_s": F.greatest(F.lit(0.0), "_on"), "end_s": F.col("_off")}).drop("_on", "_off", "base", "step")
            back = back.join(has, "song_id", "left_anti").unionByName(timed)
        back = back.unionByName(notes.join(found.select("song_id"), "song_id", "left_anti"))
    kind = songs.withColumn("tempo", F.lit("constant")) if has is None else songs.join(has.withColumn("m", F.lit(True)), "song_id", "left").select("song_id", F.when(F.col("m"), "map").otherwise("constant").alias("tempo"))
    base = flat.groupBy("song_id").agg(F.min("base").alias("base"))
    info = kind.join(tempo, "song_id", "left").join(phase, "song_id", "left").join(base, "song_id", "left").join(measured.drop("follows"), "song_id", "left")
    bar = F.pmod(one + F.lit(shift_pulses), F.lit(pulses))
    first = F.when(F.col("tempo") == "constant", over(F.col("anchor") + (bar - F.col("base")) * 60.0 / F.col("bpm"), pulses * 60.0 / F.col("bpm")))
    each = late.join(fitted, TRACK).join(tempo, "song_id")
    each = each.join(lags, TRACK, "left") if lags is not None else each.withColumn("lag", F.lit(None).cast("double"))
    row = F.struct("track", F.round(F.col("latency") * 60000 / F.col("bpm"), 2).alias("latency_ms"), F.round(F.col("_fit") * 60 / F.col("bpm"), 2).alias("grid_fit_ms"), F.round(F.col("lag") * 1000, 1).alias("audio_lag_ms"))
    tracks = each.groupBy("song_id").agg(F.array_sort(F.collect_list(row)).alias("tracks"), F.max(F.when(F.col("track") == F.col("source_track"), F.col("lag"))).alias("source_lag"))
    unsure = (F.col("confidence") < PHASE_WARN) & F.lit(downbeat is None and pulses > 1)
    warnings = F.filter(F.array(
        F.when(F.col("r").isNull(), "no track sits on a steady grid: nothing was moved"),
        F.when(unsure, F.format_string("bar one is a guess of low confidence (%.2f)", F.col("confidence"))),
        F.when(F.abs(F.col("source_lag")) >= SOURCE_LAG_WARN, F.format_string("the notes of %s run %+.0f ms from their sound", F.col("source_track"), F.col("source_lag") * 1000)),
    ), lambda w: w.isNotNull())
    out = info.join(tracks, "song_id", "left").select("song_id", F.col("r").isNotNull().alias("fitted"), "tempo", "bpm", bar.cast("int").alias("bar_one"), first.alias("first_bar"), "confidence", "source_track", "constant_offset", "map_gain", "tracks", warnings.alias("warnings"))
    return Fitted(out, back, mapped, pulses, den)
