"""Measures of a track's notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CHORD_TOL, TRACK

def _length() -> Column:
    return F.col("end_s") - F.col("start_s")


def off_grid(time: Column, step: float | Column) -> Column:
    """Distance to the nearest grid step, in steps (0 to 0.5)."""
    s = F.lit(step) if isinstance(step, float) else step
    off = F.pmod(time, s)
    return F.least(off, s - off) / s


def track_counts(notes: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Notes per track; tracks listed without notes count 0."""
    n = notes.groupBy(*TRACK).agg(F.count("*").alias("n"))
    return n if tracks is None else tracks.join(n, TRACK, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def median_duration(notes: DataFrame) -> DataFrame:
    return notes.groupBy(*TRACK).agg(F.count("*").alias("n"), F.round(F.median(_length()), 4).alias("median_duration"))


def polyphony(notes: DataFrame) -> DataFrame:
    """Mean number of notes sounding over the track's span."""
    a = notes.groupBy(*TRACK).agg(F.sum(_length()).alias("_sum"), (F.max("end_s") - F.min("start_s")).alias("_span"))
    return a.select(*TRACK, F.when(F.col("_span") > 0, F.round(F.col("_sum") / F.col("_span"), 3)).otherwise(0.0).alias("polyphony"))


def silence_ratio(notes: DataFrame) -> DataFrame:
    """Share of the track's span in which nothing sounds: one less the union of its notes."""
    from .cleanup import islands

    isle = islands(notes).groupBy(*TRACK, "island").agg(F.min("start_s").alias("a"), F.max("end_s").alias("b"), F.count("*").alias("n"))
    a = isle.groupBy(*TRACK).agg(F.sum(F.col("b") - F.col("a")).alias("_sounding"), (F.max("b") - F.min("a")).alias("_span"), F.sum("n").alias("_n"))
    return a.select(*TRACK, F.when((F.col("_n") < 2) | (F.col("_span") <= 0), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("_sounding") / F.col("_span")), 4)).alias("silence_ratio"))


def grid_error(notes: DataFrame, step: float = 0.125) -> DataFrame:
    return notes.groupBy(*TRACK).agg(F.round(F.avg(off_grid(F.col("start_s"), step)), 4).alias("grid_error"))


def quantization_error(notes: DataFrame, tempo: float = 120.0, division: int = 4, den: int = 4) -> DataFrame:
    """Distance to the grid that divides the meter's pulse: grid, n, mean and median."""
    step = 60.0 / tempo * 4 / den / division
    e = off_grid(F.col("start_s"), step)
    return notes.groupBy(*TRACK).agg(F.lit(f"1/{division * den}").alias("grid"), F.count("*").alias("n"), F.round(F.avg(e), 4).alias("mean"), F.round(F.median(e), 4).alias("median"))


def onset_dedupe(notes: DataFrame, tolerance: float = CHORD_TOL) -> DataFrame:
    """Onsets of each track, one for all that start within the tolerance of the last one kept.

    Whether an onset stays depends on the last kept one, not on its neighbour, so it is a fold.
    Wherever neighbours are further apart than the tolerance it starts afresh; the fold runs
    over such runs only.
    """
    order = Window.partitionBy(*TRACK).orderBy("start_s", "note_id")
    new = F.coalesce(F.col("start_s") - F.lag("start_s").over(order) > F.lit(tolerance), F.lit(True)).cast("int")
    runs = notes.select(*TRACK, "start_s", "note_id").withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy(*TRACK, "_run").agg(F.array_sort(F.collect_list("start_s")).alias("ts"))
    kept = F.expr(f"aggregate(ts, slice(ts, 1, 0), (out, t) -> if(size(out) = 0 OR t - out[size(out) - 1] > {tolerance}D, concat(out, array(t)), out))")
    return folded.select(*TRACK, F.explode(kept).alias("t"))


def notes_per_window(notes: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Notes and their range of pitches in windows of so many seconds."""
    return notes.groupBy(*TRACK, F.floor(F.col("start_s") / F.lit(seconds)).alias("window")).agg(F.count("*").alias("n"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))


def max_note_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest distance between the starts of two versions of a track, in order of time."""
    place = lambda df, name: df.select(*TRACK, F.row_number().over(Window.partitionBy(*TRACK).orderBy("start_s", "note_id")).alias("r"), F.col("start_s").alias(name))
    return place(a, "x").join(place(b, "y"), [*TRACK, "r"]).groupBy(*TRACK).agg(F.round(F.max(F.abs(F.col("x") - F.col("y"))), 6).alias("max_shift"))


def ends(notes: DataFrame) -> DataFrame:
    """Per track: the first start, the last end and how long the whole song is, up to the last end of any track."""
    own = notes.groupBy(*TRACK).agg(F.min("start_s").alias("first_s"), F.max("end_s").alias("last_s"))
    return own.withColumn("duration", F.max("last_s").over(Window.partitionBy("song_id")))


def places(notes: DataFrame, grids: DataFrame) -> DataFrame:
    """Adds ``bar``, ``pulse`` and ``sixteenth``: where a note starts on its song's constant grid, each from 0
    (bars before the anchor are negative), and how many seconds one of them takes. A sixteenth is a quarter of
    a pulse; grids(song_id, bpm in pulses a minute, anchor, pulses of a bar), one row a song."""
    own = grids.select("song_id", *(F.col(c).alias(f"_{c}") for c in ("bpm", "anchor", "pulses")))
    pulse = F.lit(60.0) / F.col("_bpm")
    step = F.floor(F.round((F.col("start_s") - F.col("_anchor")) / (pulse / 4), 6))
    placed = notes.join(own, "song_id").withColumns({"_step": step, "pulse_s": pulse, "bar_s": pulse * F.col("_pulses"), "sixteenth_s": pulse / 4})
    per_bar = F.col("_pulses").cast("long") * 4
    return placed.withColumns({"bar": F.floor(F.col("_step") / per_bar), "pulse": F.floor(F.pmod("_step", per_bar) / 4), "sixteenth": F.pmod(F.col("_step"), F.lit(4))}).drop("_step", "_bpm", "_anchor", "_pulses")
