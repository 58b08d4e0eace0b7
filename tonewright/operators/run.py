"""A whole run as one job: stems' notes in, cleaned tracks on a grid and files out, for any number of songs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import backends
from ..schema import DEFAULT_TEMPO, RESOLUTION, TRACK, CleanupParams
from . import cleanup, grid, merge


@dataclass(frozen=True)
class Run:
    """What a run gives: notes by track, the grid's report (None without a grid), tempi, and warnings."""

    notes: DataFrame
    info: DataFrame | None
    tempo: DataFrame
    warnings: DataFrame
    held: list[DataFrame] = field(default_factory=list)
    fitted: grid.Fitted | None = None

    def release(self) -> None:
        """Gives back what the run keeps in memory; its tables are computed anew if they are read again."""
        grid.free(self.held)

    def stamps(self) -> DataFrame:
        """(song_id, tick, qpm): the tempo changes of each song's grid or map; one tempo where none was fitted."""
        flat = self.tempo.select("song_id", F.lit(0).cast("long").alias("tick"), F.col("bpm").alias("qpm"))
        if self.fitted is None:
            return flat
        known = self.fitted.stamps()
        return known.unionByName(flat.join(known.select("song_id").distinct(), "song_id", "left_anti"))

    def files(self) -> DataFrame:
        """(song_id, midi): a file for each song, with bar lines on its grid."""
        from ..sources import midi

        meter = (self.fitted.pulses, self.fitted.den) if self.fitted else (4, 4)
        return midi.to_files(self.notes, stamps=self.stamps(), division=RESOLUTION, meter=meter)


def process(notes: DataFrame, stems: DataFrame | None = None, fallback: DataFrame | None = None, tempo: float | DataFrame | None = None, params: CleanupParams | None = CleanupParams(), mono_stems: tuple[str, ...] = (),
            fit_grid: bool = True, snap: bool = False, groups: tuple[int, ...] = (1, 1, 1, 1), den: int = 4, mode: str = "auto", downbeat: int | None = None, audio: DataFrame | None = None, hop: float = 0.003) -> Run:
    """notes(song_id, track, ...) with stems' names as tracks -> Run.

    stems(song_id, track, seconds, rms) describe the sound; where a stem sounds and has next to no notes,
    those of ``fallback`` take their place. ``params`` None leaves notes as they are; ``mono_stems`` keep one
    voice. ``tempo`` is found from the notes where none is given (by songs: song_id, bpm); songs in
    which none is found go at the default. The grid is fitted near it, in that pulse if it was given.
    """
    with grid.holding() as held:
        return _process(notes, stems, fallback, tempo, params, mono_stems, fit_grid, snap, groups, den, mode, downbeat, audio, hop, held)


def _process(notes, stems, fallback, tempo, params, mono_stems, fit_grid, snap, groups, den, mode, downbeat, audio, hop, held) -> Run:
    """``process``; the steps measured in beats go at each song's own tempo."""
    songs = notes.select("song_id")
    for more in (stems, fallback):
        songs = songs if more is None else songs.unionByName(more.select("song_id"))
    songs = songs.distinct()
    found = backends.estimate_tempo(notes).select("song_id", "bpm") if tempo is None else tempo
    if isinstance(found, DataFrame):
        songs = songs.join(found.where("bpm > 0").select("song_id", F.col("bpm").cast("double").alias("bpm")), "song_id", "left").withColumn("known", F.col("bpm").isNotNull()).withColumn("bpm", F.coalesce("bpm", F.lit(DEFAULT_TEMPO)))
    else:
        songs = songs.withColumns({"bpm": F.lit(float(found)), "known": F.lit(True)})
    tempi = grid.hold(songs)
    told = [tempi.where("NOT known").select("song_id", F.lit(f"no tempo found: written at {DEFAULT_TEMPO:g} BPM").alias("warning"))]
    tempi = tempi.select("song_id", "bpm")
    if stems is not None:
        counts = grid.hold(stems.join(notes.groupBy(*TRACK).agg(F.count("*").alias("n")), TRACK, "left").na.fill(0, ["n"]).join(tempi, "song_id"))
        say = lambda text: F.concat(F.col("track"), F.lit(": "), text).alias("warning")
        told.append(counts.select("song_id", say(merge.silent(F.col("n"), F.col("rms")))).where("warning is not null"))
        if fallback is not None:
            quarters = sum(groups) * 4 / den
            sparse = counts.where(merge.is_sparse(F.col("n"), F.col("seconds"), F.col("bpm"), F.col("rms"), quarters))
            told.append(sparse.select("song_id", say(F.format_string("only %d notes, taken from the fallback instead", "n"))))
            notes = merge.fallback_merge(notes, fallback, sparse.select(*TRACK))
    if params is not None:
        timed = notes.join(tempi.withColumnRenamed("bpm", "_bpm"), "song_id")
        mono = F.col("track").isin(*mono_stems) if mono_stems else F.lit(False)
        done = cleanup.clean(timed.where(~mono), params, F.col("_bpm"))
        if mono_stems:
            done = done.unionByName(cleanup.clean(timed.where(mono), replace(params, monophonic=True), F.col("_bpm")))
        notes = done.drop("_bpm")
    merged = merge.merge_tracks(notes).drop("place", "rank")
    plain = (tuple(groups), den) == ((1, 1, 1, 1), 4)
    info, out, final, fitted = None, merged, tempi, None
    if fit_grid:
        fitted = grid.fit_songs(merged, tempi, groups, den, mode, downbeat, snap_notes=snap, fixed_pulse=tempo is not None, audio=audio, hop=hop)
        info, out = grid.hold(fitted.info), fitted.notes
        told.append(info.select("song_id", F.explode("warnings").alias("warning")))
        final = tempi.join(info.where("fitted").select("song_id", F.col("bpm").alias("_bpm")), "song_id", "left").select("song_id", F.coalesce("_bpm", "bpm").alias("bpm"))
    elif not plain:
        told.append(tempi.select("song_id", F.lit("the meter needs a grid: no bar lines are written").alias("warning")))
    warnings = told[0]
    for more in told[1:]:
        warnings = warnings.unionByName(more)
    return Run(out, info, final, warnings, held, replace(fitted, info=info) if fitted else None)


def song_keys(notes: DataFrame, *options) -> DataFrame:
    """(song_id, key): a hash of a song's notes, in whatever order, and of options."""
    row = F.struct(*sorted(c for c in notes.columns if c != "song_id"))
    sums = notes.groupBy("song_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias("b"))
    return sums.select("song_id", F.sha2(F.concat_ws("|", "n", "a", "b", F.lit(repr(options))), 256).alias("key"))


def process_new(notes: DataFrame, results, tempo: float | None = None, **options) -> DataFrame:
    """Notes of ``process``, by song from ``results`` (a ``cache.Results``): only songs that are new, or whose
    notes or options are others than before, are worked on."""
    keys = song_keys(notes, tempo, sorted(options.items()))

    def work(missing: DataFrame) -> DataFrame:
        return process(notes.join(missing.select("song_id"), "song_id", "left_semi"), tempo=tempo, **options).notes

    return results.of("process", keys, work)
