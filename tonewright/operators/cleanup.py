"""Cleaning of transcribed notes, one function for each step, keyed by song and track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRACK, CleanupParams

def _length() -> Column:
    return F.col("end_s") - F.col("start_s")


def _seconds(beats: float, tempo: float | Column) -> Column:
    return F.lit(beats * 60.0) / tempo if isinstance(tempo, Column) else F.lit(beats * 60.0 / tempo)


def _by(*more: str):
    return Window.partitionBy(*TRACK, *more)


def velocity_floor(notes: DataFrame, floor: int = 15) -> DataFrame:
    return notes.where(F.col("velocity") >= floor) if floor > 0 else notes


def min_duration(notes: DataFrame, least: float = 0.02) -> DataFrame:
    return notes.where(_length() >= least)


def de_overlap(notes: DataFrame) -> DataFrame:
    """A pitch sounds once at a time: a note ends where its pitch starts again."""
    again = F.lead("start_s").over(_by("pitch").orderBy("start_s", "note_id"))
    return notes.withColumn("_again", again).withColumns({"trimmed_de_overlap": F.coalesce(F.col("end_s") > F.col("_again"), F.lit(False)), "end_s": F.least("end_s", F.coalesce("_again", "end_s"))}).drop("_again")


def duration_cap(notes: DataFrame, beats: float = 2.0, tempo: float | Column = 120.0) -> DataFrame:
    """A note longer than so many beats ends at the track's next onset, if that comes first."""
    # From the end on, so that the frame only grows: one that shrinks is added up anew for every row.
    following = F.expr("min(start_s) OVER (PARTITION BY song_id, track ORDER BY start_s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-6D PRECEDING)")
    out = notes.withColumn("_next", following).withColumn("trimmed_duration_cap", F.coalesce((_length() > _seconds(beats, tempo)) & (F.col("_next") < F.col("end_s")), F.lit(False)))
    return out.withColumn("end_s", F.when(F.col("trimmed_duration_cap"), F.col("_next")).otherwise(F.col("end_s"))).drop("_next")


def next_onset_after(notes: DataFrame, time: Column, name: str) -> DataFrame:
    """Adds the track's first onset after ``time``. Onsets and questions are one sorted stream, so
    there is no range join: read from the end, each question takes the last onset above it."""
    asked = notes.withColumns({"_t": time, "_q": F.lit(1)})
    onsets = notes.select(*TRACK, F.col("start_s").alias("_t"), F.lit(0).alias("_q"), F.col("start_s").alias("_onset")).distinct()
    stream = asked.unionByName(onsets, allowMissingColumns=True)
    later = _by().orderBy(F.desc("_t"), F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)
    return stream.withColumn(name, F.last("_onset", ignorenulls=True).over(later)).where("_q = 1").drop("_t", "_q", "_onset")


def legato(notes: DataFrame, gap_beats: float = 0.25, tempo: float | Column = 120.0, joint: float = 0.005) -> DataFrame:
    """Closes gaps of up to so many beats before the next onset, but for a short joint."""
    out = next_onset_after(notes, F.col("end_s") - F.lit(1e-9), "_next").withColumn("_gap", F.col("_next") - F.col("end_s"))
    close = F.coalesce((F.col("_gap") > 0) & (F.col("_gap") <= _seconds(gap_beats, tempo)), F.lit(False))
    return out.withColumn("extended_legato", close).withColumn("end_s", F.when(F.col("extended_legato"), F.col("_next") - F.lit(joint)).otherwise(F.col("end_s"))).drop("_next", "_gap")


def quantize(notes: DataFrame, step: float | Column = 0.125, strength: float = 0.5, keep_duration: bool = True, least: float = 0.02) -> DataFrame:
    """Pulls starts toward the grid by ``strength``; ends move along or to the grid themselves."""
    if not 0 < strength <= 1:
        return notes
    step = step if isinstance(step, Column) else F.lit(step)
    pull = lambda c: (F.rint(F.col(c) / step) * step - F.col(c)) * F.lit(strength)
    out = notes.withColumns({"_d": pull("start_s"), "_e": pull("end_s")}).withColumn("quantized", F.col("_d") != 0)
    end = F.col("end_s") + (F.col("_d") if keep_duration else F.col("_e"))
    out = out.withColumns({"_s": F.when(F.col("quantized"), F.col("start_s") + F.col("_d")).otherwise(F.col("start_s")), "_f": F.when(F.col("quantized"), end).otherwise(F.col("end_s"))})
    guarded = F.when(F.col("quantized") & (F.col("_f") <= F.col("_s")), F.col("_s") + F.lit(least)).otherwise(F.col("_f"))
    return out.withColumns({"end_s": guarded, "start_s": F.col("_s")}).drop("_d", "_e", "_s", "_f")


def monophonic(notes: DataFrame, keep: str = "lowest") -> DataFrame:
    """One voice: a note that overlaps a lower (or higher) note already kept goes.

    The rule looks at survivors, so it is a fold over the sorted notes. Notes that nothing
    overlaps can't influence each other, so the fold runs over islands of sound, which are
    short whatever the length of the track.
    """
    sign = 1 if keep == "lowest" else -1
    isles = islands(notes)
    # By stretches of 128 notes: one list of all would be copied whole for every note that it gains.
    step = """aggregate(slice(all, k * 128 + 1, 128), named_struct('live', s.live, 'ids', transform(slice(all, 1, 0), n -> n.note_id)),
        (a, n) -> if(exists(a.live, m -> m.start_s < n.end_s AND n.start_s < m.end_s AND m.rank < n.rank), a,
            named_struct('live', concat(filter(a.live, m -> m.end_s > n.start_s), array(n)), 'ids', concat(a.ids, array(n.note_id)))))"""
    fold = f"""flatten(aggregate(sequence(0, cast((size(all) - 1) div 128 as int)), named_struct('live', slice(all, 1, 0), 'ids', transform(slice(all, 1, 0), n -> array(n.note_id))),
        (s, k) -> transform(array({step}), x -> named_struct('live', x.live, 'ids', concat(s.ids, array(x.ids))))[0], s -> s.ids))"""
    kept = (
        isles.groupBy(*TRACK, "island")
        .agg(F.array_sort(F.collect_list(F.struct("start_s", (F.col("pitch") * sign).alias("rank"), "note_id", "end_s"))).alias("all"))
        .select(*TRACK, F.explode(F.expr(fold)).alias("note_id"))
    )
    return notes.join(kept, [*TRACK, "note_id"], "left_semi")


def islands(notes: DataFrame) -> DataFrame:
    """Adds ``island``: a new one where a note starts after all before it have ended."""
    order = _by().orderBy("start_s", "note_id")
    reach = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start_s") > reach, F.lit(True)).cast("int")
    return notes.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _limited(notes: DataFrame, p: CleanupParams, tempo: Column | float, step: Column | float) -> DataFrame:
    """The steps before the sweep of short notes."""
    out = velocity_floor(notes, p.velocity_floor)
    if p.monophonic:
        out = monophonic(out, p.mono_keep)
    if p.quantize:
        out = quantize(out, step, p.quantize_strength, p.quantize_keep_duration, p.min_duration)
    if p.de_overlap:
        out = de_overlap(out)
    if p.duration_cap and p.max_duration_beats > 0:
        out = duration_cap(out, p.max_duration_beats, tempo)
    return out


def clean(notes: DataFrame, p: CleanupParams = CleanupParams(), tempo: Column | None = None) -> DataFrame:
    """All steps in their fixed order; trimmed and extended notes carry flags. ``tempo``: a column of the
    notes, quarters a minute, in place of that of the parameters."""
    step = p.step if tempo is None else F.lit(60.0 / p.quantize_division) / tempo
    tempo = p.tempo if tempo is None else tempo
    out = min_duration(_limited(notes, p, tempo, step), p.min_duration)
    if p.legato:
        out = legato(out, p.legato_max_gap_beats, tempo, p.legato_gap)
    return out


def measures(notes: DataFrame, step: float = 0.125) -> DataFrame:
    """Per track: n, median_duration, polyphony, silence_ratio, grid_error."""
    from .measure import grid_error, median_duration, polyphony, silence_ratio

    out = median_duration(notes)
    for more in (polyphony(notes), silence_ratio(notes), grid_error(notes, step)):
        out = out.join(more, TRACK)
    return out


def stats(notes: DataFrame, p: CleanupParams = CleanupParams()) -> DataFrame:
    """Per track: what each step dropped or changed, and the measures before and after.

    Notes before and after stand in one table, those too short flagged: one window tells what
    each adds to the time that sounds, one aggregation gives all columns. Steps that are
    off count nothing.
    """
    from .measure import off_grid

    done = _limited(notes, p, p.tempo, p.step).withColumn("_short", _length() < p.min_duration)
    if p.legato:
        done = legato(done.where(~F.col("_short")), p.legato_max_gap_beats, p.tempo, p.legato_gap).unionByName(done.where("_short"), allowMissingColumns=True)
    flags = ("trimmed_de_overlap", "trimmed_duration_cap")
    flag = lambda df, c: F.coalesce(F.col(c), F.lit(False)).alias(c) if c in df.columns else F.lit(False).alias(c)
    own = [*TRACK, "note_id", "start_s", "end_s", "velocity"]
    none = [F.lit(False).alias(c) for c in flags]
    both = notes.select(*own, F.lit(False).alias("after"), F.lit(False).alias("_short"), *none).union(done.select(*own, F.lit(True), "_short", *(flag(done, c) for c in flags)))
    order = Window.partitionBy(*TRACK, "after").orderBy("start_s", "note_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(~F.col("_short"), F.col("end_s"))).over(order)
    both = both.repartition(*TRACK).withColumn("_adds", F.greatest(F.lit(0.0), F.col("end_s") - F.greatest("start_s", F.coalesce(reach, F.col("start_s")))))

    def measured(name: str, after: bool) -> list[Column]:
        held = (F.col("after") == after) & ~F.col("_short")
        of = lambda c: F.when(held, c)
        span = F.max(of(F.col("end_s"))) - F.min(of(F.col("start_s")))
        columns = {
            "median_duration": F.round(F.median(of(_length())), 4),
            "polyphony": F.when(span > 0, F.round(F.sum(of(_length())) / span, 3)),
            "silence_ratio": F.when((F.count_if(held) > 1) & (span > 0), F.round(F.greatest(F.lit(0.0), 1 - F.sum(of(F.col("_adds"))) / span), 4)),
            "grid_error": F.round(F.avg(of(off_grid(F.col("start_s"), p.step))), 4),
        }
        return [F.count_if(held).alias(f"notes_{name}"), *(F.coalesce(v, F.lit(0.0)).alias(f"{c}_{name}") for c, v in columns.items())]

    told = [F.count_if(~F.col("after") & (F.col("velocity") < p.velocity_floor)).alias("dropped_velocity_floor"), F.count_if("_short").alias("dropped_too_short"), *(F.count_if(c).alias(c) for c in flags)]
    return both.groupBy(*TRACK).agg(*measured("before", False), *measured("after", True), *told)
