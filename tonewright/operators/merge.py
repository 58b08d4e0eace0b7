"""Parts, stems and tracks: planning, mapping, merging, shifting and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DRUM_TO_GM, PITCHED_STEMS, SILENT_RMS, TRACK, TRACK_ORDER, TRACK_SPEC, UNPITCHED_STEMS


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def track_name(stem: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({k: v[0] for k, v in TRACK_SPEC.items()}), stem), stem)


def track_program(stem: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({k: v[1] for k, v in TRACK_SPEC.items()}), stem), F.lit(0))


def play_program(name: Column) -> Column:
    """The program a part is played on: a voice becomes a flute, unknown parts a piano."""
    programs = {part: 73 if program == 53 else program for part, program in TRACK_SPEC.values()}
    return F.coalesce(F.try_element_at(_map(programs), name), F.lit(0))


def part_rank(name: Column) -> Column:
    """Known parts in score order; unknown ones after them, before the drums."""
    place = F.array_position(F.array(*[F.lit(x) for x in TRACK_ORDER]), name) - 1
    return F.when(place >= 0, place.cast("double")).otherwise(F.lit(TRACK_ORDER.index("drums") - 0.5))


def gm_drum(pitch: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(DRUM_TO_GM), pitch), pitch)


def drum_family(pitch: Column) -> Column:
    return (
        F.when(pitch.isin(35, 36), "kick").when(pitch.between(37, 40), "snare").when(pitch.isin(42, 44, 46), "hihat")
        .when(pitch.isin(41, 43, 45, 47, 48, 50), "tom").when(pitch.isin(49, 52, 55, 57), "crash").when(pitch.isin(51, 53, 59), "ride").otherwise("other")
    )


def plan_stems(stems: DataFrame, vocals: bool = True, drums: bool = True, drums_available: bool = True) -> DataFrame:
    """What is done with each stem of a song (pitched, drums, skipped, unknown), in order, and why not."""
    order = F.array_position(F.array(*[F.lit(x) for x in PITCHED_STEMS]), F.col("stem"))
    pitched = (order > 0) & (F.lit(vocals) | (F.col("stem") != "vocals"))
    unpitched = F.col("stem").isin(*UNPITCHED_STEMS)
    why = "drums are off" if not drums else "the drum backend is not installed"
    job = F.when(pitched, "pitched").when(unpitched & F.lit(drums and drums_available), "drums").when(unpitched, "skipped").otherwise("ignored")
    return stems.select("song_id", "stem").distinct().withColumn("job", job).withColumn("place", F.when(F.col("job") == "pitched", order.cast("int"))).withColumn("warning", F.when(F.col("job") == "skipped", F.concat(F.lit("stem '"), "stem", F.lit(f"' skipped: {why}"))))


def merge_tracks(stem_notes: DataFrame) -> DataFrame:
    """Stems as tracks of one song, in part order, notes by start and pitch: track, program, place."""
    named = stem_notes.withColumns({"program": track_program(F.col("track")), "track": track_name(F.col("track"))})
    place = Window.partitionBy("song_id", "track").orderBy("start_s", "pitch", "note_id")
    return named.withColumn("place", F.row_number().over(place)).withColumn("rank", part_rank(F.col("track")))


def track_index(tracks: DataFrame) -> DataFrame:
    """Place of each track in its song: by part rank, then by order of arrival."""
    return tracks.withColumn("track_index", (F.row_number().over(Window.partitionBy("song_id").orderBy(part_rank(F.col("track")), "arrival", "track")) - 1).cast("int"))


def assign_channels(tracks: DataFrame) -> DataFrame:
    """MIDI channels in track order: drums on 9, the others around it, modulo 16."""
    pitched = F.sum(F.when(F.col("is_drum"), 0).otherwise(1)).over(Window.partitionBy("song_id").orderBy("track_index").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return tracks.withColumn("_k", pitched % 15).withColumn("channel", F.when(F.col("is_drum"), 9).otherwise(F.when(F.col("_k") >= 9, F.col("_k") + 1).otherwise(F.col("_k"))).cast("int")).drop("_k")


def shift(notes: DataFrame, offset: Column) -> DataFrame:
    return notes.withColumns({"start_s": F.col("start_s") + offset, "end_s": F.col("end_s") + offset})


def clip(notes: DataFrame, duration: float) -> DataFrame:
    """Notes within [0, duration], cut at its ends."""
    return notes.where((F.col("end_s") > 0) & (F.col("start_s") < duration)).withColumns({"start_s": F.greatest("start_s", F.lit(0.0)), "end_s": F.least("end_s", F.lit(duration))})


def section(notes: DataFrame, begin: float, end: float) -> DataFrame:
    """Notes that start in [begin, end), with times from its begin."""
    return shift(notes.where((F.col("start_s") >= begin) & (F.col("start_s") < end)), F.lit(-begin))


def is_sparse(n: Column, seconds: Column, bpm: float | Column, rms: Column, beats_per_bar: float = 4.0) -> Column:
    """Sound, eight bars or more, and under one note for four bars."""
    bars = seconds * (bpm if isinstance(bpm, Column) else F.lit(bpm)) / F.lit(60.0 * beats_per_bar)
    return (rms > SILENT_RMS) & (bars >= 8) & (n < bars / 4)


def silent(n: Column, rms: Column) -> Column:
    """A warning for a track without notes whose stem is silent."""
    return F.when((n == 0) & (rms <= SILENT_RMS), F.format_string("silent at %.1f dBFS", 20 * F.log10(F.greatest(rms, F.lit(1e-12)))))


def fallback_merge(notes: DataFrame, fallback: DataFrame, replaced: DataFrame) -> DataFrame:
    """Notes of the tracks in ``replaced`` come from the fallback."""
    return notes.join(replaced, TRACK, "left_anti").unionByName(fallback.join(replaced, TRACK, "left_semi"))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Equal hits (time, class, velocity) once, then General MIDI drums and velocities of 1 to 127."""
    once = hits.select(*TRACK, "start_s", "pitch", "velocity").distinct()
    return once.select(*TRACK, "start_s", gm_drum(F.col("pitch")).alias("pitch"), F.least(F.greatest("velocity", F.lit(1)), F.lit(127)).alias("velocity"))


def validate_notes(notes: DataFrame, least: float = 0.01) -> DataFrame:
    """Notes without start go; a missing, inverted or too short end becomes start plus 10 ms."""
    a, b = F.col("start_s"), F.col("end_s")
    end = F.when(b.isNull(), a + F.lit(least)).when(a > b, F.greatest(b, a + F.lit(least))).when(~F.col("is_drum") & (b - a < 0.01), a + F.lit(least)).otherwise(b)
    return notes.where(a.isNotNull()).withColumn("end_s", end)


def trim_overlapping(notes: DataFrame) -> DataFrame:
    """A note ends where the same program, pitch and kit sounds again; emptied notes go."""
    again = F.lead("start_s").over(Window.partitionBy("song_id", "program", "pitch", "is_drum").orderBy("start_s", "note_id"))
    return notes.withColumn("end_s", F.least("end_s", F.coalesce(again, F.col("end_s")))).where("start_s < end_s")


def in_event_order(notes: DataFrame) -> DataFrame:
    """Adds ``place``: a note's place (from 0) among its song's, as a transcription model's list has them:
    by start, then pitched ones before drums, by program and by pitch; ties as they came."""
    order = Window.partitionBy("song_id").orderBy("start_s", "is_drum", "program", "pitch", "track", "note_id")
    return notes.withColumn("place", F.row_number().over(order).cast("long") - 1)
