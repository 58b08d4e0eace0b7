"""Notes from the tokens of a transcription model that writes a song in chunks, with notes tied over
their seams.

A chunk begins with a prologue: programs and pitches of the notes that sound on, closed by ``tie``. Then
come times (``shift``, in frames from the chunk's begin), programs, velocities and pitches; a pitch with
velocity 0 ends its note. A prologue that a ``shift`` ends ties nothing, and its chunk is passed over.

No state machine walks the tokens: what holds at a token (program, velocity, time) is the last one of its
kind before it, a window; a note ends at its key's next event or at the first seam its key isn't tied
over, the end of a run of ties. So a song of any length is windows over keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FRAME_RATE, LEAST_NOTE, TRACK

EVENTS = "song_id long, track string, chunk long, seek double, next_seek double, i long, type string, value int"


def tracked_notes(events: DataFrame) -> DataFrame:
    """events(EVENTS), next_seek null for a song's last chunk -> song_id, track, program, pitch, is_drum,
    start_s, end_s. What begins at or after the next chunk's begin is that chunk's to tell."""
    chunk = Window.partitionBy(*TRACK, "chunk").orderBy("i")
    before, whole = chunk.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*TRACK, "chunk")
    last = lambda kind, when=F.lit(True): F.last(F.when((F.col("type") == kind) & when, F.col("value")), True).over(before)
    closing = F.min(F.when(F.col("type").isin("tie", "shift"), F.struct("i", "type"))).over(whole)
    e = events.withColumn("_close", closing).withColumn("_body", F.coalesce((F.col("_close.type") == "tie") & (F.col("i") > F.col("_close.i")), F.lit(False)))
    body = F.col("_body")
    e = e.withColumns({
        "_program": last("program"), "_velocity": last("velocity", body),
        "_t": (F.rint(F.col("seek") * FRAME_RATE) + F.coalesce(last("shift", body & (F.col("value") > 0)), F.lit(0))) / F.lit(float(FRAME_RATE)),
    })
    inside = F.col("next_seek").isNull() | (F.col("_t") < F.col("next_seek"))
    hits = e.where(body & (F.col("type") == "drum") & inside).select(*TRACK, F.lit(128).alias("program"), F.col("value").alias("pitch"), F.lit(True).alias("is_drum"), F.col("_t").alias("start_s"), (F.col("_t") + LEAST_NOTE).alias("end_s"))

    key = [*TRACK, "_program", "value"]
    said = e.where(body & (F.col("type") == "pitch") & F.col("_program").isNotNull() & F.col("_velocity").isNotNull() & inside)
    order = Window.partitionBy(*key).orderBy("chunk", "i")
    said = said.select(*key, "chunk", "i", F.col("_t").alias("start_s"), (F.col("_velocity") > 0).alias("_on")).withColumn("_next", F.lead("start_s").over(order)).where("_on")
    # Runs of chunks that tie a key, and where they end.
    tied = e.where((F.col("type") == "pitch") & (F.col("_close.type") == "tie") & (F.col("i") < F.col("_close.i")) & F.col("_program").isNotNull()).select(*key, "chunk").distinct()
    run = tied.withColumn("_run", F.col("chunk") - F.row_number().over(Window.partitionBy(*key).orderBy("chunk")))
    run = run.withColumn("_last", F.max("chunk").over(Window.partitionBy(*key, "_run"))).select(*[F.col(c).alias("_k_" + c) for c in key], (F.col("chunk") - 1).alias("_from"), F.col("_last"))
    same = [F.col(c).eqNullSafe(F.col("_k_" + c)) for c in key]
    held = said.join(run, [*same, F.col("chunk") == F.col("_from")], "left").withColumn("_cut", F.coalesce("_last", "chunk") + 1)
    seams = events.groupBy(*[F.col(c).alias("_s_" + c) for c in TRACK], F.col("chunk").alias("_seam")).agg(F.min("seek").alias("_seek"))
    held = held.join(seams, [*[F.col(c).eqNullSafe(F.col("_s_" + c)) for c in TRACK], F.col("_cut") == F.col("_seam")], "left")
    end = F.coalesce(F.least("_next", "_seek"), F.col("start_s") + LEAST_NOTE)
    return held.select(*TRACK, F.col("_program").alias("program"), F.col("value").alias("pitch"), F.lit(False).alias("is_drum"), "start_s", end.alias("end_s")).unionByName(hits)
