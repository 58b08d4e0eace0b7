"""The append-only event log of runs: replay, latest parts, and the same as streams.

A file of events is written once and never changed; ``seq`` is an event's offset in its job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measure import onset_dedupe

EVENTS = "job_id string, seq long, stage string, message string, part string, notes long"
ENDED = ("done", "error")


def replay(events: DataFrame, since: int = 0) -> DataFrame:
    """Events from an offset on, each once however often it was delivered, up to the job's end."""
    once = events.where(F.col("seq") >= since).dropDuplicates(["job_id", "seq"])
    end = events.where(F.col("stage").isin(*ENDED)).groupBy("job_id").agg(F.min("seq").alias("_end"))
    return once.join(end, "job_id", "left").where("_end is null OR seq <= _end").drop("_end")


def parts_latest(events: DataFrame) -> DataFrame:
    """The last version of each part: a part that is emitted again replaces the one before."""
    return events.where("part is not null").groupBy("job_id", "part").agg(F.max_by(F.struct("seq", "notes"), "seq").alias("e")).select("job_id", "part", "e.seq", "e.notes")


def job_status(events: DataFrame) -> DataFrame:
    """The last stage of each job and whether it ended."""
    last = events.groupBy("job_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))
    return last.withColumn("finished", F.col("stage").isin(*ENDED))


def lookahead(events: DataFrame, now: float, ahead: float = 0.2, time: str = "start_s") -> DataFrame:
    """What starts in [now, now + ahead)."""
    return events.where((F.col(time) >= now) & (F.col(time) < now + ahead))


def throttle(events: DataFrame, gap: float = 0.4) -> DataFrame:
    """events(song_id, track, note_id, start_s) -> those at least ``gap`` seconds after the last one shown."""
    return onset_dedupe(events, gap - 1e-9)


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_latest(spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int | None = None):
    """A query that writes the latest parts of each batch to ``out``; ``latest`` reads them. A batch that
    is run again replaces what it wrote, and no state is kept, on the driver or elsewhere."""

    def keep(batch: DataFrame, number: int) -> None:
        parts_latest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return read_stream(spark, path, max_files).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The latest part of each over all batches written so far."""
    return parts_latest(spark.read.parquet(out))


def stream_replay(spark: SparkSession, path: str, out: str, checkpoint: str, again: str = "1 day"):
    """Appends each event once to ``out``: what is delivered again within ``again`` (by the time of its
    file) is dropped. Keys older than that are forgotten, so the state stays bounded."""
    arrived = read_stream(spark, path).withColumn("_arrived", F.col("_metadata.file_modification_time")).withWatermark("_arrived", again)
    once = arrived.dropDuplicatesWithinWatermark(["job_id", "seq"]).drop("_arrived")
    return once.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
