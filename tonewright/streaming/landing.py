"""Songs that land in a folder as MIDI files: their parts as they come, and what couldn't be read.

Each batch of files is one job. A file that is broken becomes a row of the failures and sinks nothing else.
A batch writes to folders of its own number, so one that is run again replaces what it wrote. Files
without a byte are passed over by Spark itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import midi

FILES = "path string, modificationTime timestamp, length long, content binary"
READ = midi.SCHEMA + ", error string"


def read_files(files: DataFrame) -> DataFrame:
    """Rows of ``midi.SCHEMA`` of files (path, content); one with ``error`` alone for a file that can't be read."""
    names = [c.split()[0] for c in READ.split(", ")]

    def parsed(frames):
        for frame in frames:
            out = []
            for path, data in zip(frame["path"], frame["content"]):
                try:
                    if not any(kind == b"MTrk" for kind, _ in midi.chunks(bytes(data))):
                        raise ValueError("no tracks")
                    out += [(*row, None) for row in midi.rows(path, bytes(data))]
                except Exception as e:  # noqa: BLE001  whatever is wrong with it, it is this file's
                    out.append((path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(parsed, READ)


def land(spark: SparkSession, folder: str, out: str, checkpoint: str, on_part: Callable[[DataFrame], None] | None = None, max_files: int | None = None):
    """A query that reads new files of ``folder`` and writes notes by part to out/notes and errors to
    out/failures; ``on_part`` gets (path, track, is_drum, notes) of each batch's parts, once they are written."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.mid*")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def work(batch: DataFrame, number: int) -> None:
        both = f"{out}/_read/batch={number}"
        read_files(batch).write.mode("overwrite").parquet(both)
        rows = batch.sparkSession.read.schema(READ).parquet(both)
        rows.where("error IS NULL").drop("error").write.mode("overwrite").partitionBy("track").parquet(f"{out}/notes/batch={number}")
        rows.where("error IS NOT NULL").select("path", "error").write.mode("overwrite").parquet(f"{out}/failures/batch={number}")
        if on_part is not None:
            on_part(rows.where("error IS NULL").groupBy("path", "track", "is_drum").agg(F.count("*").alias("notes")))

    return reader.load(folder).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(midi.SCHEMA + ", batch int").parquet(f"{out}/notes")


def failures(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("path string, error string, batch int").parquet(f"{out}/failures")
