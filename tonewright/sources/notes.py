"""Note tables over the ``events`` table, and the same as SQL for DuckDB.

A song is ten users' events, a track one type of event; the type ``click`` is the drum kit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sixteenth at 114 beats a minute: the grid planted in ``gridded``.
SIX = 60 / 114 / 4
ANCHOR, BPM = 0.8, 114.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e10D")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("song_id"),
        F.col("event_type").alias("track"),
        F.col("event_id").alias("note_id"),
        (36 + F.get_json_object("props", "$.k").cast("int") % 48).cast("int").alias("pitch"),
        (1 + (F.col("event_id") * 31) % 127).cast("int").alias("velocity"),
        start.alias("start_s"),
        (start + F.col("value") / F.lit(100.0)).alias("end_s"),
        (F.col("event_type") == "click").alias("is_drum"),
        F.lit(0).alias("program"),
    )


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts moved to the planted grid, a few milliseconds off by velocity; ends move along."""
    new = F.lit(ANCHOR) + F.rint(F.col("start_s") / F.lit(SIX)) * F.lit(SIX) + (F.col("velocity") % 5 - 2) / F.lit(1000.0)
    return notes(spark, sf_dir).withColumn("_new", new).withColumns({"end_s": F.col("_new") + (F.col("end_s") - F.col("start_s")), "start_s": F.col("_new")}).drop("_new")


def frozen(spark: SparkSession, path: str) -> DataFrame:
    """Notes of songs frozen as JSON, a file each: {"parts": [{"name", "drum", "notes": [[start, end, pitch,
    velocity], ...]}]} -> path, part, track, is_drum, place, pitch, velocity, start_s, end_s."""
    schema = "parts array<struct<name:string,drum:boolean,notes:array<array<double>>>>"
    songs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    parts = songs.select("path", F.posexplode("parts").alias("part", "p"))
    rows = parts.select("path", "part", F.col("p.name").alias("track"), F.coalesce("p.drum", F.lit(False)).alias("is_drum"), F.posexplode("p.notes").alias("place", "n"))
    at = lambda k: F.get("n", F.lit(k))
    return rows.select("path", "part", "track", "is_drum", "place", at(2).cast("int").alias("pitch"), at(3).cast("int").alias("velocity"), at(0).alias("start_s"), at(1).alias("end_s"))


NOTES_SQL = """SELECT user_id % 10 AS song_id, event_type AS track, event_id AS note_id, CAST(36 + CAST(json_extract_string(props, '$.k') AS INT) % 48 AS INT) AS pitch,
 CAST(1 + (event_id * 31) % 127 AS INT) AS velocity, date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) / 1e10::double AS start_s,
 date_diff('microsecond', timestamp '2024-01-01 00:00:00', ts) / 1e10::double + value / 100::double AS end_s, event_type = 'click' AS is_drum, 0 AS program FROM events"""
GRIDDED_SQL = f"""SELECT * EXCLUDE (start_s, end_s, fresh), fresh AS start_s, fresh + (end_s - start_s) AS end_s FROM
 (SELECT *, {ANCHOR}::double + round_even(start_s / {SIX!r}::double, 0) * {SIX!r}::double + (velocity % 5 - 2) / 1000::double AS fresh FROM ({NOTES_SQL}))"""
