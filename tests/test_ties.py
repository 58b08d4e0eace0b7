"""Tracks that fit a grid equally well: the first by name is the song's own."""

from pyspark.sql import functions as F

from tonewright.operators import grid as G
from tonewright.plans import grid_queries


def equal_tracks(spark, songs=4):
    """Tracks c, b, a and d with the same onsets, listed in other orders, as tables repeated many times have them."""
    o = spark.range(songs * 4 * 200).select((F.col("id") % songs).alias("song_id"), F.element_at(F.array(*[F.lit(x) for x in "cbad"]), (F.floor(F.col("id") / songs) % 4 + 1).cast("int")).alias("track"), F.floor(F.col("id") / (songs * 4)).alias("k"))
    t = 0.8 + F.col("k") * F.lit(15 / 114) + (F.col("k") % 5 - 2) / F.lit(1000.0)
    return o.withColumn("t", t).repartition(7, F.xxhash64("song_id", "track", "k")).select("song_id", "track", "t")


def test_first_of_equal_tracks(spark):
    onsets = equal_tracks(spark)
    for got in (G.fit_tracks(onsets, 112.0), G.fit_pulse(onsets, 112.0, den=8)):
        assert {(r["song_id"], r["track"]) for r in got.collect()} == {(s, "a") for s in range(4)}
    G.release()


def test_first_of_equal_kits(spark):
    onsets = equal_tracks(spark)
    notes = onsets.select("song_id", "track", F.col("track").isin("b", "c").alias("is_drum"))
    assert {(r["song_id"], r["track"]) for r in G.map_source(notes, onsets, 112.0).collect()} == {(s, "b") for s in range(4)}


def test_nearly_equal_tracks_are_told_apart(spark):
    """A track that is better by less than 1e-9 is the song's own, as in the SQL; the last bits don't count."""
    rows = [(0, "a", 114.0, 0.8, 0.9999, 100), (0, "b", 114.0, 0.8, 0.9999 + 5e-10, 100), (1, "a", 114.0, 0.8, 0.9999, 100), (1, "b", 114.0, 0.8, 0.9999 + 1e-13, 100)]
    got = G.best_track(spark.createDataFrame(rows, "song_id long, track string, bpm double, anchor double, r double, n long")).collect()
    assert {r["song_id"]: r["track"] for r in got} == {0: "b", 1: "a"}


def test_confidence_is_rounded_twice(spark):
    """The SQL rounds to five digits, then to four."""
    got = spark.createDataFrame([(0.0907472945760798,), (0.0907181685,), (0.1,)], "c double").select(grid_queries.twice("c")).collect()
    assert [r[0] for r in got] == [0.0908, 0.0907, 0.1]
