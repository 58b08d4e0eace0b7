"""Streams with state against the same rules on whole tables."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tonewright.operators.tokens import EVENTS as TOKENS
from tonewright.operators.tokens import tracked_notes
from tonewright.plans.media_queries import model_events
from tonewright.streaming import event_log, stateful


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    stateful.prepare(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, schema, parts, f, name):
    """All rows of a stream over files, one to a batch, stopped and started again half way."""
    folder = tmp_path / "in"
    query = lambda: f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    half = (len(parts) + 1) // 2
    for some in (parts[:half], parts[half:]):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        query().awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("seed", [1, 2])
def test_notes_of_chunks_in_any_batches(spark, sf, tmp_path, seed):
    """Also a chunk that ties nothing, events at and after the next chunk's begin, drums, and chunks out of order."""
    rng = random.Random(seed)
    given = model_events(spark, sf).where("song_id < 2").withColumn("value", F.when((F.col("type") == "tie") & (F.col("chunk") == 2), 0).otherwise(F.col("value")))
    # Chunks count from 0 without a gap.
    number = F.dense_rank().over(Window.partitionBy("song_id", "track").orderBy("chunk")) - 1
    table = given.withColumn("chunk", number.cast("long")).select(*[c.split()[0] for c in TOKENS.split(", ")])
    rows = [tuple(r) for r in table.collect()]
    for s, t, kinds in ((7, "kit", [("tie", 0), ("drum", 38), ("shift", 20), ("drum", 36), ("program", 4), ("velocity", 90), ("pitch", 60), ("shift", 700), ("drum", 40)]), (7, "kit", [("program", 4), ("pitch", 60), ("shift", 5), ("tie", 0), ("drum", 1)]), (7, "kit", [("program", 4), ("pitch", 60), ("tie", 0), ("velocity", 80), ("shift", 3), ("pitch", 61), ("velocity", 0), ("shift", 9), ("pitch", 61), ("velocity", 70), ("pitch", 62)])):
        chunk = len({r[2] for r in rows if (r[0], r[1]) == (s, t)})
        rows += [(s, t, chunk, 5.0 * chunk, None if chunk == 2 else 5.0 * (chunk + 1), i, k, v) for i, (k, v) in enumerate(kinds)]
    chunks = sorted({r[:3] for r in rows}, key=lambda c: (c[2] + rng.random() * 4, rng.random()))
    parts, k = [], 0
    while k < len(chunks):
        n = rng.randint(1, len(chunks) // 3)
        parts.append([r for r in rows if r[:3] in set(chunks[k : k + n])])
        k += n
    rng.shuffle(parts)
    got = streamed(spark, tmp_path, TOKENS, parts, stateful.tracked_stream, "notes")
    want = tracked_notes(spark.createDataFrame(rows, TOKENS))
    cells = lambda df: sorted((r.song_id, r.track, r.program, r.pitch, r.is_drum, round(r.start_s, 6), round(r.end_s, 6)) for r in df.collect())
    assert len(cells(want)) > 50 and cells(got) == cells(want)


def event(job, seq, stage="work", part=None, notes=None):
    return (job, seq, stage, f"m{seq}", part, notes)


def test_a_log_that_ends(spark, tmp_path):
    """Late duplicates, a gap that is filled later, events after the end, another job that goes on."""
    parts = [
        [event("a", 0), event("a", 2, part="bass", notes=3), event("b", 0)],
        [event("a", 2, part="bass", notes=3), event("b", 1, part="drums", notes=9)],
        [event("a", 1), event("a", 0)],
        [event("a", 4), event("a", 3, "done"), event("b", 0)],
        [event("a", 5), event("a", 3, "done"), event("a", 1), event("b", 3)],
        [event("b", 2), event("c", 0, "error"), event("c", 1)],
    ]
    got = streamed(spark, tmp_path, event_log.EVENTS, parts, lambda s: stateful.live_log(s, 1), "log")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=lambda r: r[:2]) == [event("a", 1), event("a", 2, part="bass", notes=3), event("a", 3, "done"), event("b", 1, part="drums", notes=9), event("b", 2), event("b", 3)]
    whole = event_log.replay(spark.createDataFrame([e for p in parts for e in p], event_log.EVENTS), 1)
    assert sorted(tuple(r) for r in whole.select("job_id", "seq").collect()) == sorted(r[:2] for r in rows)


def test_silent_keys_are_forgotten(spark, tmp_path):
    """A track without a last chunk ends after a while; a job that ended is no longer remembered."""
    schema = TOKENS
    folder = tmp_path / "in"
    rows = [(0, "t", 0, 0.0, 5.0, i, k, v) for i, (k, v) in enumerate([("tie", 0), ("program", 1), ("velocity", 9), ("pitch", 50)])]
    run = lambda: stateful.tracked_stream(spark.readStream.schema(schema).parquet(str(folder)), 1).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    told = lambda: sorted((r.song_id, r.program, r.start_s, round(r.end_s, 3)) for r in spark.read.schema(stateful.NOTES).parquet(str(tmp_path / "out")).collect())
    query, deadline = run(), time.time() + 60
    try:
        other = [(1, "t", 0, 0.0, None, i, k, v) for i, (k, v) in enumerate([("tie", 0), ("drum", 38)])]
        spark.createDataFrame(other, schema).coalesce(1).write.mode("append").parquet(str(folder))
        got = []
        while len(got) < 2 and time.time() < deadline:
            time.sleep(1)
            got = told() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        query.stop()
    assert got == [(0, 1, 0.0, 0.01), (1, 128, 0.0, 0.01)]
