"""Results kept by song, songs that land as files, and stages with resources of their own."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tonewright.functions import backends
from tonewright.operators import cache
from tonewright.operators.run import process, process_new, song_keys
from tonewright.sources import midi
from tonewright.streaming import landing

NOTE = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"


def songs(spark, which, n=30, shift=0.0):
    return spark.createDataFrame([(s, "bass", i, 30 + s % 10 + i % 20, 90, i * 0.5 + shift, i * 0.5 + 0.6 + shift, False, 0) for s in which for i in range(n)], NOTE)


def test_only_new_songs_are_computed(spark, tmp_path):
    store, worked = cache.Results(spark, str(tmp_path / "results")), []

    def work(missing):
        worked.append(sorted(r.song_id for r in missing.collect()))
        return missing.where("song_id <> 5").select("song_id", (F.col("song_id") * 10).alias("x"))

    keyed = lambda *ids, tag="v1": spark.createDataFrame([(i, f"{tag}-{i}") for i in ids], "song_id long, key string")
    told = lambda *a, **k: sorted((r.song_id, r.x) for r in store.of("stage", keyed(*a, **k), work).collect())
    assert told(1, 2, 5) == [(1, 10), (2, 20)] and worked == [[1, 2, 5]]
    assert told(1, 2, 3, 5) == [(1, 10), (2, 20), (3, 30)] and worked[1:] == [[3]]
    assert told(2, 5) == [(2, 20)] and len(worked) == 2  # a song without rows is known as well
    assert told(2, tag="v2") == [(2, 20)] and worked[2:] == [[2]]
    # Two writers of one song: the first is read, nothing comes twice; an unfinished write is not seen.
    keyed(9).select("key").write.parquet(f"{tmp_path}/results/stage/aaa/asked")
    for name, x in (("bbb", 1), ("ccc", 2)):
        spark.createDataFrame([("v1-7", x)], "_key string, x long").write.parquet(f"{tmp_path}/results/stage/{name}/rows")
        spark.createDataFrame([("v1-7",)], "key string").write.parquet(f"{tmp_path}/results/stage/{name}/keys")
    assert told(7) == [(7, 1)] and told(9) == [(9, 90)]
    store.compact("stage")
    n = len(worked)
    assert told(1, 2, 3, 5, 7, 9) == [(1, 10), (2, 20), (3, 30), (7, 1), (9, 90)] and len(worked) == n
    assert told() == []


def test_sweep_keeps_results_and_writers_at_work(spark, tmp_path):
    """Unfinished and beaten writes go once nothing happens in them; one that is still written to stays."""
    store = cache.Cache(spark, str(tmp_path / "cache"))
    store.put("stems", "k", spark.range(3))
    at = tmp_path / "cache" / "stems" / "k"
    old = time.time() - 1000
    for name, files, moved in (("lost", ["part-0", "_SUCCESS"], old + 999), ("dead", ["part-0"], old), ("alive", ["part-0", "sub/part-1"], old)):
        for f in files:
            (at / name / f).parent.mkdir(parents=True, exist_ok=True)
            (at / name / f).write_bytes(b"x")
            os.utime(at / name / f, (moved, moved))
        os.utime(at / name, (old, old))
    os.utime(at / "alive" / "sub" / "part-1")
    winner = next(p.name for p in at.iterdir() if p.name not in ("lost", "dead", "alive"))
    for f in at.rglob("*"):
        if winner in str(f):
            os.utime(f, (old - 5, old - 5))
    assert store.sweep(500) == 1 and {p.name for p in at.iterdir()} == {winner, "lost", "alive"}
    os.utime(at / "lost" / "_SUCCESS", (old, old))
    os.utime(at / "lost" / "part-0", (old, old))
    assert store.sweep(500) == 1 and store.get("stems", "k").count() == 3
    assert {p.name for p in at.iterdir()} == {winner, "alive"}


def test_a_second_run_works_on_the_new_song(spark, tmp_path, monkeypatch):
    store, seen = cache.Results(spark, str(tmp_path / "runs")), []
    real = process
    monkeypatch.setattr("tonewright.operators.run.process", lambda notes, **k: (seen.append(sorted(r[0] for r in notes.select("song_id").distinct().collect())), real(notes, **k))[1])
    options = {"tempo": 100.0, "fit_grid": False}
    cells = lambda df: sorted((r.song_id, r.track, r.pitch, round(r.start_s, 6), round(r.end_s, 6)) for r in df.collect())
    first = cells(process_new(songs(spark, [1, 2]), store, **options))
    both = cells(process_new(songs(spark, [1, 2, 3]).repartition(5), store, **options))
    assert seen == [[1, 2], [3]] and both == cells(real(songs(spark, [1, 2, 3]), **options).notes) and set(first) < set(both)
    changed = songs(spark, [1]).unionByName(songs(spark, [2], shift=0.01)).unionByName(songs(spark, [3]))
    process_new(changed, store, **options).collect()
    process_new(changed, store, tempo=101.0, fit_grid=False).collect()
    assert seen[2:] == [[2], [1, 2, 3]]
    # Song 11 has the notes of song 1: the result is the same, and is there.
    again = process_new(songs(spark, [1, 11]), store, **options)
    assert [x[1:] for x in cells(again) if x[0] == 11] == [x[1:] for x in cells(again) if x[0] == 1] and again.count() == 60 and len(seen) == 4


def test_keys_follow_the_notes(spark):
    one = {r.song_id: r.key for r in song_keys(songs(spark, [1, 2]), "x").collect()}
    same = {r.song_id: r.key for r in song_keys(songs(spark, [2, 1]).repartition(4, "pitch"), "x").collect()}
    twice = {r.song_id: r.key for r in song_keys(songs(spark, [1]).unionByName(songs(spark, [1])), "x").collect()}
    other = {r.song_id: r.key for r in song_keys(songs(spark, [1]), "y").collect()}
    assert one == same and one[1] != one[2] and one[1] == song_keys(songs(spark, [11]), "x").first().key and len({one[1], twice[1], other[1]}) == 3


def test_songs_that_land(spark, tmp_path):
    folder, out, told = tmp_path / "in", str(tmp_path / "out"), []
    folder.mkdir()
    notes = [(60, 80, k * 0.5, k * 0.5 + 0.2) for k in range(8)]
    run = lambda: landing.land(spark, str(folder), out, str(tmp_path / "state"), lambda parts: told.extend((r.path.rsplit("/", 1)[1], r.track, r.notes) for r in parts.collect()), 2).awaitTermination(120)
    (folder / "a.mid").write_bytes(midi.write([midi.Track("lead", 3, False, notes), midi.Track("kit", 0, True, notes[:3])]))
    (folder / "broken.mid").write_bytes(b"MThd\0\0\0\6garbage")
    (folder / "notes.txt").write_bytes(b"not a song")
    run()
    (folder / "b.mid").write_bytes(midi.write([midi.Track("lead", 3, False, notes[:5])]))
    (folder / "other.mid").write_bytes(b"RIFF, not a song")
    run()
    assert sorted(told) == [("a.mid", "kit", 3), ("a.mid", "lead", 8), ("b.mid", "lead", 5)]
    got = landing.landed(spark, out)
    assert got.count() == 16 and got.where("track = 'lead'").count() == 13
    assert sorted(r.path.rsplit("/", 1)[1] for r in landing.failures(spark, out).collect()) == ["broken.mid", "other.mid"]
    run()
    assert landing.landed(spark, out).count() == 16


def test_a_model_with_a_device_is_a_stage_of_its_own(spark):
    backends.register("silent", lambda frames: (f.head(0)[[]] for f in frames))
    blocks = spark.createDataFrame([], "song_id long, stem string, samples array<float>")
    need = backends.device(0.5)
    assert need.taskResources["gpu"].amount == 0.5 and need.executorResources["gpu"].amount == 1
    plan = backends.transcribe(blocks, "silent", 0.5)._jdf.queryExecution().analyzed()
    text = plan.toString()
    assert text.index("Repartition") < text.index("MapInPandas") < text.rindex("Repartition")
    assert "ResourceProfile" in plan.children().head().toString() or "gpu" in text
    assert "Repartition" not in backends.transcribe(blocks, "silent")._jdf.queryExecution().analyzed().toString()
    with pytest.raises(backends.BackendError):
        backends.transcribe(blocks, "nothing", 1.0)
