"""Data sources: sections of WAV files, and MIDI files written by a commit protocol."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, IsNull, LessThan, LessThanOrEqual

from tonewright.sources import midi, wav, wav_source
from tonewright.sources.wav import BLOCK

RATE = 8000


def pcm(x, rate, width, extra=b""):
    """A file of any width, with a chunk before the samples."""
    full = np.round(np.clip(x, -1, 1) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
    raw = (full + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(4, "little", signed=True)[:width] for v in full.ravel())
    channels = x.shape[1]
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width) + b"data" + struct.pack("<I", len(raw)) + raw


@pytest.fixture(scope="module")
def music(tmp_path_factory):
    folder = tmp_path_factory.mktemp("music")
    t = np.arange(RATE * 70) / RATE
    x = np.stack([np.sin(2 * np.pi * 3 * t) * 0.5, np.cos(t) * 0.25], 1)
    (folder / "long.wav").write_bytes(wav.encode(RATE, x))
    (folder / "sub").mkdir()
    (folder / "sub" / "odd.wav").write_bytes(pcm(x[:5000, :1], 1000, 3, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (folder / "sub" / "eight.WAV").write_bytes(pcm(x[:300], 1000, 1)[:-100])  # cut short
    (folder / "broken.wav").write_bytes(b"RIFFxxxxWAVEnothing")
    (folder / "notes.txt").write_bytes(b"no sound")
    return folder, x


def reader(folder, *filters, **options):
    r = wav_source.WavReader({"path": str(folder), **options})
    return r, list(r.pushFilters(list(filters)))


def test_only_the_section_is_read(music):
    folder, _ = music
    r, left = reader(folder, GreaterThanOrEqual(("t0",), 20.0), LessThan(("t0",), 24.0), EqualTo(("channel",), 1), IsNull(("sr",)))
    assert left == [IsNull(("sr",))]
    parts = r.partitions()
    assert {p.sound.path for p in parts} == {str(folder / "long.wav")} and all(p.channels == (1,) for p in parts)
    read, all_bytes = sum(p.bytes for p in parts), sum(p.bytes for p in reader(folder)[0].partitions())
    assert 4 * RATE * 4 <= read + BLOCK * 4 * 2 and read < 0.08 * all_bytes
    assert len(reader(folder, seconds="5")[0].partitions()) > 10


@pytest.mark.parametrize("where", ["t0 >= 20 AND t0 < 24", "t0 > 20.48 AND t0 <= 21.504", "channel = 0", "channel IN (1, 7) AND t0 < 3", "t0 > 500", "t0 < -1", "block_id = 3", "t0 = 1.024", "path LIKE '%odd%' AND t0 >= 4", "t0 >= 10 OR channel = 1"])
def test_filters_give_what_they_say(spark, music, where):
    folder, _ = music
    wav_source.register(spark)
    cells = lambda df: sorted((r.path, r.channel, r.block_id, round(r.t0, 9), r.sr, tuple(np.round(r.samples, 6))) for r in df.collect())
    whole = spark.createDataFrame(spark.read.format("wav").load(str(folder)).collect(), wav.BLOCKS)
    assert cells(spark.read.format("wav").load(str(folder)).where(where)) == cells(whole.where(where))


def test_pushed_filters_are_in_the_plan(spark, music):
    wav_source.register(spark)
    df = spark.read.format("wav").load(str(music[0])).where("t0 >= 20 AND t0 < 24")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan wav" in plan and "Filter " not in plan  # the source has taken all of it


def test_samples_of_all_widths(spark, music):
    folder, x = music
    wav_source.register(spark)
    rows = spark.read.format("wav").load(str(folder)).collect()
    of = lambda name, c: np.concatenate([r.samples for r in sorted((r for r in rows if r.path.endswith(name) and r.channel == c), key=lambda r: r.block_id)])
    assert np.abs(of("long.wav", 1) - x[:, 1]).max() < 1e-4 and np.abs(of("odd.wav", 0) - x[:5000, 0]).max() < 1e-6
    assert len(of("eight.WAV", 0)) == 250 and np.abs(of("eight.WAV", 1) - x[:250, 1]).max() < 0.02
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"long.wav", "odd.wav", "eight.WAV"}
    assert spark.read.format("wav").load(f"file://{folder}/long.wav").agg(F.sum(F.size("samples"))).first()[0] == 2 * len(x)
    with pytest.raises(Exception, match="no samples"):
        spark.read.format("wav").option("strict", "true").load(str(folder)).count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("wav").load(str(folder / "nowhere")).count()


def test_bounds_of_either_kind(music):
    for f, want in ((GreaterThan(("t0",), 0.512), 1.024), (GreaterThanOrEqual(("t0",), 0.512), 0.512)):
        r, _ = reader(music[0] / "long.wav", f, LessThanOrEqual(("t0",), 1.024))
        assert [p.first * BLOCK / RATE for p in r.partitions()] == [want]


# --- MIDI files ---------------------------------------------------------------------------------

NOTE = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"


def song_rows(songs=3, n=20):
    return [(s, "lead" if i % 2 else "bass", i, 40 + i % 30, 80, i * 0.25, i * 0.25 + 0.2, False, 5) for s in range(songs) for i in range(n)]


def named(folder):
    return sorted(p.name.split("-")[0] for p in folder.rglob("*.mid"))


def test_an_attempt_that_died_publishes_nothing(tmp_path):
    """Two attempts of a task and one of another: the file of the first stays in the staging folder and goes with it."""
    rows = [dict(zip([c.split()[0] for c in NOTE.split(", ")], r)) for r in song_rows()]
    w = midi.MidiWriter({"path": str(tmp_path)})

    def dies():
        yield from rows[:20]
        raise RuntimeError("lost executor")

    with pytest.raises(RuntimeError):
        w.write(dies())
    lost = w.write(iter(rows[:20]))  # done, but the driver never heard of it
    good = [w.write(iter(rows[:20])), w.write(iter(rows[20:]))]
    assert named(tmp_path) == [] and len(lost.files) == 1
    w.commit(good)
    assert named(tmp_path) == ["0", "1", "2"] and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    failed = midi.MidiWriter({"path": str(tmp_path)})
    failed.abort([failed.write(iter(rows)), None])
    assert named(tmp_path) == ["0", "1", "2"] and len(list(tmp_path.iterdir())) == 3
    split = midi.MidiWriter({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="several tasks"):
        split.commit([split.write(iter(rows[:10])), split.write(iter(rows[10:20]))])
    assert len(list(tmp_path.iterdir())) == 3


def test_save_and_overwrite(spark, tmp_path):
    out = tmp_path / "out"
    notes = spark.createDataFrame(song_rows(), NOTE).repartition(5)
    midi.save(notes, str(out))
    back = spark.read.format("midi").load(str(out))
    assert back.count() == 60 and named(out) == ["0", "1", "2"]
    got = sorted((r.track, r.pitch, round(r.start_s, 6), r.program) for r in back.where(F.col("path").contains("/1-")).collect())
    assert got == sorted((r[1], r[3], r[5], 5) for r in song_rows() if r[0] == 1)
    midi.save(notes.where("song_id = 2"), f"file://{out}", mode="overwrite", tempi=spark.createDataFrame([(2, 90.0)], "song_id long, bpm double"))
    assert named(out) == ["2"]
    with pytest.raises(Exception, match="several tasks"):
        notes.where("song_id = 2").repartition(4, "note_id").write.format("midi").mode("append").save(str(out))
    assert named(out) == ["2"] and not [p for p in out.iterdir() if p.name.startswith("_")]


def test_a_failing_job_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "out"
    notes = spark.createDataFrame(song_rows(), NOTE)
    midi.save(notes, str(out))
    bad = midi.to_files(notes).withColumn("midi", F.when(F.col("song_id") == 1, F.expr("CAST(raise_error('broken') AS BINARY)")).otherwise(F.col("midi"))).repartition(3)
    with pytest.raises(Exception, match="broken"):
        bad.write.format("midi").mode("overwrite").save(str(out))
    assert named(out) == ["0", "1", "2"]
