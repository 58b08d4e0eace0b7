"""Codecs, signals, matching, streaming and the cache."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright import cli
from tonewright.functions import backends
from tonewright.operators import signal as A
from tonewright.operators.cache import Cache
from tonewright.operators.run import process
from tonewright.operators.tokens import EVENTS, tracked_notes
from tonewright.plans import media_queries
from tonewright.sources import midi, wav
from tonewright.sources.notes import frozen
from tonewright.streaming import event_log


def test_midi_numbers_and_round_trip():
    for value in (0, 127, 128, 8192, 2**21):
        assert midi._read_number(midi.number(value), 0) == (value, len(midi.number(value)))
    tracks = [midi.Track("bass", 33, False, [(40, 90, 0.0, 0.5), (40, 80, 0.5, 1.0)]), midi.Track("drums", 0, True, [(36, 100, 0.25, 0.3)])]
    got = list(midi.rows("x", midi.write(tracks, 120.0)))
    assert [(r[2], r[5], r[6], r[7]) for r in got] == [("bass", False, 40, 90), ("bass", False, 40, 80), ("drums", True, 36, 100)]
    assert [r[10] for r in got] == pytest.approx([0, 0.5, 0.25], abs=1e-3)
    both = list(midi.rows("y", midi.merge([midi.write(tracks[:1]), midi.write(tracks[1:])])))
    assert {r[2] for r in both} == {"bass", "drums"}
    with pytest.raises(ValueError):
        midi.parse(b"nothing")


def test_midi_source(spark, tmp_path):
    midi.register(spark)
    notes = spark.createDataFrame([(1, "bass", 33, False, 40, 90, 0.5, 1.0), (1, "drums", 0, True, 36, 99, 0.0, 0.1)], "song_id long, track string, program int, is_drum boolean, pitch int, velocity int, start_s double, end_s double").coalesce(1)
    notes.write.format("midi").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("midi").load(str(tmp_path / "out"))
    assert sorted((r.track, r.pitch) for r in back.collect()) == [("bass", 40), ("drums", 36)]
    assert midi.read_notes(spark, str(tmp_path / "out")).count() == 2


def test_wav(spark, tmp_path):
    x = np.stack([np.sin(np.arange(9000) / 10), np.zeros(9000)], 1).astype(np.float32)
    data = wav.encode(8000, x)
    rate, y = wav.decode(data)
    assert rate == 8000 and np.abs(x - y).max() < 1e-4 and wav.duration(data) == pytest.approx(1.125)
    assert wav.duration(b"no") is None
    (tmp_path / "a.wav").write_bytes(data)
    blocks = wav.read_blocks(spark, str(tmp_path / "a.wav"), 0.5, 0.25)
    assert sum(len(r.samples) for r in blocks.collect()) == 2 * 2000 and min(r.t0 for r in blocks.collect()) == 0.5


def test_spectra():
    t = np.arange(16000) / 16000
    assert A.spectral_share(np.sin(2 * np.pi * 6000 * t), 16000)[0] > 0.99
    assert A.spectral_share(np.sin(2 * np.pi * 440 * t), 16000)[0] < 0.01
    assert A.spectral_share(np.random.default_rng(0).normal(size=16000), 16000)[1] > 0.4
    assert np.argmax(A.log_mel(np.sin(2 * np.pi * 440 * t), 16000).mean(0)) < 25
    half = A.resample(np.sin(2 * np.pi * 200 * t), 16000, 8000)
    want = np.sin(2 * np.pi * 200 * np.arange(8000) / 8000)
    assert np.abs(half - want)[100:-100].max() < 0.02


def test_matching_is_greedy_by_distance(spark):
    schema = "song_id long, track string, note_id long, pitch int, start_s double"
    ref = spark.createDataFrame([(0, "t", 0, 60, 1.0), (0, "t", 1, 60, 1.04), (0, "t", 2, 60, 9.0)], schema)
    est = spark.createDataFrame([(0, "t", 0, 60, 1.03), (0, "t", 1, 61, 1.06), (0, "t", 2, 60, 5.0)], schema)
    assert sorted((r.r_id, r.e_id) for r in A.match_notes(ref, est, 0.05).collect()) == [(1, 0)]
    assert A.onset_f1(ref, est, 0.05).first().f1 == pytest.approx(2 / 6)
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 20, 150), rng.uniform(0, 20, 150)
    ref = spark.createDataFrame([(0, "t", i, 60, float(x)) for i, x in enumerate(a)], schema)
    est = spark.createDataFrame([(0, "t", i, 60, float(x)) for i, x in enumerate(b)], schema)
    pairs, r, e = sorted((abs(x - y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 0.05), set(), set()
    for _, i, j in pairs:
        if i not in r and j not in e:
            r.add(i)
            e.add(j)
    assert A.match_notes(ref, est, 0.05).count() == len(r)


def test_lag(spark):
    env = spark.createDataFrame([(0, "t", k, float(np.exp(-abs(k * 0.003 % 0.5 - 0.25) * 40))) for k in range(3000)], "song_id long, track string, frame long, v double")
    on = spark.createDataFrame([(0, "t", 0.25 + 0.5 * k + 0.06) for k in range(1, 15)], "song_id long, track string, t double")
    assert A.audio_lag(on, env, 0.003).first().lag == pytest.approx(0.06, abs=0.004)


def test_lag_of_late_notes(spark, sf, monkeypatch):
    late = media_queries.notes(spark, sf).withColumn("start_s", F.col("start_s") + 60).withColumn("end_s", F.col("end_s") + 60)
    monkeypatch.setattr(media_queries, "notes", lambda *_: late)
    rows = media_queries.audio_lag(spark, sf).collect()
    assert len(rows) == late.select("song_id", "track").distinct().count() > 0
    assert all(r.lag == pytest.approx(-0.05, abs=0.002) and r.score > 0.9 for r in rows)


def test_tokens(spark):
    got = A.decode_tokens(spark.createDataFrame([(7, [2, 11, 338, 476, 51, 336, 500, 3]), (8, [2, 11, 338, 3]), (9, [])], "clip_id long, tokens array<int>")).collect()
    assert [(r.clip_id, r.pitch, r.velocity, round(r.start_s, 2)) for r in got] == [(7, 38, 76, 0.07), (7, 36, 100, 0.47), (8, 38, 100, 0.07)]


def test_log_streams(spark, tmp_path):
    rows = [("a", 0, "start", "", None, None), ("a", 1, "part", "", "bass", 3), ("a", 2, "part", "", "bass", 5), ("a", 3, "done", "", None, None), ("b", 0, "part", "", "drums", 1)]
    for k, part in enumerate((rows[:2], rows[1:3], rows[3:])):
        spark.createDataFrame(part, event_log.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    event_log.stream_replay(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    event_log.stream_latest(spark, str(tmp_path / "log"), str(tmp_path / "latest"), str(tmp_path / "c2"), max_files=1).awaitTermination(120)
    assert sorted((r.job_id, r.part, r.notes) for r in event_log.latest(spark, str(tmp_path / "latest")).collect()) == [("a", "bass", 5), ("b", "drums", 1)]


def test_cache(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/cache")
    assert cache.get("stems", "k") is None
    cache.put("stems", "k", spark.range(3))
    assert cache.put("stems", "k", spark.range(9)).count() == 3  # the first writer's
    assert cache.get("stems", "k").count() == 3 and cache.size_bytes() > 0
    assert cache.summary()["hits"] == ["stems"] and cache.sweep() == 0
    # A writer that comes second, at the same time, leaves nothing behind; one that never ends is swept.
    assert len(list((tmp_path / "cache" / "stems" / "k").iterdir())) == 1
    (tmp_path / "cache" / "stems" / "k" / "unfinished").mkdir()
    assert cache.sweep() == 0 and cache.sweep(-1) == 1 and cache.get("stems", "k").count() == 3
    assert cache.clear() > 0 and cache.size_bytes() == 0


def test_backends(spark, monkeypatch):
    blocks = spark.createDataFrame([], "song_id long, stem string")
    with pytest.raises(backends.BackendError, match="not installed"):
        backends.transcribe(blocks, "basic-pitch")
    with pytest.raises(backends.BackendError, match="unknown"):
        backends.transcribe(blocks, "none")
    monkeypatch.setenv("TONEWRIGHT_COMMERCIAL", "1")
    with pytest.raises(backends.BackendError, match="non-commercial"):
        backends.guard("muscriptor")


def told(chunks):
    """The tracker from its description, token by token: chunks of (seek, next seek, [(type, value)])."""
    open_, notes, prologue, seek = {}, [], False, 0.0

    def end(keys, t):
        for k in list(keys):
            notes[open_.pop(k)][3] = t

    for seek_, next_seek, tokens in chunks:
        if prologue:
            end(list(open_), seek)
        seek, prologue, skip, program, velocity, tied, tick = seek_, True, False, None, None, set(), round(seek_ * 100)
        begin = tick
        for kind, value in tokens:
            if prologue:
                if kind == "tie":
                    prologue, velocity = False, None
                    end([k for k in open_ if k not in tied], seek)
                elif kind == "shift":
                    prologue, skip = False, True
                    end(list(open_), seek)
                elif kind == "program":
                    program = value
                elif kind == "pitch" and program is not None:
                    tied.add((program, value))
            elif skip:
                continue
            elif kind == "shift":
                tick = begin + value if value > 0 else tick
            elif kind == "program":
                program = value
            elif kind == "velocity":
                velocity = value
            elif next_seek is not None and tick / 100 >= next_seek:
                continue
            elif kind == "drum":
                notes.append([128, value, tick / 100, tick / 100 + 0.01])
            elif kind == "pitch" and program is not None and velocity is not None:
                if (program, value) in open_:
                    end([(program, value)], tick / 100)
                if velocity > 0:
                    open_[program, value] = len(notes)
                    notes.append([program, value, tick / 100, None])
    if prologue:
        end(list(open_), seek)
    for k in open_.values():
        notes[k][3] = notes[k][2] + 0.01
    return sorted((p, q, round(a, 4), round(b, 4)) for p, q, a, b in notes)


def test_tracked_notes_equal_the_state_machine(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for song in range(40):
        chunks = []
        for c in range(6):
            kinds = [(rng.choice(["program", "pitch", "pitch"]), rng.randint(0, 3)) for _ in range(rng.randint(0, 8))] + [rng.choice([("tie", 0), ("tie", 0), ("tie", 0), ("shift", 30)])] * (rng.random() < 0.9)
            tick = 0
            for _ in range(rng.randint(0, 25)):
                kind = rng.choice(["shift", "program", "velocity", "pitch", "pitch", "drum"])
                tick += rng.randint(0, 60) * (kind == "shift")
                kinds.append((kind, {"shift": tick, "program": rng.randint(0, 1), "velocity": rng.randint(0, 2) * 50}.get(kind, rng.randint(0, 3))))
            chunks.append((c * 5.0, (c + 1) * 5.0 if c < 5 else None, kinds))
            rows += [(song, "t", c, *chunks[-1][:2], i, *k) for i, k in enumerate(kinds or [("none", 0)])]
        want[song] = told(chunks)
    got = {}
    for r in tracked_notes(spark.createDataFrame(rows, EVENTS)).collect():
        got.setdefault(r.song_id, []).append((r.program, r.pitch, round(r.start_s, 4), round(r.end_s, 4)))
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}


def test_stem_files_and_sections(spark, tmp_path):
    x = np.sin(np.arange(5000) / 7).astype(np.float32) * 0.5
    blocks = spark.createDataFrame([(3, "bass", c, k, 1000, (x[k * 1000 : k * 1000 + 1000] * (1 - c / 2)).tolist()) for k in range(5) for c in (0, 1)], "song_id long, stem string, channel int, block_id long, sr int, samples array<float>")
    data = bytes(wav.to_files(blocks).first().wav)
    rate, y = wav.decode(data)
    assert rate == 1000 and y.shape == (5000, 2) and np.abs(y[:, 0] - x).max() < 1e-4 and np.abs(y[:, 1] - x / 2).max() < 1e-4
    (tmp_path / "a.wav").write_bytes(data)
    rows = wav.read_blocks(spark, str(tmp_path / "a.wav"), 1.5, 2.0).where("channel = 0").orderBy("t0").collect()
    assert np.abs(np.concatenate([r.samples for r in rows]) - x[1500:3500]).max() < 1e-4 and rows[0].t0 == 1.5
    assert wav.read_blocks(spark, str(tmp_path / "a.wav"), 9.0).count() == 0


def test_a_whole_run(spark):
    """Sparse stems take the fallback's notes; a grid and files come out."""
    beat = 60 / 114
    schema = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"
    lead = [(0, "other", i, 60 + i % 4 * 3, 90, 1.0 + i * beat / 2, 1.2 + i * beat / 2, False, 0) for i in range(300)]
    notes = spark.createDataFrame([*lead, (0, "bass", 900, 40, 90, 1.0, 1.3, False, 0)], schema)
    more = spark.createDataFrame([(0, "bass", 1000 + i, 40, 90, 1.0 + i * beat, 1.2 + i * beat, False, 0) for i in range(150)], schema)
    stems = spark.createDataFrame([(0, "other", 80.0, 0.1), (0, "bass", 80.0, 0.1), (0, "vocals", 80.0, 1e-6)], "song_id long, track string, seconds double, rms double")
    run = process(notes, stems, more, tempo=114.0, mono_stems=("bass",), mode="constant")
    assert {(r.track, r["count"]) for r in run.notes.groupBy("track").count().collect()} == {("comping", 300), ("bass", 150)}
    assert run.info.first().fitted and run.tempo.first().bpm == pytest.approx(114, rel=1e-3)
    assert any("vocals" in r.warning for r in run.warnings.collect())
    assert sum(len(t.notes) for _, t in midi.parse(bytes(run.files().first().midi))[2]) == 450
    assert process(notes, params=None, fit_grid=False).tempo.first().bpm > 0


NOTE = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"


def test_a_run_goes_at_its_own_tempo(spark):
    """Two beats are two seconds at 60: a note of 1.5 s stays whole; at 120 it ends at the next onset."""
    notes = spark.createDataFrame([(s, "bass", i, 40 + i, 90, a, b, False, 0) for s in (0, 1) for i, (a, b) in enumerate([(0.0, 1.5), (1.2, 1.4)])], NOTE)
    tempi = spark.createDataFrame([(0, 60.0), (1, 120.0)], "song_id long, bpm double")
    run = process(notes, tempo=tempi, fit_grid=False)
    assert {r.song_id: r.end_s for r in run.notes.where("start_s = 0").collect()} == {0: 1.5, 1: 1.2}
    assert process(notes.where("song_id = 0"), tempo=60.0, fit_grid=False).notes.agg({"end_s": "max"}).first()[0] == 1.5
    some = process(notes, tempo=tempi.where("song_id = 0"), fit_grid=False, groups=(1, 1, 1))
    said = {(r.song_id, r.warning) for r in some.warnings.collect()}
    assert (1, "no tempo found: written at 120 BPM") in said and sum("meter" in w for _, w in said) == 2
    some.release()


def test_sparse_stems_by_tempo_and_meter(spark):
    """Eight bars last 32 s at 60 BPM in 4/4 and 24 s in 3/4."""
    notes = spark.createDataFrame([(0, "bass", 0, 40, 90, 1.0, 1.5, False, 0)], NOTE)
    more = spark.createDataFrame([(0, "bass", 1 + i, 40, 90, float(i), i + 0.5, False, 0) for i in range(20)], NOTE)
    stems = spark.createDataFrame([(0, "bass", 28.0, 0.1)], "song_id long, track string, seconds double, rms double")
    four = process(notes, stems, more, tempo=60.0, fit_grid=False)
    three = process(notes, stems, more, tempo=60.0, fit_grid=False, groups=(1, 1, 1))
    assert four.notes.count() == 1 and three.notes.count() == 20
    assert any("fallback" in r.warning for r in three.warnings.collect())


def test_tempo_changes_in_files():
    tempi = [(0, 100.0), (1920, 140.0), (2880, 95.5)]
    notes = [(60, 90, 0.1 * k, 0.1 * k + 0.05) for k in range(80)]
    data = midi.write([midi.Track("t", 0, False, notes)], division=960, tempi=tempi)
    got = list(midi.rows("", data))
    assert [r[10] for r in got] == pytest.approx([n[2] for n in notes], abs=1e-3)
    assert [t for t, _ in midi.parse(data)[1]] == [0, 1920, 2880]


def test_grid_command(spark, tmp_path, capsys):
    """Bar lines come to lie on the beat; no note moves."""
    beat = 60 / 114
    chords = [(57, 60, 64), (53, 57, 60), (48, 52, 55), (55, 59, 62)]
    notes = [(p, 80, 1.0 + beat * (4 * bar + b), 1.0 + beat * (4 * bar + b) + 0.4) for bar in range(24) for b in range(4) for p in chords[bar % 4]]
    (tmp_path / "in.mid").write_bytes(midi.write([midi.Track("chords", 0, False, notes)]))
    assert cli.main(["grid", str(tmp_path / "in.mid"), "-o", str(tmp_path / "out.mid"), "--tempo", "114"]) == 0
    told = json.loads((tmp_path / "out.grid.json").read_text())
    assert told["bpm"] == pytest.approx(114, rel=1e-3) and "114" in capsys.readouterr().out
    data = (tmp_path / "out.mid").read_bytes()
    division, tempi, _ = midi.parse(data)
    assert sorted(r[10] for r in midi.rows("", data)) == pytest.approx(sorted(n[2] for n in notes), abs=2e-3)
    bar = midi.seconds([division * 4], division, tempi)[0]
    off = (bar - told["first_bar"]) / (4 * beat)
    assert off == pytest.approx(round(off), abs=0.01)
    assert cli.main(["grid", str(tmp_path / "in.mid"), "-o", str(tmp_path / "o.mid"), "--meter", "7/5"]) == 1


def drifting(bars=40, low=96.0, high=102.0):
    """Chords on every pulse of a song that goes from one tempo to another; its pulses."""
    times, t = [], 0.7
    for k in range(bars * 4):
        times.append(t)
        t += 60 / (low + (high - low) * k / (bars * 4))
    chords = [(57, 60, 64), (53, 57, 60), (48, 52, 55), (55, 59, 62)]
    between = [(72, 60, a + (b - a) * q / 4, a + (b - a) * q / 4 + 0.05) for a, b in zip(times, times[1:]) for q in (1, 2)]
    return times, [(p, 80, t, t + 0.4) for k, t in enumerate(times) for p in chords[k // 4 % 4]] + between


def bars_of(data, pulses=4):
    """Times of a file's bar lines after the pickup."""
    division, tempi, _ = midi.parse(data)
    last = max(r[9] for r in midi.rows("", data))
    return midi.seconds(list(range(pulses * division, last, pulses * division)), division, tempi)


def test_files_of_a_run_have_bar_lines_on_the_grid(spark):
    """A constant song, one that drifts and one that fits nothing, in one run; no note moves."""
    beat = 60 / 114
    chords = [(57, 60, 64), (53, 57, 60), (48, 52, 55), (55, 59, 62)]
    steady = [(p, 80, 1.0 + beat * k, 1.0 + beat * k + 0.4) for k in range(96) for p in chords[k // 4 % 4]]
    times, moving = drifting()
    rng = np.random.default_rng(0)
    free = [(60, 80, float(t), float(t) + 0.1) for t in np.cumsum(rng.uniform(0.1, 0.9, 30))]
    rows = [(s, "other", i, p, v, a, b, False, 0) for s, song in enumerate((steady, moving, free)) for i, (p, v, a, b) in enumerate(song)]
    tempi = spark.createDataFrame([(0, 114.0), (1, 99.0), (2, 90.0)], "song_id long, bpm double")
    run = process(spark.createDataFrame(rows, NOTE), tempo=tempi, params=None, mode="auto")
    kind = {r.song_id: (r.fitted, r.tempo) for r in run.info.collect()}
    assert kind[0] == (True, "constant") and kind[1] == (True, "map") and not kind[2][0]
    files = {r.song_id: bytes(r.midi) for r in run.files().collect()}
    for s, song in enumerate((steady, moving, free)):
        assert sorted(r[10] for r in midi.rows("", files[s])) == pytest.approx(sorted(n[2] for n in song), abs=2e-3)
    tick = beat / 960
    for t in bars_of(files[0]):
        assert abs((t - 1.0) / (4 * beat) - round((t - 1.0) / (4 * beat))) * 4 * beat < max(tick, 5e-4) * 1.5
    lines = bars_of(files[1])
    assert len(lines) > 30 and all(min(abs(t - x) for x in times[::4]) < 0.012 for t in lines[1:-1])
    assert midi.parse(files[2])[1] == [(0, round(60e6 / 90))]
    run.release()


def test_grid_command_over_a_folder(spark, tmp_path, capsys):
    """Each file a song, all in one job; a map where the tempo drifts."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "drift.mid").write_bytes(midi.write([midi.Track("chords", 0, False, drifting()[1]), midi.Track("", 0, False, [(40, 90, 1.0, 1.2)]), midi.Track("chords", 0, False, [(41, 90, 1.0, 1.2)])]))
    beat = 60 / 114
    (tmp_path / "in" / "steady.mid").write_bytes(midi.write([midi.Track("x", 0, False, [(60 + k % 3, 80, 1.0 + beat * k / 4, 1.1 + beat * k / 4) for k in range(400) if k % 4 != 3])]))
    assert cli.main(["grid", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--tempo-mode", "auto"]) == 0
    told = {n: json.loads((tmp_path / "out" / f"{n}.grid.json").read_text()) for n in ("drift", "steady")}
    assert told["drift"]["tempo"] == "map" and told["steady"]["tempo"] == "constant" and told["steady"]["bpm"] == pytest.approx(114, rel=1e-3)
    assert 94 < told["drift"]["bpm_range"][0] < told["drift"]["bpm_range"][1] < 104
    out = capsys.readouterr().out
    assert "drift.mid: map of" in out and "steady.mid: 114.0" in out
    data = (tmp_path / "out" / "drift.mid").read_bytes()
    assert {t.name for _, t in midi.parse(data)[2]} == {"chords 0", "track 1", "chords 2"}
    assert len(bars_of(data)) > 30
    assert cli.main(["grid", str(tmp_path / "in"), "-o", str(tmp_path / "out2"), "--downbeat", "9"]) == 1


def test_frozen_songs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"bpm": 150, "parts": [{"name": "drums", "drum": True, "notes": [[0.5, 0.6, 36, 100], [1.0, 1.1, 38, 90]]}, {"name": "bass", "notes": []}]}, indent=1))
    got = frozen(spark, str(tmp_path / "a.json")).collect()
    assert [(r.track, r.is_drum, r.place, r.pitch, r.velocity, r.start_s, r.end_s) for r in got] == [("drums", True, 0, 36, 100, 0.5, 0.6), ("drums", True, 1, 38, 90, 1.0, 1.1)]
