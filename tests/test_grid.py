"""The grid, tempo maps and tempo on songs with a known answer."""

import numpy as np
import pytest

from tonewright.operators import grid as G
from tonewright.operators import tempo as T
from tonewright.operators import tempo_map as P

NOTE = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"


def song(spark, starts, track="t", pitch=60, velocity=100, drum=False, length=0.1):
    return spark.createDataFrame([(0, track, i, pitch, velocity, float(s), float(s + length), drum, 0) for i, s in enumerate(starts)], NOTE)


def onsets(spark, starts, track="t"):
    return spark.createDataFrame([(0, track, float(s)) for s in starts], "song_id long, track string, t double")


def steps(bpm, n, every=1, seed=0, jitter=0.004):
    rng = np.random.default_rng(seed)
    return 0.8 + np.arange(n) * every * 15 / bpm + rng.uniform(-jitter, jitter, n)


def test_fit_and_search_find_the_tempo(spark):
    on = onsets(spark, steps(114, 400))
    assert G.fit(on, 112.0).first().bpm == pytest.approx(114, rel=1e-3)
    assert G.fit(on).first().bpm == pytest.approx(114, rel=1e-3)


def test_fit_equals_a_plain_loop(spark):
    """Sums over stretches of time give every candidate's r and phase, before time 0 as well."""
    t = np.concatenate([steps(100, 300, 2), [-3.7, -0.2, 0.0, 16.0, 32.0]])
    sixes = 60 / 101 / 4 * np.linspace(0.97, 1.03, 6001)
    z = np.array([np.exp(2j * np.pi * t / s).mean() for s in sixes])
    known = G.moments(onsets(spark, t), 101 * 0.96 / 15, 101 * 1.04 / 15).toPandas()
    r, phase = G.Spectrum(known).of(sixes)
    assert np.abs(r * np.exp(1j * phase) - z).max() < 1e-9
    got = G.fit(onsets(spark, t), 101.0).first()
    k = int(np.argmax(abs(z)))
    assert got.r == pytest.approx(abs(z[k]), abs=1e-9) and got.bpm == pytest.approx(15 / sixes[k], rel=1e-9) and got.n == len(t)
    tempi = np.exp(np.arange(np.log(60), np.log(200), 1e-4))
    free = G.Spectrum(G.moments(onsets(spark, t), 59 / 15, 202 / 15).toPandas()).of(15 / tempi)[0]
    assert np.abs(free - [abs(np.exp(2j * np.pi * t * b / 15).mean()) for b in tempi]).max() < 1e-9


def test_fit_of_songs_at_all_tempi(spark):
    """Tables of tempi give what single tempi give, from 20 to 400, also for twice and three times the pulse."""
    tempi = [20.0, 33.0, 40.0, 57.0, 120.0, 210.0, 300.0, 400.0]
    rows = [(i, "t", float(s)) for i, b in enumerate(tempi) for s in steps(b * 1.004, 300, jitter=0.001)]
    on = spark.createDataFrame(rows, "song_id long, track string, t double")
    near = spark.createDataFrame([*enumerate(tempi), (99, 50.0)], "song_id long, bpm double")
    for factor in (1, 2, 3):
        got = {r.song_id: r for r in G.fit(on, near, factor=factor).collect()}
        assert sorted(got) == list(range(len(tempi))) and all(r.r <= 1 for r in got.values())
        for i, b in enumerate(tempi):
            if factor == 1:
                assert got[i].bpm == pytest.approx(b * 1.004, rel=2e-4)
    one = G.fit(on.where("song_id = 6"), 300.0).first()
    assert one.bpm == pytest.approx(G.fit(on, near).where("song_id = 6").first().bpm, rel=1e-9)
    bad = spark.createDataFrame([(0, None), (1, 0.0), (2, -5.0), (3, 57.0)], "song_id long, bpm double")
    assert [r.song_id for r in G.fit(on, bad).collect()] == [3]
    with pytest.raises(ValueError):
        G.Spectrum(G.moments(onsets(spark, steps(100, 300)), 5.0, 6.0).toPandas()).of(np.array([0.1]))


def tracked_by_frames(times, weights, bpm, end, tightness=400, rate=200):
    """The tracker a frame at a time."""
    n = int(np.ceil((end + 2.0) * rate)) + 2
    env = np.bincount(np.clip(np.rint(times * rate).astype(int), 0, n - 1), weights, n)
    env = np.convolve(env, np.sin(np.pi * np.arange(1, 8) / 8) ** 2, "same")
    env = env / np.sqrt(env.var() * n / (n - 1))
    period = 60.0 * rate / bpm
    local = np.convolve(env, np.exp(-0.5 * (np.arange(-int(period), int(period) + 1) * 32.0 / period) ** 2), "same")
    steps = np.arange(-int(round(2 * period)), -int(round(period / 2)) + 1)
    score, back, begun = np.zeros(n), np.full(n, -1), False
    for i in range(n):
        reach = [-tightness * np.log(-s / period) ** 2 + (score[i + s] if i + s >= 0 else 0.0) for s in steps]
        k = int(np.argmax(reach))
        score[i] = local[i] + reach[k]
        begun = begun or local[i] >= 0.01 * local.max()
        back[i] = i + steps[k] if begun else -1
    peaks = np.flatnonzero((score[1:-1] > score[:-2]) & (score[1:-1] >= score[2:])) + 1
    good = peaks[score[peaks] * 2 > np.median(score[peaks])]
    i, out = int(good[-1]), []
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1]) / rate


@pytest.mark.parametrize("bpm, guess", [(114.0, 112.0), (61.0, 60.0), (187.0, 190.0), (40.0, 41.0)])
def test_tracker_takes_many_frames_at_once(bpm, guess):
    rng = np.random.default_rng(int(bpm))
    t = 1.3 + np.arange(40) * 60 / bpm + rng.normal(0, 0.01, 40)
    t = np.sort(np.concatenate([t, rng.uniform(0, t[-1], 15)]))
    w = rng.uniform(0.2, 1, len(t))
    assert P.tracked(t, w, guess, float(t[-1])).tolist() == tracked_by_frames(t, w, guess, float(t[-1])).tolist()


@pytest.mark.parametrize("beats", [[0.0, 1.0, 2.0, 5.0, 6.0], [0.0, 0.5, 3.0, 3.5, 4.0, 9.0, 9.5], [1.0, 1.4], [0.0, 1.0, 2.5, 4.0, 5.5, 7.1, 7.2, 11.0]])
def test_gaps_are_filled_at_the_local_pulse(beats):
    """By the rule itself: while the next pulse is more than one and a half off, another is put out."""
    want = beats[:1]
    for b in beats[1:]:
        near = np.diff(want[-8:])
        p = float(np.median(near)) if len(near) > 1 else b - want[-1]
        want += [want[-1] + p * (k + 1) for k in range(100) if b - (want[-1] + p * k) > 1.5 * p and p > 0]
        want.append(b)
    inner = P.extended(np.array(beats), beats[0], beats[-1])
    assert inner == pytest.approx(want)
    wide = P.extended(np.array(beats), beats[0] - 3, beats[-1] + 3)
    assert wide[0] <= beats[0] - 3 < wide[1] and wide[-2] < beats[-1] + 3 <= wide[-1] and len(wide) >= len(want)


def test_too_few_onsets_fit_nothing(spark):
    assert G.fit_tracks(onsets(spark, steps(114, 40)), 114.0).count() == 0


def test_the_finer_pulse_of_eighths(spark):
    eighths = onsets(spark, steps(120, 200, 2, jitter=0.001))
    kept = G.fit_pulse(eighths, 120.0, den=8).first()
    assert kept.factor == 2 and kept.bpm == pytest.approx(240, rel=1e-3)
    assert G.fit_pulse(eighths, 120.0, den=8, fixed=True).first().factor == 1
    assert G.fit_pulse(onsets(spark, steps(120, 200, 4, jitter=0.001)), 120.0, den=8).first().factor == 1


def test_bar_one_from_harmony(spark):
    chords = [(57, 60, 64), (53, 57, 60), (48, 52, 55), (55, 59, 62)]
    notes, k = [], 0
    for bar in range(24):
        for beat in range(4):
            for p in chords[bar % 4]:
                a = 0.5 * (4 * bar + beat) + 1.0
                notes.append((0, "c", k, p, 80, a, a + 0.45, False, 0))
                k += 1
    n = spark.createDataFrame(notes, NOTE)
    got = G.bar_phase(n, 120.0, 0.0).first()
    assert got.anchor % 2.0 == pytest.approx(1.0) and got.confidence > 0.5


def test_latency_and_snap(spark):
    late = song(spark, [1 + 0.5 * k + 0.025 for k in range(40)])
    lat = G.latency(late, 120.0, 1.0)
    assert lat.first().latency == pytest.approx(0.025)
    snapped = sorted(r.start_s for r in G.snap(late, lat, 120.0, 1.0).collect())
    assert snapped == pytest.approx([1 + 0.5 * k for k in range(40)])
    again = G.snap(G.snap(late, lat, 120.0, 1.0).drop("step"), lat.withColumn("latency", lat.latency * 0), 120.0, 1.0)
    assert sorted(r.start_s for r in again.collect()) == pytest.approx(snapped)


def test_a_kit_keeps_the_loudest(spark):
    n = spark.createDataFrame([(0, "d", 0, 38, 50, 1.0, 1.1, True, 0), (0, "d", 1, 38, 90, 1.01, 1.2, True, 0), (0, "d", 2, 36, 20, 1.0, 1.1, True, 0)], NOTE)
    lat = spark.createDataFrame([(0, "d", 0.0)], "song_id long, track string, latency double")
    assert sorted((r.pitch, r.note_id) for r in G.snap(n, lat, 120.0, 1.0).collect()) == [(36, 2), (38, 1)]


def drifting(n=256):
    bpm = np.linspace(96, 102, n)
    return 1.0 + np.concatenate([[0], np.cumsum(60 / bpm)[:-1]])


def test_tracked_pulses_follow_a_drift(spark):
    true = drifting()
    found = np.array([r.t for r in P.track_beats(song(spark, true, drum=True), 99.0).orderBy("k").collect()])
    near = np.abs(found[:, None] - true[None, :]).min(0)
    assert np.median(near[4:-4]) < 0.012 and len(found) > 240


def test_a_map_beats_the_constant_grid_on_a_drift_only(spark):
    rng = np.random.default_rng(3)
    move = song(spark, drifting() + rng.uniform(-0.003, 0.003, 256), drum=True)
    assert P.map_gain(move, move, 99.0, 1.0).first().gain > 0.05
    still = song(spark, 1 + np.arange(256) * 60 / 99 + rng.uniform(-0.04, 0.04, 256), drum=True)
    assert P.map_gain(still, still, 99.0, 1.0).first().gain < 0.05


def test_position_and_time_are_inverse(spark):
    beats = spark.createDataFrame([(0, k, float(t)) for k, t in enumerate(drifting(40))], "song_id long, k int, t double")
    places = spark.createDataFrame([(0, float(p)) for p in np.linspace(-3, 45, 97)], "song_id long, position double")
    back = P.position(P.time_at(places, beats).withColumnRenamed("position", "want"), beats, "t", "got")
    assert all(r.got == pytest.approx(r.want, abs=1e-9) for r in back.collect()) and back.count() == 97


def test_extend_fills_a_gap_and_runs_on():
    t = np.array([0.0, 0.5, 1.0, 1.5, 3.5, 4.0])
    out = P.extended(t, -1.1, 5.0)
    assert out == pytest.approx([-1.5, -1.0, -0.5, 0, 0.5, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5, 5.0])


@pytest.mark.parametrize("bpm", [90, 92, 120, 140, 171])
def test_tempo_from_clicks(bpm):
    t = 0.3 + np.arange(80) * 60 / bpm
    found, beat0 = T.autocorrelation(t, np.ones(80), float(t[-1]) + 0.1)
    octave = min((found, found * 2, found / 2), key=lambda b: abs(b - bpm))
    assert octave == pytest.approx(bpm, rel=5e-3)


def test_octave_fold(spark):
    from pyspark.sql import functions as F

    got = [r.b for r in spark.createDataFrame([(30.0,), (12.0,), (120.0,), (410.0,), (1000.0,)], "x double").select(T.octave_fold(F.col("x")).alias("b")).collect()]
    assert got == [60.0, 96.0, 120.0, 102.5, 125.0]


def whole_song(spark, beats, late=0.02):
    """A chord on every pulse, changing every four; a bass a little late; a kick on the pulses."""
    chords, rows = [(57, 60, 64), (53, 57, 60), (48, 52, 55), (55, 59, 62)], []
    rough = np.random.default_rng(5).uniform(-0.008, 0.008, len(beats))
    for k, t in enumerate(beats):
        gap = beats[k + 1] - t if k + 1 < len(beats) else t - beats[k - 1]
        for p in chords[k // 4 % 4]:
            rows.append((0, "comping", len(rows), p, 80, float(t), float(t + 0.9 * gap), False, 0))
        rows.append((0, "bass", len(rows), 36 + k // 4 % 4, 90, float(t + late + rough[k]), float(t + late + 0.5 * gap), False, 0))
        rows.append((0, "drums", len(rows), 36, 110, float(t), float(t + 0.1), True, 0))
    return spark.createDataFrame(rows, NOTE)


def test_the_whole_stage_on_a_steady_song(spark):
    info, notes = G.apply(whole_song(spark, 1.0 + np.arange(96) * 60 / 114), 112.0)
    i = info.first()
    assert i.fitted and i.tempo == "constant" and i.bpm == pytest.approx(114, rel=1e-3)
    bar = 4 * 60 / 114
    assert min(abs((i.first_bar - 1.0) % bar), bar - abs((i.first_bar - 1.0) % bar)) < 0.01
    assert {t.track: t.latency_ms for t in i.tracks}["bass"] == pytest.approx(20, abs=4)
    starts = np.array([r.start_s for r in notes.collect()])
    off = (starts - 1.0 + 0.25) % (60 / 114) - 0.25
    assert np.abs(off).max() < 0.03 and notes.count() == 5 * 96


def test_the_whole_stage_follows_a_drift(spark):
    info, notes = G.apply(whole_song(spark, drifting(200)), 99.0, mode="auto")
    assert info.first().tempo == "map" and notes.count() == 1000


def test_songs_without_a_grid_are_left(spark):
    rng = np.random.default_rng(0)
    info, notes = G.apply(song(spark, np.sort(rng.uniform(0, 100, 300))), 114.0)
    row = info.first()
    assert not row.fitted and row.warnings and notes.count() == 300


def test_apply_follows_the_kit(spark):
    """A dense, well-aligned other track doesn't lead the map where there is a kit."""
    kit = [(0, "kit", 10_000 + i, 36, 120, float(t), float(t) + 0.1, True, 0) for i, t in enumerate(drifting(200))]
    dense = [(0, "dense", i, 60, 90, 0.5 + i * 0.15, 0.6 + i * 0.15, False, 0) for i in range(800)]
    notes = spark.createDataFrame(kit + dense, NOTE)
    on = G.onset_dedupe(notes)
    assert G.map_source(notes, on, 99.0).first().track == "kit"
    assert G.map_source(notes.where("track = 'dense'"), on.where("track = 'dense'"), 100.0).first().track == "dense"


def test_apply_without_a_tempo_or_snapping(spark):
    starts = 1.0 + np.arange(160) * 60 / 114
    notes = whole_song(spark, starts)
    info, out = G.apply(notes, None, snap_notes=False)
    row = info.first()
    assert row.fitted and row.bpm == pytest.approx(114, rel=2e-3) and row.source_track
    assert sorted(map(tuple, out.select("note_id", "start_s", "end_s").collect())) == sorted(map(tuple, notes.select("note_id", "start_s", "end_s").collect()))
    per_song, _ = G.apply(notes, spark.createDataFrame([(0, 113.0)], "song_id long, bpm double"), fixed_pulse=True)
    assert per_song.first().bpm == pytest.approx(114, rel=2e-3)
    G.release()


def test_latency_unfolds_by_the_sound(spark):
    """A bass 195 ms late, more than a sixteenth: its own sound tells by how many."""
    rng = np.random.default_rng(0)
    beat = 0.8 + np.sort(rng.choice(np.arange(900), 450, replace=False)) * 15 / 114
    notes = spark.createDataFrame([(0, "lead", i, 60, 100, float(t), float(t) + 0.1, False, 0) for i, t in enumerate(beat)] + [(0, "bass", 1000 + i, 40, 100, float(t) + 0.195, float(t) + 0.3, False, 0) for i, t in enumerate(beat)], NOTE)
    n = int((beat[-1] + 2) / 0.003)
    env = np.zeros(n)
    env[np.rint(beat / 0.003).astype(int)] = 1.0
    env = np.convolve(env, [0.3, 0.7, 1.0, 0.7, 0.3], "same")
    env = (env - env.mean()) / env.std()
    audio = spark.createDataFrame([(0, track, k, float(v)) for track in ("lead", "bass") for k, v in enumerate(env)], "song_id long, track string, frame long, v double")
    told = {t.track: t for t in G.apply(notes, 114.0, audio=audio)[0].first().tracks}
    assert told["bass"].latency_ms == pytest.approx(195, abs=5) and told["bass"].audio_lag_ms == pytest.approx(195, abs=5)
    folded = {t.track: t for t in G.apply(notes, 114.0)[0].first().tracks}
    assert folded["bass"].latency_ms == pytest.approx(195 - 15 / 114 * 1000, abs=5)
    G.release()
