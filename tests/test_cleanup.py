"""Cleanup steps on literal notes, and against the rule written as a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tonewright.operators import cleanup as C
from tonewright.operators import measure as M
from tonewright.schema import CleanupParams

NOTE = "song_id long, track string, note_id long, pitch int, velocity int, start_s double, end_s double, is_drum boolean, program int"


def table(spark, notes):
    return spark.createDataFrame([(0, "t", i, p, v, float(a), float(b), False, 0) for i, (p, a, b, v) in enumerate(notes)], NOTE)


def rows(df):
    return [(r.pitch, round(r.start_s, 6), round(r.end_s, 6)) for r in sorted(df.collect(), key=lambda r: (r.start_s, r.pitch, r.note_id))]


def test_velocity_floor(spark):
    n = table(spark, [(60, 0, 1, 10), (62, 1, 2, 15), (64, 2, 3, 90)])
    assert [r[0] for r in rows(C.velocity_floor(n, 15))] == [62, 64]
    assert C.velocity_floor(n, 0).count() == 3


def test_same_pitch_is_cut_at_its_next_start(spark):
    n = table(spark, [(60, 0, 2, 80), (60, 1, 3, 80), (62, 0.5, 9, 80)])
    assert rows(C.de_overlap(n)) == [(60, 0, 1), (62, 0.5, 9), (60, 1, 3)]


def test_equal_starts_collapse_and_are_swept(spark):
    n = table(spark, [(60, 0, 1, 80), (60, 0, 1, 80)])
    assert rows(C.min_duration(C.de_overlap(n))) == [(60, 0, 1)]


def test_only_long_notes_over_others_are_capped(spark):
    n = table(spark, [(60, 0, 5, 80), (62, 1, 1.5, 80), (64, 3, 9, 80)])
    assert rows(C.duration_cap(n, 2.0, 120.0)) == [(60, 0, 1), (62, 1, 1.5), (64, 3, 9)]


def test_legato_closes_small_gaps_only(spark):
    n = table(spark, [(60, 0, 0.4, 80), (62, 0.5, 0.6, 80), (64, 2, 2.5, 80)])
    assert rows(C.legato(n)) == [(60, 0, 0.495), (62, 0.5, 0.6), (64, 2, 2.5)]


def test_lowest_voice(spark):
    n = table(spark, [(60, 0, 1, 80), (72, 0, 1, 80), (67, 0.5, 2, 80), (70, 1.2, 3, 80)])
    assert [r[0] for r in rows(C.monophonic(n))] == [60, 70]
    assert [r[0] for r in rows(C.monophonic(n, "highest"))] == [72, 70]


def test_silence_of_a_third(spark):
    n = table(spark, [(60, 0, 1, 80), (60, 2, 3, 80)])
    assert M.silence_ratio(n).first().silence_ratio == pytest.approx(0.3333)
    assert M.silence_ratio(table(spark, [(60, 0, 1, 80)])).first().silence_ratio == 0


def test_empty(spark):
    n = table(spark, [])
    for f in (C.clean, C.monophonic, M.silence_ratio, M.onset_dedupe, C.stats):
        assert f(n).count() == 0


def by_loop(notes, p):
    """The cleanup as a loop over one track: (pitch, start, end) of what is left."""
    ns = sorted(([a, q, i, b] for i, (q, a, b, v) in enumerate(notes) if v >= p.velocity_floor), key=lambda n: (n[0], n[1], n[2]))
    if p.monophonic:
        kept = []
        for n in ns:
            if not any(m[0] < n[3] and n[0] < m[3] and m[1] < n[1] for m in kept):
                kept.append(n)
        ns = kept
    for n in ns if p.quantize else []:
        d = (round(n[0] / p.step) * p.step - n[0]) * p.quantize_strength
        n[0], n[3] = n[0] + d, n[3] + d
    ns.sort(key=lambda n: (n[0], n[1]))
    for q in {n[1] for n in ns}:
        same = [n for n in ns if n[1] == q]
        for a, b in zip(same, same[1:]):
            a[3] = min(a[3], b[0])
    starts = sorted({n[0] for n in ns})
    for n in ns:
        later = [s for s in starts if s > n[0] + 1e-6]
        if n[3] - n[0] > p.max_duration_beats * p.beat and later and later[0] < n[3]:
            n[3] = later[0]
    ns = [n for n in ns if n[3] - n[0] >= p.min_duration]
    starts = sorted({n[0] for n in ns})
    for n in ns if p.legato else []:
        later = [s for s in starts if s > n[3] - 1e-9]
        if later and 0 < later[0] - n[3] <= p.legato_max_gap_beats * p.beat:
            n[3] = later[0] - p.legato_gap
    return sorted((n[1], round(n[0], 6), round(n[3], 6)) for n in ns)


@pytest.mark.parametrize("k, p", list(enumerate([CleanupParams(), CleanupParams(legato=True), CleanupParams(monophonic=True), CleanupParams(quantize=True, legato=True), CleanupParams(tempo=90.0, velocity_floor=0, max_duration_beats=1.0)])))
def test_random_notes(spark, k, p):
    rng = random.Random(k)
    t, notes = 0.0, []
    for _ in range(80):
        t += rng.choice([0, 0.05, 0.12, 0.25, 0.5])
        notes.append((rng.randint(40, 72), t, t + rng.choice([0.01, 0.1, 0.3, 1.2, 2.5]), rng.randint(5, 120)))
    got = sorted((r.pitch, round(r.start_s, 6), round(r.end_s, 6)) for r in C.clean(table(spark, notes), p).collect())
    assert got == by_loop(notes, p)


def test_onsets_compare_with_the_last_kept(spark):
    n = table(spark, [(60, s / 1000, 1, 80) for s in (0, 20, 40, 60, 100, 125, 131)])
    assert sorted(round(r.t, 3) for r in M.onset_dedupe(n).collect()) == [0, 0.04, 0.1, 0.131]


@pytest.mark.parametrize("keep", ["lowest", "highest"])
def test_one_voice_of_a_long_island(spark, keep):
    """Sound without a gap for longer than a stretch of the fold."""
    rng = random.Random(3)
    ns = [(rng.randint(40, 90), i * 0.1, i * 0.1 + rng.uniform(0.15, 0.6), 80) for i in range(700)]
    sign, kept = 1 if keep == "lowest" else -1, []
    for q, a, b, _ in sorted(ns, key=lambda n: (n[1], sign * n[0])):
        if not any(m[1] < b and a < m[2] and sign * m[0] < sign * q for m in kept[-40:]):
            kept.append((q, a, b))
    assert [(r[0], r[1]) for r in rows(C.monophonic(table(spark, ns), keep))] == [(q, pytest.approx(a)) for q, a, _ in kept]


@pytest.mark.parametrize("p", [CleanupParams(), CleanupParams(legato=True, monophonic=True), CleanupParams(de_overlap=False, quantize=True, velocity_floor=30)])
def test_stats_in_one_pass(spark, p):
    rng = random.Random(11)
    n = table(spark, [(rng.randint(58, 62), round(rng.uniform(0, 60), 3), 0.0, rng.randint(1, 127)) for _ in range(300)]).withColumn("end_s", F.col("start_s") + F.col("velocity") / 50.0 - F.when(F.col("velocity") % 9 == 0, F.col("velocity") / 50.0 - 0.01).otherwise(0.0))
    got, done = C.stats(n, p).first(), C.clean(n, p)
    assert (got.notes_before, got.notes_after) == (300, done.count())
    assert got.dropped_velocity_floor == n.where(F.col("velocity") < p.velocity_floor).count() > 0
    for name, of in (("before", n), ("after", done)):
        m = C.measures(of, p.step).first()
        for c in ("median_duration", "polyphony", "silence_ratio", "grid_error"):
            assert got[f"{c}_{name}"] == pytest.approx(m[c], abs=2e-4)
    if not p.monophonic:
        assert got.dropped_too_short == 300 - got.dropped_velocity_floor - got.notes_after > 0
    assert (got.trimmed_de_overlap > 0) == p.de_overlap
