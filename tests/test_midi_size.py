"""Files are written and read by columns: what a note takes in memory is a few bytes, not objects."""

import tracemalloc

import numpy as np

from tonewright.sources import midi

N = 60_000


def long_track(rng):
    start = np.sort(rng.integers(0, 4 * N, N)) / 100
    return midi.Track("piano", 3, False, list(zip(rng.integers(20, 100, N).tolist(), rng.integers(1, 128, N).tolist(), start.tolist(), (start + rng.integers(1, 300, N) / 100).tolist())))


def peak(f) -> float:
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_bytes_of_each_note():
    data = midi.write([long_track(np.random.default_rng(1))])
    assert sum(1 for _ in midi.rows("", data)) == N

    def read():
        for _ in midi.slabs(midi.rows("", data)):
            pass

    midi.SLAB, was = 2000, midi.SLAB
    try:
        assert peak(read) < 140 * N
    finally:
        midi.SLAB = was


def test_slabs_do_not_change_the_file(monkeypatch):
    track = long_track(np.random.default_rng(2))
    tempi = [(0, 90.0), (4800, 133.0), (96000, 61.0)]
    whole = midi.write([track], tempi=tempi)
    monkeypatch.setattr(midi, "SLAB", 777)
    assert midi.write([track], tempi=tempi) == whole
