"""Greedy matching without lists of pairs."""

import random

import numpy as np
import pytest

from tonewright.operators import signal as A


def every_pair(refs, ests, tolerance):
    pairs = sorted((abs(r - e), r, i, e, j) for i, r in refs for j, e in ests if abs(r - e) <= tolerance)
    used_r, used_e, out = set(), set(), []
    for d, _, i, _, j in pairs:
        if i not in used_r and j not in used_e:
            used_r.add(i)
            used_e.add(j)
            out.append((i, j, d))
    return sorted(out)


@pytest.mark.parametrize("places,n", [(5, 40), (400, 60), (10**9, 80)])
def test_greedy_is_that_of_all_pairs(places, n):
    """Few places: copies at one time and ties of distances; many: plain onsets."""
    rng = random.Random(places)
    for _ in range(60):
        draw = lambda k: [(i, rng.randrange(places) / places) for i in rng.sample(range(1000), rng.randrange(1, k))]
        refs, ests = draw(n), draw(n)
        points = sorted([(t, 0, i) for i, t in refs] + [(t, 1, i) for i, t in ests])
        t, e, ids = (np.array([p[k] for p in points]) for k in range(3))
        for tolerance in (0.0, 0.05, 0.3):
            assert sorted(A.greedy(t, e, ids, tolerance)) == every_pair(refs, ests, tolerance)


def test_dense_copies_need_no_pairs(spark):
    """A track of 40,000 onsets in one second has 160 million pairs within the tolerance."""
    rows = spark.range(40_000).selectExpr("0L AS song_id", "'t' AS track", "id AS note_id", "CAST(id % 7 AS INT) AS pitch", "(id % 1000) / 1000D AS start_s")
    f = A.onset_f1(rows, rows.where("note_id % 4 <> 0")).first()
    assert (f.r, f.e, f.m) == (40_000, 30_000, 30_000)
    f = A.onset_f1(rows, rows, same_pitch=True).first()
    assert f.m == 40_000
