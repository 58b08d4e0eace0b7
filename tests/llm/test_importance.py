"""Importance resampling: against strings written out, on hard tables, and with larger runs of words."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import DOCS, hard_rows
from tests.oracle import connect, same
from tonewright.llm import importance, queries


def brute(rows, target, most=1, buckets=10_000, seed=2024, share=(10, 100), least=20):
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in rows:
        np.add.at(s, runs(text)[1], 1)
    for text in target:
        np.add.at(t, runs(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, found = runs(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * share[0] // share[1]]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


TARGET = ["one two three", None, "", "été 42 one two", "aaaa aaaa"]


@pytest.mark.parametrize("options", [{}, {"most": 3, "buckets": 97, "share": (1, 2), "least": 2}, {"share": (1, 1), "least": 0}, {"share": (0, 1)}])
def test_hard(spark, options):
    df, target = spark.createDataFrame(hard_rows(), DOCS), spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.scores(df, target, **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([r[:2] for r in hard_rows()], TARGET, **options)


def test_empty(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.scores(none, target).count() == 0 and importance.select_texts(none, target).columns == none.columns
    some = spark.createDataFrame(hard_rows(), DOCS)
    assert sorted((tuple(r) for r in importance.scores(some, none).collect()), key=str) == brute([r[:2] for r in hard_rows()], [])


def test_runs_are_never_written_out():
    texts = ["Ab c" * 3 + " " + "w" * 500 + " é日本 x", "", "a", "one two  three-four five", "z" * 70, "日" * 40]
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, found = importance.features(np.frombuffer("".join(texts).encode(), np.uint8), off, 4)
    for k, (doc, crc) in enumerate(found, 1):
        want = []
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            want += [(i, zlib.crc32(" ".join(w[j : j + k]).encode())) for j in range(len(w) - k + 1)]
        assert list(zip(doc.tolist(), crc.tolist())) == want


def test_shift_of_any_length():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 1000, 123_457, 1 << 20):
        a, b = rng.bytes(9), rng.bytes(n)
        got = importance.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


def test_select_keeps_rows(spark):
    df, target = spark.createDataFrame(hard_rows(), DOCS), spark.createDataFrame([(t,) for t in TARGET], "text string")
    drawn = importance.select_texts(df, target, share=(1, 2), least=2)
    want = [r[0] for r in brute([r[:2] for r in hard_rows()], TARGET, share=(1, 2), least=2) if r[4]]
    assert drawn.columns == df.columns and sorted(map(str, want)) == sorted(str(r.doc_id) for r in drawn.collect())


def test_very_long_text(spark):
    rows = [(1, "word " * 600_000), (2, "w" * 3_000_000), (3, "short text of words " * 9)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word",)], "text string")
    assert sorted((tuple(r) for r in importance.scores(df, target).collect()), key=str) == brute(rows, ["word"])


def test_many_tied_rows(spark):
    rows = [(7, "a b c " * 7)] * 300 + [(i, "a b d " * 7) for i in range(50)]
    df, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("a b",)], "text string")
    assert sorted((tuple(r) for r in importance.scores(df, target, share=(1, 2)).collect()), key=str) == brute(rows, ["a b"], share=(1, 2))


def test_sql(spark, sf):
    assert same(queries.QUERIES["op11_importance"](spark, sf).toPandas(), connect(sf).sql(queries.ORACLES["op11_importance"]).df())


def test_batches_without_rows():
    assert importance.features(*importance.buffers(pa.array([], pa.string())), 3)[1][2][0].size == 0
