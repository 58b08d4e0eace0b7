"""Histogram sort: against a plain sort, with groups of copies, ties and texts larger than a shard."""

import hashlib
import random
import zlib

import pytest

from tests.llm.test_operators import DOCS, hard_rows, sentence
from tests.oracle import connect, same
from tonewright.llm import queries, shards


def brute(rows, n=8, tolerance=shards.TOLERANCE):
    keyed = []
    for i, text in rows:
        body = (text or "").encode()
        keyed.append((int(hashlib.md5(body).hexdigest()[:15], 16), i is not None, i or 0, len(body) + 1, zlib.crc32(body)))
    keyed.sort()
    total, below, spots = sum(r[3] for r in keyed), 0, []
    for r in keyed:
        spots.append((below, below + r[3]))
        below += r[3]
    edges = []
    for j in range(1, n):
        for r, (a, b) in zip(keyed, spots):
            if a * n <= j * total < b * n:
                same = [s for q, s in zip(keyed, spots) if q[0] == r[0]]
                low, high = same[0][0], same[-1][1]
                if min(j * total - low * n, high * n - j * total) * tolerance[1] > total * tolerance[0]:
                    low, high = a, b
                edges.append(low if j * total - low * n <= high * n - j * total else high)
    out, slots = [], {}
    for r, (a, _) in zip(keyed, spots):
        shard = sum(e <= a for e in edges)
        out.append((r[2] if r[1] else None, r[3], r[4], "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"probes": 3}, {"shards": 3, "tolerance": (0, 1)}, {"shards": 1}, {"shards": 40, "tolerance": (1, 2), "probes": 5}])
def test_hard(spark, options):
    got = shards.place(spark.createDataFrame(hard_rows(), DOCS), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in hard_rows()], options.get("shards", 8), options.get("tolerance", shards.TOLERANCE))


def test_one_group_of_half_of_all(spark):
    rng = random.Random(3)
    rows = [(i, "the same text again") for i in range(3000)] + [(-i * 10**15, sentence(rng, 2)) for i in range(1, 2500)] + [(None, "the same text again")] * 400 + [(5, "the same text again")] * 300
    rng.shuffle(rows)
    got = shards.place(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), probes=16)
    found = list(map(tuple, got.collect()))
    assert sorted(found, key=str) == brute(rows)
    size = [sum(r[1] for r in found if r[4] == s) for s in range(8)]
    assert max(size) < 1.03 * min(size)
    # All other texts are in one shard each.
    where = {}
    for r in found:
        where.setdefault(r[2], set()).add(r[4])
    assert all(len(s) == 1 for c, s in where.items() if c != zlib.crc32(b"the same text again"))


def test_a_stretch_holds_few_rows(spark):
    rows = shards.keyed(spark.createDataFrame([(i % 50, "copy") for i in range(5000)] + [(i, str(i)) for i in range(5000)], "doc_id long, text string")).coalesce(1)
    from pyspark.sql import functions as F

    from tonewright.llm import common

    rows = common.settle(rows, "keys").withColumn("place", F.monotonically_increasing_id())
    told = shards.stretches(rows)[1]
    assert told.agg(F.max("rows")).first()[0] <= 10_000 // 1024 and told.agg(F.sum("rows")).first()[0] == 10_000


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert shards.place(none).collect() == [] and shards.assign(none, keep=True).columns[0] == "row"


def test_text_larger_than_a_shard(spark):
    rows = [(1, "word " * 600_000), (2, "w"), (3, ""), (4, None), (5, "x" * 1000)]
    got = shards.place(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_write(spark, tmp_path):
    rows = [(*r, "mine") for r in hard_rows()]
    df = spark.createDataFrame(rows, DOCS + ", _slot string")
    own = shards.write(df, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert own == "__" and sorted(map(tuple, back.select(df.columns).collect()), key=str) == sorted(rows, key=str)
    want = sorted((r[4], r[5]) for r in brute([r[:2] for r in rows], 3))
    assert sorted((r["__shard"], r["__slot"]) for r in back.collect()) == want


def test_native(spark, sf):
    plan = queries.QUERIES["op13_shards"](spark, sf)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_sql(spark, sf):
    assert same(queries.QUERIES["op13_shards"](spark, sf).toPandas(), connect(sf).sql(queries.ORACLES["op13_shards"]).df())
