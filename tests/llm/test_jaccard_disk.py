"""The n-gram join keeps little on disk: counts in bytes, lists a share at a time."""

import numpy as np
import pyarrow as pa

from tonewright.llm import jaccard


def test_counts_of_a_slab_come_back():
    rng = np.random.default_rng(3)
    for part in (np.zeros(1024), rng.integers(0, 2, 1024) * (np.arange(1024) % 9 == 0), rng.integers(0, 70000, 1024), np.full(1024, 255), rng.poisson(1, 1024)):
        part = np.minimum(part, 0xFFFF).astype("<u2")
        total = np.zeros(1024, np.int64)
        for data in jaccard.packed(part):
            jaccard.unpack(data, total)
        assert (total == part).all()
    assert sum(map(len, jaccard.packed(rng.poisson(1, 1 << 16).astype("<u2")))) == 1 << 16  # a byte each


def test_shares_of_the_keys_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, jaccard.join(docs).collect()))
    monkeypatch.setattr(jaccard, "LISTS", 1000)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == want
    assert any(row[3] for row in want)



def test_texts_that_meet_by_chance_make_no_cluster(spark, monkeypatch):
    """40 long texts, each with one shingle of the next: no two link, so no text needs to be fetched. In a
    large table the sketch can't tell such a shingle from those of one text."""
    words = lambda k: [f"w{k}x{i}" for i in range(120)]
    rows = [(k, " ".join([*words(k), *words(k + 1)[:5]])) for k in range(40)]
    rows += [(100, " ".join(words(7) + words(900)[:3])), (101, " ".join(words(7) + words(901)[:3]))]
    monkeypatch.setattr(jaccard, "sketch", lambda docs: (np.zeros(1 << jaccard.SLOT_BITS, np.uint8), np.bincount([121] * 42, minlength=256)))
    seen, settle = {}, jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, label: seen.setdefault(label, settle(df, label)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(40)} | {7: 7, 100: 7, 101: 7}
    assert {r["node"] for r in seen["members"].collect()} == {7, 100, 101}


def test_counted_and_chained_lists_keep_all_links(monkeypatch):
    """Whatever lists are counted, pairs that link stay together, however the rows are cut into batches."""
    rng, level, light = np.random.default_rng(5), np.zeros(1 << jaccard.SLOT_BITS, np.uint8), 6
    sets = []
    for n in (4, 6, 7, 12, 45, 60, 160, 400):
        base = rng.integers(1, 1 << 62, n).astype(np.uint64)
        for _ in range(12):
            change = rng.random(n) < 0.07
            sets.append(np.unique(np.where(change, rng.integers(1, 1 << 62, n).astype(np.uint64), base)))
    size = np.array([len(x) for x in sets])
    of, key = jaccard.keys_of(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), size, level, light)
    rows = sorted((int(k), int(size[s]), int(s)) for s, k in zip(of, key.view(np.int64)))
    rows += [rows[-1]] * 3  # copies
    true = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(both := np.intersect1d(sets[a], sets[b])) >= 80 * (size[a] + size[b] - len(both))}
    assert len(true) > 100
    for counted, always, spent, step in ((128, 4, 1, 2000), (128, 128, 1, 7), (5, 2, 1, 13), (0, 0, 0, 5), (3, 3, 0, 100_000)):
        for name, value in (("COUNTED", counted), ("ALWAYS", always), ("SPENT", spent)):
            monkeypatch.setattr(jaccard, name, value)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + step]], pa.int64()) for c in range(3)], ["key", "n_shingles", "s1"]) for k in range(0, len(rows), step)]
        total: dict = {}
        for batch in jaccard.candidates(iter(batches), light):
            for u, v, shared, need in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = total.get((u, v), (0, 1 << 40))
                total[u, v] = a + shared, min(b, need)
        root = list(range(len(sets)))
        for (u, v), (shared, need) in total.items():
            if shared >= need:
                a, b = root[u], root[v]
                root = [a if x == b else x for x in root]
        assert all(root[a] == root[b] for a, b in true)
