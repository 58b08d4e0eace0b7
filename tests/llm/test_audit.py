"""Filter audit: against plain counting, with colliding hashes, and copies that meet in every way."""

import itertools
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from tests.llm.test_operators import DOCS, hard_rows
from tests.oracle import connect, same
from tonewright.llm import audit, queries

MARKS = "doc_id long, quality int, toxic int, text string"


def failing(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text) is not None, i is not None and i > least[text]]
        out.append((i, part or "", {c for c, f in zip("ABCDE", found) if f}))
    return out


def brute(rows, labels):
    rows = failing(rows)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    out = []
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        removed = Counter()
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                go = [i for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                removed[c] += len(go)
                lines.append((c, "".join(order), step, len(left), len(go), sum(c in f for _, f in own) - len(go), sum(f == {c} for _, f in own), sum(i in good for i in go), sum(i in toxic for i in go)))
        out += [(part, *x[1:], removed[x[0]]) for x in lines]
    return sorted(out)


def test_hard(spark):
    rows = hard_rows() + [(40, hard_rows()[0][1], "de", None, None, 0, 0, 0.0, 0, 0, 0, "", "", 0), (41, "GOOD # " * 150, "", *[None] * 11)]
    labels = [(1, 1, 0, "x"), (2, 1, 1, "x"), (2, 1, None, "y"), (None, 1, 1, "z"), (12, 0, 1, None), (77, 1, 1, ""), (41, None, 1, "")]
    got = audit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, MARKS))
    assert sorted(map(tuple, got.collect())) == brute([(r[0], r[1], r[2]) for r in rows], [r[:3] for r in labels])


def test_empty(spark):
    none, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], MARKS)
    assert audit.audit(none, marks).count() == 0
    got = audit.audit(spark.createDataFrame(hard_rows(), DOCS), marks)
    assert sorted(map(tuple, got.collect())) == brute([r[:3] for r in hard_rows()], [])


@pytest.mark.parametrize("held", [audit.HELD, 50])
@pytest.mark.parametrize("collide", [False, True])
def test_routes(monkeypatch, held, collide):
    rng = random.Random(1)
    monkeypatch.setattr(audit, "HELD", held)
    if collide:  # every hash is the same: chains hold the texts apart
        monkeypatch.setattr(audit, "xxhash", SimpleNamespace(xxh64_intdigest=lambda *_: 5))
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", "a", "b # c", "x y " * 60, "copy"]), rng.choice([None, "en", "de"])) for _ in range(400)]
    sent = [x for k in range(5) for x in audit._own([(i, p, t) for i, t, p in rows[k::5]])]
    got = Counter()
    for i, part, mask, n in audit._met(sorted(sent, key=lambda x: x[0])):
        got[i, part, mask] += n
    assert got == Counter((i, p, sum(1 << "ABCDE".index(c) for c in f)) for i, p, f in failing(rows))


def test_copies_send_one_record_a_task():
    sent = list(audit._own([(i, "en", "same text") for i in range(1000, 0, -1)]))
    assert sum(value[0] is not None for _, value in sent) == 1 and len({key for key, _ in sent}) == 1000


def test_very_long_text(spark):
    rows = [(1, "word " * 600_000, "en"), (2, "W" * 3_000_000, "en"), (3, "word " * 600_000, "en")]
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], MARKS))
    assert sorted(map(tuple, got.collect())) == brute(rows, [])


def test_sql(spark, sf):
    assert same(queries.QUERIES["op12_filter_audit"](spark, sf).toPandas(), connect(sf).sql(queries.ORACLES["op12_filter_audit"]).df())
