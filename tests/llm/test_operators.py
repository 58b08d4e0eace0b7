"""The ten operators on hard tables, and against brute force on small ones."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tonewright.llm import ann, chat, common, dac, decontaminate, htmltext, jaccard, langid, mixing, quality, queries, suffixes
from tonewright.llm.crf import Chains, Crf

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, score double, h1 int, cluster int, place int, epoch string, gram string, _take int"
#: Columns of other names that operators use inside.
CLASH = ("k", 1, 0.5, 2, 3, 4, "e", "g", 9)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def hard_rows():
    rng = random.Random(4)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(words))
    long = "\n".join(sentence(rng, 40) for _ in range(400))
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"), (9, "éÉ ñ 日本 ½ don't"), (10, long), (11, long + " tail"), (11, "again eleven"), (12, "x"), (12, "x"), (None, base), (None, None), (13, "aaaa " * 300), (14, "ab" * 400), (15, "<|endoftext|> text"), (16, sentence(rng, 30) + base), (17, "\u0000\u0001   odd space")]
    return [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", None, *CLASH) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- suffixes ------------------------------------------------------------------------

def removed(bodies, length=200):
    raw = [(b or "").encode() for b in bodies]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), spans, hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("hot, chunk", [(suffixes.HOT, suffixes.CHUNK), (2, suffixes.CHUNK), (suffixes.HOT, 3)])
def test_suffixes_hard(hard, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    listed = texts(hard)
    want = Counter((i, *w) for (i, _), w in zip(listed, removed([t for _, t in listed])))
    assert Counter(tuple(r) for r in suffixes.dedup(hard).drop("spans").collect()) == want


def test_suffixes_planted(spark):
    rng = random.Random(8)
    passage = sentence(rng, 60)
    rows = []
    for i in range(60):
        body = sentence(rng, rng.randint(5, 60))
        if i % 3 == 0:
            cut = rng.randint(0, 80)
            body = body[: rng.randint(0, len(body))] + passage[cut : cut + rng.randint(150, 400)] + body
        rows.append((i, body))
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()}
    assert got == dict(enumerate(removed([t for _, t in rows])))


def test_suffix_classes():
    """Windows that repeat, by sorted suffixes and prefixes, against a count of (distance, bytes)."""
    rng = np.random.default_rng(4)
    length, reach = suffixes.LENGTH, suffixes.REACH
    base = rng.integers(0, 256, (3, reach - 1 + length)).astype(np.uint8)
    parts, da, db = [], [], []
    for _ in range(80):
        own = base[rng.integers(0, 3)].copy()
        # Bytes before and after the suffix differ from some place on; zeros stand at ends, too.
        for _ in range(int(rng.integers(0, 3))):
            own[rng.integers(0, len(own))] = rng.integers(0, 2)
        a = int(rng.integers(0, reach))
        b = int(rng.integers(0, a + 1))
        parts.append(own[reach - 1 - a : reach - 1 - b + length])
        da.append(a)
        db.append(b)
    seen = Counter((d, part[a - d : a - d + length].tobytes()) for part, a, b in zip(parts, da, db) for d in range(b, a + 1))
    want = [(k, w) for k, (part, a, b) in enumerate(zip(parts, da, db)) for w in range(a - b + 1) if seen[a - w, part[w : w + length].tobytes()] > 1]
    begin = np.cumsum([0] + [len(x) for x in parts[:-1]])
    row, within = suffixes.repeated(np.concatenate(parts), begin, np.array(da), np.array(db))
    assert list(zip(row.tolist(), within.tolist())) == want and 0 < len(want) < sum(len(x) - length + 1 for x in parts)


def test_suffixes_line_in_every_document(spark):
    rng = random.Random(12)
    line = sentence(rng, 60)
    rows = [(i, f"{sentence(rng, rng.randint(1, 30))} {line} {sentence(rng, rng.randint(1, 30))}") for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, "ab" * 400), (302, "c" * 199)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in suffixes.dedup(docs).drop("spans").collect()}
    assert got == dict(zip([i for i, _ in rows], removed([t for _, t in rows])))


def test_multikey_order():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = suffixes.multikey_order(words)
    assert words[order].tolist() == sorted(words.tolist())
    assert group[-1] + 1 == len({tuple(w) for w in words.tolist()})


# --- n-gram join ----------------------------------------------------------------------

def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """(doc_id, set size, least reachable id) of each row; rows of one id are one node."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)) or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k), i) if sets[k] else i) for k, (i, _) in enumerate(rows))


def test_jaccard_hard(hard):
    got = jaccard.join(hard).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == classes(texts(hard))


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_jaccard_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = sentence(rng, rng.choice([3, 5, 6, 9, 12, 14, 20, 60])).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "w%d" % rng.randint(0, 99)
            rows.append((len(rows), " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == classes(rows)


@pytest.mark.parametrize("share,slab,pairs", [(jaccard.SHARE, jaccard.SLAB, jaccard.PAIRS), (10_000, 7, 50), (1, 3, 20)])
def test_links_equal_all_pairs(monkeypatch, share, slab, pairs):
    """Heavy and light lists give the overlaps of all pairs, wherever the boundary lies."""
    for name, value in (("SHARE", share), ("SLAB", slab), ("PAIRS", pairs)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 80))
        base = rng.integers(0, 1 << 60, 40).tolist()
        sets = [set(base[: rng.integers(1, 40)]) | set(rng.integers(0, 200, rng.integers(0, 5)).tolist()) for _ in range(n)]
        size, copies, side = np.array([len(s) for s in sets]), rng.integers(1, 4, n), rng.integers(0, 2, n)
        doc, value = np.repeat(np.arange(n), size), np.array([v for s in sets for v in sorted(s)], np.uint64)
        for across in (False, True):
            near = [[b for b in range(n) if a != b and (not across or side[a] != side[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])] for a in range(n)]
            root = [-1] * n
            for x in range(n):
                todo = [x] if root[x] < 0 else []
                while todo:
                    y = todo.pop()
                    if root[y] < 0:
                        root[y] = x
                        todo += near[y]
            got = jaccard.links(doc, value, size, copies, side, across)
            assert got[0].tolist() == root and got[1].tolist() == [copies[y].sum() for y in near]


def test_members_by_broadcast_or_shuffle(spark, monkeypatch):
    rng = random.Random(16)
    base = sentence(rng, 60).split()
    rows = [(k, " ".join(w if rng.random() > 0.01 else "new" for w in base)) for k in range(40)] + [(100 + k, sentence(rng, 20)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.join(docs).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, jaccard.join(docs).collect())) == want


def test_jaccard_keys_meet(spark):
    """Every two sets that link share a key, light or heavy, whatever the boundary."""
    rng = np.random.default_rng(2)
    for light in (1, 5, 9, 20):
        level = np.zeros(1 << jaccard.SLOT_BITS, np.uint8)
        for _ in range(300):
            n = int(rng.integers(2, 40))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, 1 + len(a) // 5))], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 5))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            of, key = jaccard.keys_of(doc, np.concatenate([a, b]), np.array([len(a), len(b)]), level, light)
            assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())


def test_one_of_each_class_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, None), (5, "other words are in this one here"), (9, None)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 9]


# --- token ids --------------------------------------------------------------------------

def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50257, 5000), rng.integers(0, 2**32, 700), np.zeros(3, int), np.array([255, 256, 65535, 65536]), np.zeros(0, int)):
        read = dac.Reader(dac.encode(ids))
        assert len(read) == len(ids) and (read.all() == ids).all()
        assert [read.token(i) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    with pytest.raises(IndexError):
        dac.Reader(dac.encode(np.array([1]))).token(1)


def test_tokens_hard(hard, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, t in sorted(texts(hard), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, dac.write_and_read(hard).collect()), key=str) == sorted(want, key=str)
    assert dac.write_and_read(empty).count() == 0


def test_pretokens_are_those_of_the_library():
    import public_tokenizers

    encoder = dac.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    parts = ["'s", "'", "''s", "don't", " 'll", "\n", "\n\n", " ", "  ", "   x", "\t", "é", " É", "日本", "½", "a1", "!?", " !", "<|endoftext|>", "I'm", " ", "😀", "'LL", "'ve", "\r\n", "Ͱ"]
    listed = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)] + [None, ""]
    ids, n = encoder(pa.array(listed))
    for text, got in zip(listed, np.split(ids, np.cumsum(n)[:-1])):
        assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == got.tolist(), repr(text)


# --- quality -----------------------------------------------------------------------------

def test_crf_equals_enumeration():
    rng = np.random.default_rng(0)
    model = Crf(3)
    model.w, model.b, model.t, model.s = rng.normal(size=3), 0.3, rng.normal(size=(2, 2)), rng.normal(size=2)
    first = np.array([0, 4, 4, 5, 9])
    x = rng.normal(size=(9, 3))
    e = model.emission(x)
    p, y = model.marginals(x, Chains(first)), model.viterbi(x, Chains(first))
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        scores = {}
        for k in range(2**n if n else 0):
            lab = [k >> j & 1 for j in range(n)]
            scores[tuple(lab)] = model.s[lab[0]] + sum(e[a + j] * lab[j] for j in range(n)) + sum(model.t[u, v] for u, v in zip(lab, lab[1:]))
        if n:
            z = sum(np.exp(v) for v in scores.values())
            for j in range(n):
                assert p[a + j] == pytest.approx(sum(np.exp(v) for lab, v in scores.items() if lab[j]) / z)
            assert tuple(y[a:b]) == max(scores, key=scores.get)


def junk(rng, kind, n):
    w = [sentence(rng, 1)[:-1] for _ in range(n)]
    return {0: " ".join(x + "!!" for x in w).upper(), 1: " | ".join(w), 2: " ".join(x + rng.choice(["***", "###", "%%%"]) for x in w), 3: " ".join(w[0] for _ in w)}[kind]


def test_bounded_samples(spark, monkeypatch):
    """Keys of least hash whose sizes fit together; repeats once, what can't fit alone left out."""
    rows = [(k, k % 2, 10 + k, str(k)) for k in range(40)] + [(3, 1, 13, "3")] * 5 + [(50, 0, 1000, "long")]
    df = common.settle(spark.createDataFrame(rows, "k long, y int, n int, more string"), "fixture")
    everything = common.within(df, "k", "n", 10_000, "y").collect()
    assert sorted(r.k for r in everything) == [*range(40), 50]
    got = common.within(df, "k", "n", 200, "y").collect()
    for y in (0, 1):
        mine = [r.n for r in got if r.y == y]
        assert 150 < sum(mine) <= 200
    assert len({r.k for r in got}) == len(got) and 50 not in {r.k for r in got}
    assert common.within(df.limit(0), "k", "n", 200, "y").count() == 0
    assert sum(r.n for r in common.within(df, "k", "n", 200).collect()) <= 200

    rng = random.Random(2)
    lines = lambda i: junk(rng, i % 4, 60).replace(" ", "\n", 3) if i % 3 == 0 else "\n".join(sentence(rng, 12) for _ in range(4))
    rows = [(i, lines(i)) for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:30] * 3 + [(301, "x\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(301, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "SAMPLE_LINES", 300)
    got = [(r.predicted, int(r.doc_id % 3 != 0)) for r in quality.score(docs, *quality.fit(docs, labels)).collect() if r.held_out and r.doc_id < 300]
    assert np.mean([a == b for a, b in got]) > 0.95


def test_quality_held_out(spark, empty, hard):
    rng = random.Random(1)
    rows = [(i, junk(rng, i % 4, 60) if i % 3 == 0 else "\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(4)), int(i % 3 != 0)) for i in range(400)] + [(1000, None, 1), (1001, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, *quality.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].predicted, y) for i, t, y in rows if got[i].held_out and t]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}
    assert quality.score(hard, *quality.fit(hard, labels.limit(0))).count() == hard.count()
    assert quality.score(empty, *quality.fit(empty, labels)).count() == 0


# --- structured words ----------------------------------------------------------------------

def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def opposites(n):
    word = thue_morse(n)
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [128, 1024, 2048, 8192])
def test_structured_words_differ(spark, n):
    """Thue-Morse words and their complements, equal under polynomial hashes modulo 2**64."""
    import public_tokenizers

    x, y = opposites(n)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, size = dac.PieceEncoder(path)(pa.array([x, y, f"{x} {y}"]))
    whole = [dac.PieceEncoder(path).tokenizer.encode(t, add_special_tokens=False).ids for t in (x, y, f"{x} {y}")]
    assert ids.tolist() == sum(whole, []) and size.tolist() == list(map(len, whole))
    docs = spark.createDataFrame([(1, x), (2, y), (3, x), (4, f"{y} {x}"), (5, f"{x} {y}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    items = spark.createDataFrame([(7, f"one two {x} three four")], "item_id long, text string")
    held = spark.createDataFrame([(1, f"one two {x} three four"), (2, f"q r {y} s t")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find(held, items).collect()] == [1]
    lines = quality.Lines(*quality.buffers(pa.array([f"{x}\n{y}", f"{x}\n{x}"])))
    assert lines.own()[:, 12].tolist() == [0, 0, 0, 1]
    listed = texts(docs)
    assert Counter(tuple(r) for r in suffixes.dedup(docs).drop("spans").collect()) == Counter((i, *w) for (i, _), w in zip(listed, removed([t for _, t in listed])))


def test_remembered_pre_tokens_are_held_against_the_bytes(monkeypatch):
    """Where all hashes of a length are one, the ids are still the library's."""
    import public_tokenizers

    monkeypatch.setattr(dac, "slices", lambda raw, a, b: ((b - a).astype(np.uint64) << np.uint64(1), SLICES(raw, a, b)[1]))
    encoder = dac.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ["the cat and the dog sat on a mat", "extraordinary circumstances, internationalisation of electroencephalographs", "don't we'll"]
    for _ in range(2):
        ids, _ = encoder(pa.array(rows))
        assert ids.tolist() == sum((encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in rows), [])


SLICES = dac.slices


# --- language ---------------------------------------------------------------------------

def longest_pieces(known, text):
    """Greedy parse by search. A sign that isn't known begins a piece, which what follows continues."""
    n, piece = 1 if text else 0, b""
    for k in range(len(text)):
        c = text[k : k + 1]
        if piece + c in known:
            piece += c
        else:
            n, piece = n + 1, c if c in known else b""
    return n


@pytest.mark.parametrize("segment", [langid.SEGMENT, 1, 3, 16])
def test_automata_parse_like_a_search(monkeypatch, segment):
    """Whole texts in one go, over the seams of segments and inside code points of several bytes."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(0)
    known = {"x": "".join(rng.choices("abcé ж", k=300)).encode(), "y": "".join(rng.choices("abdü日 ", k=300)).encode()}
    model = langid.Model(known)
    texts_ = ["".join(rng.choices("abcdeé ж日", k=rng.choice([0, 1, 5, 50, 3000]))).encode() for _ in range(60)] + [known["x"] * 20, b"abab" * 900, known["y"][:200]]
    raw, off = np.frombuffer(b"".join(texts_), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
    took = model.pieces_of(raw, off)
    for k, lang in enumerate(model.langs):
        assert took[:, k].tolist() == [longest_pieces(known[lang], t) for t in texts_]


def test_language_sample_takes_whole_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, sentence(rng, 40), "en") for k in range(300)] + [(1000 + k, sentence(rng, 9000), "xx") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tidied = {lang: {" ".join(langid.normal(np.frombuffer(t.encode(), np.uint8)).tobytes().decode().split()) for i, t, x in rows if x == lang} for lang in ("en", "xx")}
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 6000)
    held = langid.sample(docs)
    assert 4000 < len(held["en"]) <= 6100
    rest = held["en"].decode()
    for t in sorted(tidied["en"], key=len, reverse=True):
        rest = rest.replace(" " + t, "", 1)
    assert not rest  # nothing but whole texts
    assert held["xx"].decode().strip() in tidied["xx"]  # none fits: one, whole


def test_most_frequent_languages(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, sentence(rng, 20), ["aa", "bb", "cc", "bb"][k % 4]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.sample(docs)) == {"aa", "bb", "cc"}
    monkeypatch.setattr(langid, "LANGS", 1)
    assert set(langid.sample(docs)) == {"bb"}
    assert {r.lang_pred for r in langid.predict(docs, langid.sample(docs)).collect()} == {"bb"}


def test_languages(spark, sf, empty):
    docs = common.table(spark, sf, "documents")
    rows = langid.predict(docs, langid.sample(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "", None), (None, "the and of", "en"), (5, "the", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(odd, langid.sample(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[None].lang_pred == "en" and not got[None].held_out and 0 < got[5].score <= 1
    assert langid.predict(empty, langid.sample(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def test_letters_and_short_languages(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = langid.sample(docs)
    signs = ["😀 👍🏽", "€ 500 – 600", "… — ©", "١٢٣", "２０２４年".replace("年", "")]
    odd = spark.createDataFrame([(k, t) for k, t in enumerate([*signs, "日本", "é", "— ñ", "Ж 5"])], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(odd, held).collect()}
    assert [(got[k].lang_pred, got[k].score) for k in range(len(signs))] == [("und", 0)] * len(signs)
    assert all(got[k].lang_pred in held and got[k].score > 0 for k in range(len(signs), len(got)))
    # A language of short rows only is learned from them, and leaves the others as they are; signs teach nothing.
    short = spark.createDataFrame([(10_000 + k, f"zzyq wvuu qxx {k}", "zq") for k in range(20)] + [(10_100 + k, "—", "signs") for k in range(20)] + [(10_200 + k, "brief", "en") for k in range(20)], docs.schema)
    more = langid.sample(docs.unionByName(short))
    assert more.keys() == held.keys() | {"zq"} and all(more[k] == held[k] for k in held if k != "en")
    rows = langid.predict(docs.unionByName(short), more).join(docs.unionByName(short).select("doc_id", "lang"), "doc_id").where("lang not in ('signs') and doc_id not between 10200 and 10219").collect()
    assert all(r.lang_pred == "zq" for r in rows if r.lang == "zq")
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


# --- nearest neighbours -------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, cell int, shard int, qid long"


def exact(rows, every=20, k=20):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in good:
        if q % every == 0:
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-float(x @ y), i) for i, y in good if i != q)[:k])]
    return out


def test_neighbours_hard(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=4)).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(50)]
    rows += [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [float("nan"), 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VEC)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(table, target=1.0).collect()}
    want = {(q, r): (i, s) for q, r, i, s in exact(rows)}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    assert ann.search(table.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i - 30)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(line, target=1.0).collect()}
    assert len(got) == 60 and got[0, 1] == (1, 870.0) and got[40, 1] == (59, 290.0)
    assert ann.search(table.where("vec_id in (0, 7)")).count() == 1


def test_neighbours_recall(spark, sf):
    docs = common.table(spark, sf, "embeddings")
    p = docs.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding.values).astype(float), p.vec_id.values
    found = defaultdict(set)
    for r in ann.query(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        recall.append(len(found[ids[k]] & set(ids[np.argsort(-s)[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_walk_is_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7), rng.normal(size=5)
    cells = ann.walk(a, b, [1] * 35, 35)
    total = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and total == sorted(total, reverse=True)


# --- pages --------------------------------------------------------------------------------

def test_pages(spark):
    page = "<html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class=ad>Buy now</div><article><h1>Head &amp; tail</h1><p>First  <b>bold</b>\n line of the story, with some words.<br>And more words here.<p>Second paragraph has words too &lt;ok&gt;.</article><footer>&copy; example</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "  "), (5, "u", "<nav><a>only</a></nav><!-- open"), (5, "u", page), (None, "u", page), (6, "u", "<p>" * 3000 + "deep" + "</p>" * 10), (7, "u", "<article><p>Cut off in the mid")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, bits int")
    got = [(r.page_id, r.text, r.n_chars) for r in htmltext.extract(table, htmltext.fit(table)).collect()]
    want = "Head & tail\n\nFirst bold line of the story, with some words. And more words here.\n\nSecond paragraph has words too <ok>."
    assert [t for i, t, _ in got if i in (1, 5, None)].count(want) == 3
    assert {t for i, t, _ in got if i in (2, 3, 4)} == {""} and len(got) == len(rows)
    assert all(n == len(t) for _, t, n in got)
    assert htmltext.extract(table.limit(0), htmltext.fit(table.limit(0))).count() == 0


class Leaves(HTMLParser):
    """Leaf blocks with their open elements, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.held, self.out, self.silent = [], "", [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if self.held.split():
            self.out.append((" ".join(self.held.split()), [t for t, _ in self.open], [v for _, a in self.open for k, v in a if k in ("class", "id")]))
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in htmltext.BLOCKS:
            self.flush()
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            around = [k for k, (name, _) in enumerate(self.open) if name in htmltext.BLOCKS]
            if around and self.open[around[-1]][0] in ("p", *ends):
                del self.open[around[-1] :]
        if tag in htmltext.VOID:
            self.held += " " * (tag == "br")
        else:
            self.open.append((tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in htmltext.BLOCKS:
            self.flush()
        if tag in [name for name, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style", "template", "svg", "iframe", "textarea"} & {name for name, _ in self.open}:
            self.held += data


def test_blocks_equal_another_parser(sf):
    rng = random.Random(12)
    pages = [h for (h,) in connect(sf).sql("select html from pages").fetchall()]
    tags = ["p", "div", "b", "i", "a", "li", "ul", "td", "tr", "table", "section", "math", "object", "canvas", "noscript", "font", "span", "h2"]
    bits = ["<{0}>", "</{0}>", "<{0}>", "</{0}>", "<{0} title=don't>", "<{0} title='a > b'>", '<{0} class="x y" id=z>', "<{0}\n hidden>", "<br>", "<img src=a alt='q'>", "word ", " two words ", "&amp;", "&eacute;", "1 < 2", "<!-- <p>gone</p> -->", "foo<wbr>", "&am<b></b>p;", "&am<i>p;</i>", "<script>if (a < b) x = '<p>';</script>", "<style>p {{}}</style>"]
    pages += ["".join(rng.choice(bits).format(rng.choice(tags)) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for page in pages:
        assert [b[0] for b in htmltext.blocks(page)] == [b[0] for b in Leaves(page).out], page


@pytest.mark.parametrize("page, want", [
    ("<article><p>a one</p><!--><p>b two</p></article>", ["a one", "b two"]),
    ("<p>a<!---></p><p>c</p>", ["a", "c"]),
    ("<p>a<!-- x --!>b</p><p>c</p>", ["ab", "c"]),
    ("<p>a</p><script>x</script foo><p>b</p>", ["a", "b"]),
    ("<p>a</p><style>x</style/><p>b</p><script>y</scriptx><p>z</p></script ><p>c</p>", ["a", "b", "c"]),
    ("<p>super<wbr>cali foo<img src=x>bar a<br>b</p>", ["supercali foobar a b"]),
    ("<p>&am<b></b>p; x &amp; y &lt<b>;</b></p>", ["&amp; x & y <;"]),
])
def test_where_things_end(page, want):
    assert [b[0] for b in htmltext.blocks(page)] == want


def test_quotes_in_bare_values_and_long_pages():
    page = "<article><p title=don't>First paragraph here.</p><p title=can't>Second one.</p><p>with <math><mi>x</mi></math> and <object>fallback</object></p></article>"
    assert [b[0] for b in htmltext.blocks(page)] == ["First paragraph here.", "Second one.", "with x and fallback"]
    began = time.time()
    assert len(htmltext.blocks("<i>" * 50_000 + "<div>x</div>" * 50_000 + "</b>" * 50_000)) == 50_000
    assert len(htmltext.blocks("<p>some text</p>" * 200_000)) == 200_000  # 3 MB
    htmltext.blocks('<p a="' + "x>" * 500_000), htmltext.blocks("<a " * 300_000)
    assert time.time() - began < 60


def test_given_pages_are_extracted_exactly(spark):
    """The table's own pages: what another parser finds in the article outside of other parts."""
    table = common.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in htmltext.query(spark, "/root/testdata/sf0.01").collect()}
    other = {"nav", "header", "footer", "aside", "form"}
    for r in table.collect():
        good = [t for t, tags, _ in Leaves(r.html).out if "article" in tags and not other & set(tags)]
        assert got[r.page_id] == "\n\n".join(good), r.page_id


#: Layouts that the generator of training pages doesn't make; what is good is marked by a trailing sign.
OTHER_LAYOUTS = [
    "<body><div id=wrap><div id=top><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><table><tr><td class=menu><a href=/1>One</a><br><a href=/2>Two</a><td><h1>Storm closes the harbour for a second day§</h1><p>Ferries stayed in port on Tuesday as winds of up to ninety kilometres an hour hit the coast.§<p>The harbour master said that services would start again when the sea allowed it.§</table><div class=footer>Copyright 2019 The Coast Paper. All rights reserved.</div></div>",
    "<body><header><nav><a href=/>Blog</a><a href=/about>About</a></nav></header><main><article><header><h1>How I learned to bake bread§</h1></header><p>It began with a bag of flour that nobody wanted, and an oven that was far too hot.§</p><pre>flour 500 g, water 350 g, salt 10 g, and time, which is the part that people forget.§</pre><p>After a year I can say that patience makes the loaf, and little else does.§</p></article></main><section id=comments><h2>2 comments</h2><div class=comment><p>Great post, thanks for sharing it with us!</p></div><div class=comment><p>Mine never rises. What do I do wrong?</p></div></section><footer><p>Powered by a blog engine</p></footer>",
    "<body><div class='cookie-consent'>We use cookies to make this site better. <button>Accept</button></div><div class='site-nav'><ul><li><a href=a>Start</a><li><a href=b>Docs</a></ul></div><div class='post-content'><h2>Release notes§</h2><p>This release mends a fault in the parser that lost the first line of a file in some cases.§</p><ul><li>Faster start on machines with many cores.§</li><li>Clearer words in the messages about missing files.§</li></ul></div><div class='sidebar'><h3>Related posts</h3><ul><li><a href=x>Older release</a><li><a href=y>Roadmap</a></ul></div><div id=footer><a href=legal>Legal</a> <a href=privacy>Privacy</a></div>",
    "<body><div class=banner-ad>Buy now and save half the price!</div><div class=page><div class=story-body><p>The council voted on Monday to keep the old library open until a new one is built, members said.§</p><div class=advert>Cheap flights from ten pounds</div><p>The vote ended a dispute of three years, in which two of the council's chairs had stepped down.§</p><p>Work on the new building is to start in spring, if the money can be found by then.§</p></div><aside><h4>Most read</h4><ol><li><a href=1>Dog finds owner</a><li><a href=2>Rain again</a></ol></aside></div><form action=/s><label>Search</label><input name=q><button>Go</button></form><footer>© 2020 Example News</footer>",
    "<body><nav class=breadcrumb><a href=/>Home</a> / <a href=/w>Wiki</a></nav><div id=content class=mw-body><h1>Lighthouse§</h1><p>A lighthouse is a tower that gives off light as an aid to ships at sea and on inland waters.§</p><h2>History§</h2><p>Before harbours were laid out, sailors were led by fires on hills, later on raised platforms.§</p><blockquote>The light was seen from forty miles away, wrote a traveller of the second century.§</blockquote></div><div class=navbox><ul><li><a href=a>Towers</a><li><a href=b>Harbours</a></ul></div><div class=footer><p>This page was last edited in March. Text is available under a free licence.</p></div>",
]


def test_other_layouts(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "pages")
    pages = [htmltext.blocks(p) for p in OTHER_LAYOUTS]
    x, first = htmltext.features([[(t.replace("§", ""), *rest) for t, *rest in p] for p in pages])
    y = htmltext.fit(table).viterbi(x, Chains(first))
    want = np.array(["§" in t for p in pages for t, *_ in p])
    both = (want & (y > 0)).sum()
    assert 2 * both / (want.sum() + y.sum()) > 0.9, [t for (t, *_), a, b in zip((b for p in pages for b in p), want, y) if a != b]


def test_pages_of_unseen_layouts():
    model = Crf(1)
    train, test = htmltext.made_pages(300), htmltext.made_pages(150, seed=77)
    x, first = htmltext.features([p for p, _ in train])
    model = Crf(x.shape[1]).fit(x.astype(float), np.array([v for _, y in train for v in y]), first, rounds=100)
    x, first = htmltext.features([p for p, _ in test])
    truth = np.array([v for _, y in test for v in y])
    assert (model.viterbi(x, Chains(first)) == truth).mean() > 0.98


# --- benchmark -------------------------------------------------------------------------------

def local_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_table():
    rng = np.random.default_rng(5)
    a = [rng.integers(4, 40, n).astype(np.uint64) * np.uint64(4) for n in rng.integers(1, 12, 30)]
    b = [np.concatenate([rng.permutation(x), rng.integers(4, 40, 9).astype(np.uint64) * np.uint64(4)]) for x in a]
    best, _ = decontaminate.align(a, b)
    assert best.tolist() == [local_score(x.tolist(), y.tolist()) for x, y in zip(a, b)]


@pytest.mark.parametrize("period, phase", [(3, 0), (3, 1), (4, 0), (4, 1), (4, 3), (5, 2), (7, 0)])
def test_items_with_every_nth_word_replaced(spark, period, phase):
    """Similarity 0.625 where every fourth word is another one, 0.5 where every third is: both are matches."""
    item = sentence(random.Random(3), 60)
    words = item.split()
    edited = " ".join(f"new{k}" if k % period == phase else w for k, w in enumerate(words))
    rng = random.Random(9)
    rows = [(k, sentence(rng, 200)) for k in range(30)] + [(50, sentence(rng, 40) + " " + edited + " " + sentence(rng, 40))]
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, sentence(rng, 60))], "item_id long, text string"), 0.45)
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert got == [(50, 7)]


def test_contaminated(spark, hard, empty):
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(15, 50))) for k in range(20)]
    docs, want = [], set()
    for i in range(120):
        body = sentence(rng, 60)
        if i % 3 == 0:
            k = rng.randrange(20)
            w = items[k][1].split()
            for _ in range(len(w) // 8 if i % 2 else 0):  # edited copies
                w[rng.randrange(len(w))] = "other"
            if i % 9 == 0:
                w.insert(len(w) // 2, "more")
            body += " " + " ".join(w).upper() + " " + sentence(rng, 20)
            want.add((i, k))
        docs.append((i, body))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, " "), (92, "two words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(table, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.keep_clean(table, bench).collect()} == set(range(120)) - {i for i, _ in want}
    assert decontaminate.find(hard, bench).count() == 0 and decontaminate.keep_clean(hard, bench).count() == hard.count()
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(table, bench.limit(0)).count() == 0


def test_short_items_and_signs(spark):
    items = spark.createDataFrame([(1, "Two words"), (2, "alone"), (3, "three small words"), (4, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are two words inside"), (2, "two words"), (3, "...Alone!!!!!!!!!!!!!!!!"), (4, "words two"), (5, "a three small words"), (6, "one two three............ four five six"), (7, "-" * 300), (8, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_seeds) for r in decontaminate.find(docs, items).collect()}
    assert {k for k, (s, _) in got.items() if s == 1} == {(1, 1), (2, 1), (3, 2), (5, 3), (6, 4)}
    assert got[1, 1][1] == got[2, 1][1] == 1


def test_benchmark_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 300)
    rng = random.Random(1)
    items = [(k, sentence(rng, 20)) for k in range(12)]
    docs = [(k, sentence(rng, 10) + " " + t) for k, t in items]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(12)}


def edited(text, every=12):
    return " ".join("other" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def test_rarity_steers_the_cost_only(spark, monkeypatch):
    rng = random.Random(11)
    items = [(k, sentence(rng, 60)) for k in range(2)]
    # Many edited copies make all grams frequent that they share with the one exact copy.
    docs = [(k, sentence(rng, 20) + " " + edited(items[0][1])) for k in range(300)] + [(300, items[0][1])]
    docs += [(301, " ".join(items[1][1].split()[:6])), (302, items[1][1])] + [(303 + k, sentence(rng, 40)) for k in range(20)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, 0) for k in range(301)} | {(302, 1)}
    rows = decontaminate.find(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert {r.doc_id for r in decontaminate.keep_clean(table, bench).collect()} == {301, *range(303, 323)}
    # Nothing rare, and few hits at once: the same rows.
    raw, off = decontaminate.buffers(pa.array([t for _, t in docs], pa.large_string()))
    words, w = decontaminate.word_hashes(raw, off)
    of, _, gram = decontaminate.grams(words, w.first)
    grams = [set(gram[of == k].tolist()) for k in range(len(docs))]
    got = []
    for common_, hits in ((4, 1_000_000), (0, 1_000_000), (0, 30), (4, 30)):
        monkeypatch.setattr(decontaminate, "COMMON", common_)
        monkeypatch.setattr(decontaminate, "BATCH_HITS", hits)
        held = decontaminate.Items([k for k, _ in items], [t for _, t in items])
        df = np.array([sum(x in seen for seen in grams) for x in held.known.tolist()])
        doc, item, similarity, end, n = decontaminate.matches(held.seeds(df, len(docs)), raw, off)
        got.append(sorted(x for x in zip(doc.tolist(), item.tolist(), similarity.tolist(), end.tolist(), n.tolist()) if x[2] >= decontaminate.THRESHOLD))
    assert got == [got[0]] * 4 and {x[:2] for x in got[0]} == want


# --- mixture ------------------------------------------------------------------------------------

def poured(budget, children):
    """{name: (weight, cap)} -> whole tokens of each, by filling up in rounds."""
    left, out, open_ = budget, {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if c * total <= w * left}
        if not full:
            return out | {n: w * left // total for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_[n][1]
        left -= sum(open_[n][1] for n in full)
        open_ = {n: v for n, v in open_.items() if n not in full}
    return out


def test_pouring(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for p in range(60):
        kids = {k: (rng.randint(1, 9), rng.randint(1, 100)) for k in range(rng.randint(1, 7))}
        budget = min(rng.randint(0, 300), sum(c for _, c in kids.values()))
        shares = poured(budget, kids)
        rest = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, v in shares.items() if v < kids[k][1])
        for _, k in rest[: budget - sum(shares.values())]:
            shares[k] += 1
        assert sum(shares.values()) == budget
        want |= {(p, k): v for k, v in shares.items()}
        rows += [(p, k, w, c, budget) for k, (w, c) in kids.items()]
    got = mixing.pour(spark.createDataFrame(rows, "p long, k long, weight long, cap long, budget long"), ["p"], "k")
    assert {(r.p, r.k): r.budget for r in got.collect()} == want


def test_source_weights(spark):
    rows = [(k, "a b c d e f g h i j", "en", ("s0", "s1", "s2")[k % 3]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = lambda **more: dict(mixing.mix(docs, share=(1, 3), epochs=1, **more).groupBy("source").agg(F.sum("take_tokens")).collect())
    def near(got, want):  # what rounding leaves is given to some of them
        return sum(got.values()) == 400 and got.keys() == want.keys() and all(0 <= got[s] - n <= 1 for s, n in want.items())

    assert near(taken(sources=[("s0", 2), ("s2", 0)]), {"s0": 266, "s1": 133}) and near(taken(), {"s0": 133, "s1": 133, "s2": 133})


def test_unusable_children_leave_their_share(spark):
    """A language of weight 0 holds half of web: all that web can't give goes to code."""
    rows = [(k, "a b c d e f g h i j", ("en", "xx", "en")[k % 3], ("w0", "w0", "c9")[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, share=(2, 3), epochs=1, domains=[("web", 3), ("code", 1)], languages=[("en", 1), ("xx", 0)])
    assert dict(got.groupBy("domain").agg(F.sum("take_tokens")).collect()) == {"web": 1000, "code": 1000}
    assert got.where("lang = 'xx'").count() == 0


@pytest.mark.parametrize("bucket", [mixing.BUCKET, 40])
def test_bucket_size_changes_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rng = random.Random(2)
    rows = [(k if k % 9 else None, sentence(rng, rng.randint(1, 12)), "en", "s0") for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), epochs=2, share=(3, 2)).collect()
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert sum(r.take_tokens for r in got) == total * 3 // 2
    assert sum(r.take_tokens < r.n_tokens for r in got) <= 1


def test_mixture_hard(hard, empty):
    rows = mixing.mix(hard, epochs=4, share=(2, 1)).collect()
    assert all(0 < r.take_tokens <= r.n_tokens for r in rows)
    by = Counter()
    for r in rows:
        by[r.epoch] += r.take_tokens
    total = hard.select(F.sum(mixing.n_tokens(F.col("text"))).alias("n")).first().n
    assert sum(by.values()) == total * 2 and all(v <= total for v in by.values())
    assert mixing.mix(empty).count() == 0
    kept = mixing.select_texts(hard, share=(1, 2))
    assert kept.columns == hard.columns
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in kept.collect()) <= total // 2


# --- chat ------------------------------------------------------------------------------------------

def test_tool_calls(spark):
    call = lambda i, name, args, **more: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args, **more}]})
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "assistant", call("a", "find", '{"q": "x", "n": 3}')),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "7"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "late", "content": "8"})),
        (1, 4, "assistant", call("late", "find", '{"n": "three", "q": ""}')),
        (1, 5, "tool", json.dumps({"tool_call_id": "none", "content": "9"})),
        (2, None, "system", None), (None, 0, "system", "x"), (1, 0, "system", "be kind"),
    ]
    schemas = {"find": [("q", "string", True, 1, 5), ("n", "integer", False, 0, 9)]}
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, line string, position int")
    got = chat.link(chat.from_turns(table), schemas).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(1, 8))
    assert [(r.kind, r.call_id, r.linked, r.valid) for r in one[2:]] == [("call", "a", True, True), ("result", "a", True, True), ("call", "late", True, False), ("result", "late", True, True), ("orphan", "none", False, True)]
    assert one[2].line == '{"arguments":{"n":3,"q":"x"},"id":"a","kind":"call","name":"find","role":"assistant","valid":true}'
    assert all(json.loads(r.line) for r in got)
    assert chat.link(chat.from_turns(table.limit(0)), schemas).count() == 0


def test_calls_that_wait(spark):
    rows = [(1, 0, "c", "call", None), (1, 5, "b", "call", "c"), (1, 2, "a", "call", "b"), (1, 1, "x", "call", "y"), (1, 3, "y", "call", "x"), (1, 4, "z", "call", "gone")]
    table = spark.createDataFrame([(c, t, "assistant", k, i, "f", "{}", a, None) for c, t, i, k, a in rows] + [(1, 9, "tool", "result", "b", None, None, None, "done")], "conv_id long, turn long, role string, kind string, call_id string, name string, arguments string, after string, text string")
    order = [r.call_id + r.kind[0] for r in sorted(chat.link(table, {}).collect(), key=lambda r: r.position)]
    assert order.index("cc") < order.index("bc") < order.index("ac") and order.index("bc") < order.index("br") and len(order) == 7


def test_query_orders_calls_that_wait(spark, tmp_path):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": "{}", **({"after": a} if a else {})} for i, a in c]})
    done = lambda i: json.dumps({"tool_call_id": i, "content": "x"})
    rows = [(1, 0, "assistant", call(("c", "b"), ("d", "c"), ("b", "a"))), (1, 1, "assistant", call(("a", None))), (1, 3, "tool", done("a")), (1, 2, "tool", done("c")), (1, 5, "tool", done("b")), (1, 4, "tool", done("d")),
            (2, 0, "assistant", call(("x", "y"), ("y", "x"), ("t", "x"), ("s", "s"), ("g", "gone"))), (2, 1, "tool", done("y")), (None, 0, "assistant", call(("n", "m"), ("m", None)))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(chat.query(spark, str(tmp_path)).where("conv_id is not null").collect(), key=lambda r: (r.conv_id, r.position))
    assert [r.call_id + r.kind[0] for r in got if r.conv_id == 1] == ["ac", "ar", "bc", "br", "cc", "cr", "dc", "dr"]
    assert [r.turn for r in got if r.conv_id == 2] == [0] * 5 + [1] and got[-1].call_id == "y"


def waits_by_hand(calls):
    """(base, depth) of each call that waits, by walking all ways."""
    by = {c[0]: c for c in calls}
    after = {i: [a for a in w if a in by] for i, _, _, w in calls}

    def go(i, seen):
        if not after[i]:
            return None, 0
        best = (-1, 0)
        for a in after[i]:
            if a in seen:
                return "circle"
            far = go(a, seen | {a})
            if far == "circle":
                return far
            best = (max(best[0], by[a][2], far[0] if far[0] is not None else -1), max(best[1], 1 + far[1]))
        return best

    found = {i: go(i, {i}) for i in by}
    return {i: f for i, f in found.items() if f != "circle" and after[i]}


def test_calls_that_wait_for_several(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for conv in range(40):
        n = rng.randint(2, 9)
        calls = []
        for k in range(n):
            pool = [f"c{j}" for j in range(n if conv % 4 == 0 else k)] + ["gone"]
            calls.append((f"c{k}", k, k + rng.randint(0, 6), rng.sample(pool, min(len(pool), rng.choice([0, 1, 1, 2, 3])))))
        want |= {(conv, i): x for i, x in waits_by_hand(calls).items()}
        rows += [(conv, i, t, d, None if not a else a[0] if len(a) == 1 and rng.random() < 0.5 else json.dumps(a)) for i, t, d, a in calls]
    rows += [(99, f"n{k}", k, 100 + k, f"n{k - 1}" if k else None) for k in range(60)]  # a long chain: few rounds
    want |= {(99, f"n{k}"): (99 + k, k) for k in range(1, 60)}
    table = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, done long, after string")
    assert {(r.conv_id, r.call_id): (r.base, r.depth) for r in chat.depths(table).collect()} == want


def test_calls_as_exports_write_them(spark):
    text = json.dumps({"role": "assistant", "content": None, "model": "m", "n": [1, {"b": 2, "a": 1}], "tool_calls": [
        {"id": "a", "type": "function", "function": {"name": "reply", "arguments": '{"text": "hi", "turn": 1}'}},
        {"id": "b", "type": "function", "function": {"name": "reply", "arguments": {"turn": 2, "text": "yo"}}, "after": ["a", "x"]}]})
    rows = [(1, 0, "assistant", text), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "7"})), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": "8"}))]
    got = sorted(chat.link(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.SCHEMAS).collect(), key=lambda r: r.position)
    assert [(r.kind, r.call_id, r.valid) for r in got] == [("call", "a", True), ("message", None, True), ("result", "a", True), ("call", "b", True), ("result", "b", True)]
    assert got[1].line == '{"content":null,"kind":"message","other":{"model":"m","n":[1,{"a":1,"b":2}]},"role":"assistant"}'
    assert json.loads(got[0].line)["arguments"] == {"text": "hi", "turn": 1} and json.loads(got[3].line)["name"] == "reply"


def test_long_turns(spark):
    rows = [(1, 0, "user", "long " * 500_000), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "f", "arguments": json.dumps({"text": "w" * 2_000_000})}]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "x" * 2_000_000}))]
    got = sorted(chat.link(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {}).collect(), key=lambda r: r.position)
    assert [r.kind for r in got] == ["call", "call", "result"] and [len(r.line) > 1_900_000 for r in got] == [True] * 3


def test_turns_keep_what_they_hold(spark):
    texts = ['{"content":"hi","tool_calls":[]}', '{"tool_calls":"x"}', '{"tool_calls":[1,2]}', '{"tool_calls":null,"content":"n"}', '{"tool_calls":{"id":"o"}}', '{"tool_calls":[null]}', '{"tool_calls":[{"id":"p"},7]}', '{"tool_calls":[[{"id":"q"}]]}', '{"tool_calls":[{"id":']
    rows = [(1, k, "system", t) for k, t in enumerate(texts)] + [(1, 20, "assistant", '{"content":"so","tool_calls":[{"id":"a","name":"f","arguments":"{}"},{"id":"b","arguments":{"x":1}}]}'), (1, 21, "assistant", '{"content":null,"tool_calls":[{}]}')]
    got = sorted(chat.link(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), {}).collect(), key=lambda r: r.position)
    assert [(r.turn, r.kind, json.loads(r.line).get("content")) for r in got[: len(texts)]] == [(k, "message", t) for k, t in enumerate(texts)]
    assert sorted((r.turn, r.kind, r.call_id) for r in got[len(texts) :] if r.kind == "call" and r.call_id) == [(20, "call", "a"), (20, "call", "b")]
    assert [json.loads(r.line)["content"] for r in got if r.turn == 20 and r.kind == "message"] == ["so"]
    assert [r.kind for r in got if r.turn == 21] == ["call"] and [r.position for r in got] == list(range(1, len(texts) + 5))


# --- queries ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(queries.ORACLES[name]).df())


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs, columns = common.table(spark, sf, "documents"), common.table(spark, sf, "documents").columns
    stage = dict(pipeline.STAGES)
    good = common.settle(stage["quality"](spark, docs, sf), "t")
    labels = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} >= {i for i, q in labels.items() if q == 1}
    one = common.settle(stage["near_duplicates"](spark, good, sf), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {least for _, _, least in classes(rows)}
    clean = common.settle(stage["decontamination"](spark, one, sf), "t")
    assert clean.columns == columns and 0 < clean.count() <= one.count()
    mixed = common.settle(stage["mixing"](spark, clean, sf), "t")
    assert mixed.columns == columns and 0 < mixed.count() < clean.count()
    ids = stage["token_ids"](spark, mixed, sf)
    assert ids.count() == mixed.count() == pipeline.run(spark, sf).count()


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"])
def test_stages_on_hard_and_empty_tables(spark, sf, hard, empty, name):
    import corpus_pipeline as pipeline

    stage = dict(pipeline.STAGES)[name]
    got, nothing = stage(spark, hard, sf), stage(spark, empty, sf)
    assert nothing.count() == 0 and nothing.columns == got.columns
    rows, held = got.collect(), hard.collect()
    if name == "token_ids":
        assert len(rows) == len(held) and sum(r.n_tokens == 1 for r in rows) == sum(not r.text for r in held)
        return
    assert got.schema == hard.schema
    same_row = lambda r: tuple(r)[:2] + tuple(r)[2:4] + tuple(r)[5:]  # noqa: E731  n_chars is counted anew where a text is cut
    if name == "mixing":
        assert all(any(r.text == h.text or (h.text or "").startswith(r.text) for h in held) for r in rows) and all((r.text or "").split() for r in rows)
    else:
        assert not Counter(map(same_row, rows)) - Counter(map(same_row, held))
        assert sum(not (r.text or "").split() for r in rows) in (0, sum(not (r.text or "").split() for r in held))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages after quality on a small table, against plain Python for each decision."""
    import corpus_pipeline as pipeline

    rng = random.Random(31)
    item = sentence(rng, 20)
    rows, base = [], sentence(rng, 80).split()
    for k in range(60):
        text = sentence(rng, rng.randint(10, 60))
        if k % 10 == 3:
            text = " ".join(w if i != k else "x" for i, w in enumerate(base))
        if k % 10 == 7:
            text = text + " " + item
        rows.append((k, text, ("en", "de")[k % 2], f"src{k % 4}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(pipeline.STAGES)
    one = common.settle(stage["near_duplicates"](spark, docs, str(tmp_path)), "t")
    assert {r.doc_id for r in one.collect()} == {least for _, _, least in classes([r[:2] for r in rows])}
    clean = common.settle(stage["decontamination"](spark, one, str(tmp_path)), "t")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect() if item not in r.text}
    mixed = common.settle(stage["mixing"](spark, clean, str(tmp_path)), "t")
    total = sum(len(r.text.split()) for r in clean.collect())
    kept = {r.doc_id: r for r in mixed.collect()}
    assert sum(len(r.text.split()) for r in kept.values()) == total * 4 // 5
    whole = {r.doc_id: r for r in clean.collect()}
    assert all(whole[k].text.startswith(r.text) and r.n_chars == len(r.text) for k, r in kept.items())
    cut = Counter((r.source, r.lang) for k, r in kept.items() if r.text != whole[k].text)
    assert all(n == 1 for n in cut.values())  # a prefix of each source: one document at most is cut
    import public_tokenizers

    encoder = dac.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    start = 0
    for r in sorted(stage["token_ids"](spark, mixed, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = [*encoder.encode(kept[r.doc_id].text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_very_long_texts(spark):
    """Some MB in one row, through the operators that read texts."""
    rng = random.Random(41)
    part = [sentence(rng, 30) for _ in range(200)]
    long = "\n".join(rng.choice(part) + sentence(rng, 12) for _ in range(8000))  # 2 MB
    docs = spark.createDataFrame([(1, long, "en", "s1"), (2, long + " end", "en", "s1"), (3, part[0], "en", "s2"), (4, "x" * 1_000_000, "en", "s2")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id for r in decontaminate.find(docs, spark.createDataFrame([(9, part[0])], "item_id long, text string")).collect()} == {1, 2, 3}
    got = {r.doc_id: r for r in suffixes.dedup(docs).collect()}
    assert got[1].n_removed == got[1].n_bytes and got[4].n_removed == 1_000_000 and got[3].n_bytes == len(part[0])
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, {"en": b" the and of", "de": b" der und die"}).collect()}.keys() == {1, 2, 3, 4}
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 0)], "doc_id long, quality int")
    assert quality.score(docs, *quality.fit(docs, labels)).count() == 4
    assert sum(r.take_tokens for r in mixing.mix(docs, epochs=1, share=(1, 2)).collect()) == sum(len(t.split()) for t in (long, long + " end", part[0], "x")) // 2
    assert {r.doc_id: r.n_tokens for r in dac.write_and_read(docs).collect()}[1] > 300_000


def test_sieve(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    sifted = common.sift(spark.range(6000).withColumnRenamed("id", "key"), "key", common.sieve(keys, "key"), "f").where("f")
    got = {r.key for r in sifted.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1010
