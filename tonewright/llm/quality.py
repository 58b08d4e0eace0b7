"""Quality of documents from a linear-chain CRF that labels every line good or bad.

A line's features describe its characters and words, and those of the lines before and
after it. Labels are of documents; those of their lines are latent. The field is first fitted with
every line under its document's label. Then lines that it is sure are of the other kind (SURE)
take that label, as long as most of the document's bytes keep the document's, and it is fitted
again: so it learns where good and bad lines change within a document. A document's score is the
mean of its lines' forward-backward marginals, weighted by their bytes.

Learned from are whole texts of at most SAMPLE documents of each label, with at most SAMPLE_LINES lines
together; long ones in chains of CHAIN lines. Of texts with one id one is learned from.

Cases: a null, empty or blank text has no lines and gets the share of good documents
among those learned from; so does every document where there is nothing to learn from. A very
long text is scored whole, in memory that grows with its lines (some 190 bytes each) and its bytes. Scores that are
equal stay so; nothing is ranked. Ids whose labels contradict each other
are not learned from. A null doc_id is scored and counts as not held out; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .crf import Chains, Crf
from .textkit import Words, buffers, mix, pieces, unique_per_doc

#: Documents and lines of each label to learn from: bounds of the training sample only.
SAMPLE, SAMPLE_LINES, CHAIN = 1500, 250_000, 100
SURE = 0.95
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"#$%&*@^~=+<>\\{}[]", b"|", b".,;:?'\"()-"), 1):
    _KIND[list(_chars)] = _k
N_OWN = 15


class Lines:
    """Lines with something on them: ``start``/``end`` bytes and ``first`` line of each document."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        words = Words(raw, off)
        brk = np.flatnonzero(raw == 10)
        # A line begins at a document's start and after each line feed; those without words go.
        bounds = np.unique(np.concatenate([off, brk + 1]))
        w_line = np.searchsorted(bounds, words.start, "right") - 1
        kept = np.unique(w_line)
        self.start = bounds[kept]
        self.end = np.append(bounds, len(raw))[kept + 1] if len(kept) else bounds[:0]
        self.words, self.raw, self.off = words, raw, off
        self.of_word = np.searchsorted(kept, w_line)
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def own(self) -> np.ndarray:
        """Features of each line by itself."""
        n, raw, w = len(self.start), self.raw, self.words
        x = np.zeros((n, N_OWN), np.float32)
        if not n:
            return x
        kind = _KIND[raw]
        lead = np.zeros(len(raw), bool)
        lead[1:] = raw[:-1] == 0xC3  # Latin letters with marks
        kind[lead & (raw >= 0x80) & (raw <= 0x9E)] = 2
        kind[lead & (raw >= 0xA0)] = 1
        edge = np.stack([self.start, self.end], 1).ravel()
        edge = edge[:-1] if edge[-1] == len(raw) else edge
        size = (self.end - self.start).astype(np.float32)
        count = [None] + [np.add.reduceat(kind == k, edge, dtype=np.int32)[::2].astype(np.float32) for k in range(1, 8)]
        h, at = w.hashes(), self.of_word
        n_words = np.bincount(at, minlength=n).astype(np.float32)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        distinct = np.bincount(unique_per_doc(at, h)[0], minlength=n)
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = mix(h[1:] * np.uint64(3) + h[:-1])
        lines_of_pairs = np.flatnonzero(np.concatenate([[False], at[1:] == at[:-1]]))
        pairs = np.bincount(unique_per_doc(at[lines_of_pairs], pair[lines_of_pairs])[0], minlength=n)
        # A line's words by place: lines of equal words are equal.
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        text = np.add.reduceat(mix(h + (np.arange(len(h)) - begins[at]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begins)
        order = np.lexsort((text, self.doc))
        again = np.zeros(n, bool)
        again[order[1:]] = (text[order[1:]] == text[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        length = w.end - w.start
        x[:, 0] = count[2] / (count[1] + count[2] + 1)
        x[:, 1] = count[3] / size
        x[:, 2] = count[4] / n_words
        x[:, 3] = count[5] / n_words
        x[:, 4] = count[6] / n_words
        x[:, 5] = count[7] / n_words
        x[:, 6] = np.bincount(at[same], minlength=n) / n_words
        x[:, 7] = distinct / n_words
        x[:, 8] = pairs / np.maximum(n_words - 1, 1)
        x[:, 9] = np.log(n_words)
        x[:, 10] = np.bincount(at, weights=length) / n_words
        x[:, 11] = np.log1p(np.bincount(at, weights=length >= 20, minlength=n))
        x[:, 12] = again
        x[:, 13] = x[:, 8] * np.minimum(x[:, 9], 4)
        x[:, 14] = ((count[4] + count[5] + count[6]) > 0.3 * n_words)
        return x

    def features(self) -> np.ndarray:
        """Own features, those of the line before and after, and whether there is one."""
        own = self.own()
        n = len(own)
        x = np.zeros((n, 3 * N_OWN + 2), np.float32)
        x[:, :N_OWN] = own
        if n > 1:
            joined = self.doc[1:] == self.doc[:-1]
            x[1:, N_OWN : 2 * N_OWN][joined] = own[:-1][joined]
            x[:-1, 2 * N_OWN : 3 * N_OWN][joined] = own[1:][joined]
            x[1:, -2], x[:-1, -1] = joined, joined
        return x


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Crf, float]:
    """A CRF from at most SAMPLE documents of each label (of ids that aren't held out, those of
    least hash), and the share of good documents among all labels that may be learned from."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~common.held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    model = Crf(3 * N_OWN + 2)
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    sample = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def lines(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Lines(*buffers(piece.column(1)))
                x, ids, y = found.features(), piece.column(0).to_pylist(), piece.column(2).to_pylist()
                for k in range(piece.num_rows):
                    a, b = found.first[k], found.first[k + 1]
                    if b > a:
                        size = (found.end - found.start)[a:b].astype("<i4")
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[k]], pa.int64()), "y": pa.array([y[k]], pa.int32()), "n": pa.array([b - a], pa.int32()), "x": pa.array([x[a:b].tobytes()], pa.binary()), "size": pa.array([size.tobytes()], pa.binary())})

    held = common.settle(texts.mapInArrow(common.tidy(lines), "doc_id long, y int, n int, x binary, size binary"), "lines")
    rows = sorted(common.within(held, "doc_id", "n", SAMPLE_LINES, "y").collect(), key=lambda r: (r["doc_id"], r["x"]))
    if len({r["y"] for r in rows}) < 2:
        return model, prior
    size = [np.frombuffer(r["size"], "<i4") for r in rows]
    n = [len(s) for s in size]
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, 3 * N_OWN + 2)
    size, doc, y = np.concatenate(size), np.repeat(np.arange(len(rows)), n), np.repeat([r["y"] for r in rows], n)
    ends = np.cumsum(n)
    # Chains begin with a document and after each CHAIN lines of it.
    first = np.append(np.flatnonzero((np.arange(len(doc)) - (ends - n)[doc]) % CHAIN == 0), len(doc))
    model.fit(x, y, first)
    return model.fit(x, latent(model.marginals(x, Chains(first)), y, size, doc), first, rounds=100, warm=True), prior


def latent(p: np.ndarray, y: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Labels of lines, from the field's marginals p and the document's label y: lines that are surely
    of the other kind take that, surest first, while they have less than half of the document's bytes."""
    wrong = np.where(y == 1, 1 - p, p)
    order = np.lexsort((-wrong, doc))
    total = np.bincount(doc, weights=size)
    before = np.cumsum(size[order]) - np.repeat(np.cumsum(total) - total, np.bincount(doc))
    flips = order[(wrong[order] > SURE) & (2 * before < total[doc[order]])]
    out = y.copy()
    out[flips] = 1 - y[flips]
    return out


def score(docs: DataFrame, model: Crf, prior: float) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines for every document."""

    def scored(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Lines(*buffers(piece.column(2)))
                p = model.marginals(found.features(), Chains(found.first)) if model.w.any() else np.full(len(found.start), prior)
                size = (found.end - found.start).astype(float)
                n = piece.num_rows
                weight = np.bincount(found.doc, weights=size, minlength=n)
                total = np.bincount(found.doc, weights=size * p, minlength=n)
                value = np.clip(np.where(weight > 0, total / np.maximum(weight, 1), prior), 0, 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array(np.diff(found.first).astype(np.int64)), pa.array(np.bincount(found.doc, weights=p < 0.5, minlength=n).astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "n_lines", "n_bad_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(scored), "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_bad_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return score(docs, *fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted good, with all their columns."""
    model, prior = fit(docs, labels)
    names = docs.columns
    schema = docs.schema

    def kept(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = Lines(*buffers(piece.column(piece.schema.get_field_index("text"))))
                p = model.marginals(found.features(), Chains(found.first)) if model.w.any() else np.full(len(found.start), prior)
                size = (found.end - found.start).astype(float)
                weight = np.bincount(found.doc, weights=size, minlength=piece.num_rows)
                value = np.where(weight > 0, np.bincount(found.doc, weights=size * p, minlength=piece.num_rows) / np.maximum(weight, 1), prior)
                yield piece.filter(pa.array(value >= THRESHOLD))

    return docs.select(*names).mapInArrow(common.tidy(kept), schema)
