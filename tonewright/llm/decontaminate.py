"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are runs without white space, ASCII letters lower-cased, signs at their ends cut off.
Every GRAM-word gram of a test item is counted over all documents, and so are those with one of the inner
words left open, so that seeds survive where every third or fourth word is replaced. An item's rare seeds are its
grams that are rare in the corpus (RARE) or, so that an item leaked many times keeps its own,
not much more frequent than the item's rarer ones (COMMON times its lower quartile). Where a document holds a rare seed, the
words around it are aligned locally with the item's (MATCH, MISMATCH, GAP), and the best score
over that of a perfect copy is the similarity: edits, insertions and losses lower it little by
little, so paraphrased copies are found as well as exact ones.

Grams that aren't rare are seeds too. The words around them are aligned unless too few are the
item's for any alignment to reach the threshold; so rarity steers the cost and never the result.

All items' grams are counted in one scan of the documents. The items are held by every worker in
chunks of at most CHUNK_BYTES, one scan each; nothing is shuffled but counts.

Cases: null or blank texts and items match nothing; an item shorter than a gram is its own seed and
is found wherever a document holds it; equal items are each reported, as are repeated documents; of
places that align equally well the first is reported; very long texts are scanned whole, one at a
time; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textkit import LOWER, Words, buffers, mix, pieces, runs, slices

GRAM, PAD = 4, 12
RARE, COMMON = 1000, 4  # rare: in at most one document of so many
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
CHUNK_BYTES = 16 << 20
BATCH_CELLS = 4_000_000  # of alignment tables at once
BATCH_HITS = 1_000_000  # places of items that documents' grams point at, at once

_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Words]:
    """Hashes of the words without signs at their ends; words of signs alone keep them."""
    w = Words(raw, off)
    solid = np.flatnonzero(~_SIGN[raw])
    if len(w.start) and len(solid):
        low, high = np.searchsorted(solid, w.start), np.searchsorted(solid, w.end)
        some = high > low
        begin = np.where(some, solid[np.minimum(low, len(solid) - 1)], w.start)
        end = np.where(some, solid[np.maximum(high - 1, 0)] + 1, w.end)
    else:
        begin, end = w.start, w.end
    return slices(LOWER[raw], begin, end)[0], w


def grams(words: np.ndarray, first: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in words, hash) of each gram; a text of fewer words gives one."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    of = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][of] + place
    return of, place, runs(words, start, np.minimum(size, n)[of], n)


def spaced(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of the windows of GRAM words with one word within left open; shorter texts have none."""
    size = np.diff(first)
    count = np.maximum(size - GRAM + 1, 0)
    of = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][of] + place
    found = []
    for left in range(1, GRAM - 1):
        total = np.full(len(of), left, np.uint64)
        for k in range(GRAM):
            if k != left:
                total = total * np.uint64(0x9E3779B97F4A7C15) + words[start + k]
        found.append(mix(total))
    return np.tile(of, len(found)), np.tile(place, len(found)), np.concatenate(found)


def grams_of(words: np.ndarray, first: np.ndarray, short: list[int], held: "Known") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in words, place in ``held``) of the grams of documents that are held, of those with an
    open word and of the runs of as many words as short items have; by document."""
    found = [grams(words, first), spaced(words, first)]
    size = np.diff(first)
    for n in short:
        count = np.where(size > n, size - n + 1, 0)  # a document of n words is its own gram already
        of = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        found.append((of, place, runs(words, first[:-1][of] + place, np.full(len(of), n), n)))
    kept = []
    for of, place, gram in found:
        at, number = held.find(gram)
        kept.append((of[at], place[at], number))
    of, place, number = map(np.concatenate, zip(*kept))
    order = np.argsort(of, kind="stable")
    return of[order], place[order], number[order]


class Known:
    """A sorted set of hashes, with a table of their leading bits: most that is asked for isn't there."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.some = hashes, np.zeros(1 << 20, bool)
        self.some[hashes >> np.uint64(44)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``asked`` of what is there, where it is)."""
        at = np.flatnonzero(self.some[asked >> np.uint64(44)])
        number = find_in(self.hashes, asked[at])
        return at[number >= 0], number[number >= 0]


def find_in(known: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, or -1."""
    if not len(known):
        return np.full(len(gram), -1)
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    return np.where(known[at] == gram, at, -1)


class Items:
    """Test items as word hashes, with their grams sorted for look-up."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words, w = word_hashes(*buffers(pa.array(texts, pa.large_string())))
        self.first = w.first
        self.of, self.place, gram = map(np.concatenate, zip(grams(self.words, self.first), spaced(self.words, self.first)))
        size = np.diff(self.first)
        self.short = np.unique(size[(size > 0) & (size < GRAM)]).tolist()
        order = np.argsort(gram, kind="stable")
        self.of, self.place, self.gram = self.of[order].astype(np.int32), self.place[order].astype(np.int32), gram[order]
        self.known, self.start = np.unique(self.gram, return_index=True)
        self.start = np.append(self.start, len(self.gram))

    def seeds(self, df: np.ndarray, n_docs: int) -> "Items":
        """Keep the grams that occur and mark those that are rare, for the corpus or for their item."""
        count = np.repeat(df, np.diff(self.start))
        occurs = np.flatnonzero(count)
        order = occurs[np.lexsort((count[occurs], self.of[occurs]))]
        size = np.bincount(self.of[order], minlength=len(self.ids))
        quarter = np.zeros(len(self.ids), np.int64)
        some = size > 0
        quarter[some] = count[order][(np.cumsum(size) - size)[some] + size[some] // 4]
        rare = (count * RARE <= n_docs) | (count <= COMMON * quarter[self.of])
        self.of, self.place, self.gram, self.rare = self.of[occurs], self.place[occurs], self.gram[occurs], rare[occurs]
        self.known, self.start = np.unique(self.gram, return_index=True)
        self.start = np.append(self.start, len(self.gram))
        self.held = Known(self.known)
        # Entries by gram and item, and how often each item has each of its words.
        order = np.lexsort((self.of, np.repeat(np.arange(len(self.known)), np.diff(self.start))))
        self.of, self.place, self.rare = self.of[order], self.place[order], self.rare[order]
        self.entry = np.repeat(np.arange(len(self.known)), np.diff(self.start)) * len(self.ids) + self.of
        self.vocabulary, word = np.unique(self.words, return_inverse=True)
        self.has, self.times = np.unique(np.repeat(np.arange(len(self.ids)), np.diff(self.first)) * len(self.vocabulary) + word, return_counts=True)
        return self

    def shared(self, item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words each window [low, high) of ``words`` has in common with its item, repeats counted."""
        out, size = np.zeros(len(item), np.int64), high - low
        ends = np.cumsum(size)
        k = 0
        while k < len(item):
            to = max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + BATCH_HITS, "right")))
            n = size[k:to]
            window = np.repeat(np.arange(k, to), n)
            word = words[np.arange(n.sum()) + np.repeat(low[k:to] - np.cumsum(n) + n, n)]
            at = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == word
            window, key = window[known], item[window[known]] * len(self.vocabulary) + at[known]
            at = np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)
            known = self.has[at] == key
            pair, times = np.unique(window[known] * len(self.has) + at[known], return_counts=True)
            np.add.at(out, pair // len(self.has), np.minimum(times, self.times[pair % len(self.has)]))
            k = to
        return out


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair and where in the text it ends, all pairs of a batch at once."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((n, rows), np.uint64), np.ones((n, cols), np.uint64)
    for k, (x, y) in enumerate(zip(items, texts)):
        a[k, : len(x)], b[k, : len(y)] = x | np.uint64(2), y | np.uint64(2)
    ramp = np.arange(cols, dtype=np.int32) * -GAP
    above, best, where = np.zeros((n, cols), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(rows):
        here = np.where(b == a[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        here[:, 1:] += above[:, :-1]
        here = np.maximum(np.maximum(here, above + GAP), 0)
        # Gaps along the text: the best earlier cell of the row less its distance.
        above = np.maximum.accumulate(here + ramp, 1) - ramp
        top = above.argmax(1)
        value = above[np.arange(n), top]
        better = value > best
        best[better], where[better] = value[better], top[better]
    return best, where


def matches(items: Items, raw: np.ndarray, off: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, ...]:
    """(document, item, similarity, last word, seeds) of the pairs with a gram in common; those
    that can't reach the threshold may be left out."""
    words, w = word_hashes(raw, off)
    of, place, number = grams_of(words, w.first, items.short, items.held)
    at = of
    ends = np.cumsum(items.start[number + 1] - items.start[number])
    out, k = [], 0
    while k < len(at):
        # Whole documents; one with too many hits meets the items a part at a time.
        before = ends[k - 1] if k else 0
        to = int(np.searchsorted(ends, before + BATCH_HITS, "right"))
        if to < len(at):
            to = int(np.searchsorted(of, of[to]))
        to = to if to > k else int(np.searchsorted(of, of[k], "right"))
        parts = -(-int(ends[to - 1] - before) // BATCH_HITS)
        bounds = np.linspace(0, len(items.ids), parts + 1).astype(np.int64)
        for first, last in zip(bounds[:-1], bounds[1:]):
            out.append(aligned(items, words, w.first, of[k:to], place[k:to], number[k:to], first, last, threshold))
        k = to
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out))) if out else (none, none, np.zeros(0), none, none)


def aligned(items: Items, words: np.ndarray, texts: np.ndarray, of: np.ndarray, place: np.ndarray, number: np.ndarray, low_item: int, high_item: int, threshold: float) -> tuple[np.ndarray, ...]:
    """What ``matches`` gives, of the items [low_item, high_item) and the grams of some documents."""
    start = np.searchsorted(items.entry, number * len(items.ids) + low_item)
    each = np.searchsorted(items.entry, number * len(items.ids) + high_item) - start
    at = np.repeat(np.arange(len(of)), each)
    entry = np.repeat(start - np.cumsum(each) + each, each) + np.arange(each.sum())
    doc, item, rare = of[at], items.of[entry], items.rare[entry]
    size, length = np.diff(items.first)[item], np.diff(texts)
    low = np.maximum(place[at] - items.place[entry] - PAD, 0)
    high = np.minimum(place[at] - items.place[entry] + size + PAD, length[doc])
    order = np.lexsort((low, item, doc))
    doc, item, low, high, rare = doc[order], item[order], low[order], high[order], rare[order]
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, none, np.zeros(0), none, none
    # Windows of one pair that overlap are one.
    pair = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))])
    span = int(length.max()) + 1
    reach = np.maximum.accumulate(high + pair * span)
    new = np.ones(len(doc), bool)
    new[1:] = low[1:] + pair[1:] * span > reach[:-1]
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    doc, item, low, high, n_seeds = doc[start], item[start], low[start], reach[last] - pair[start] * span, np.bincount(pair)[pair[start]]
    # No alignment of a window scores more than a match for each word in common.
    try_ = np.logical_or.reduceat(rare, start)
    other = np.flatnonzero(~try_)
    most = MATCH * items.shared(item[other], words, texts[doc[other]] + low[other], texts[doc[other]] + high[other])
    try_[other] = most / (MATCH * np.diff(items.first)[item[other]]) >= threshold
    doc, item, low, high, n_seeds = doc[try_], item[try_], low[try_], high[try_], n_seeds[try_]
    if not len(doc):
        return none, none, np.zeros(0), none, none
    best, end = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    order = np.lexsort((high - low, np.diff(items.first)[item]))
    k = 0
    while k < len(order):
        to = k
        while to < len(order) and (to == k or (to - k + 1) * int(high[order[to]] - low[order[to]]) <= BATCH_CELLS // 16):
            to += 1
        part = order[k:to]
        b, e = align([items.words[items.first[i] : items.first[i + 1]] for i in item[part]], [words[texts[d] + x : texts[d] + y] for d, x, y in zip(doc[part], low[part], high[part])])
        best[part], end[part] = b, low[part] + e
        k = to
    similarity = best / (MATCH * np.diff(items.first)[item])
    # The best window of each pair.
    order = np.lexsort((-similarity, item, doc))
    doc, item, similarity, end, n_seeds = doc[order], item[order], similarity[order], end[order], n_seeds[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[head], item[head], similarity[head], end[head], n_seeds[head]


def chunks(benchmark: DataFrame) -> list[DataFrame]:
    """The items in parts of about CHUNK_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(total // CHUNK_BYTES) + 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def held_items(items: DataFrame) -> Items:
    rows = sorted(items.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def counted(docs: DataFrame, parts: list[DataFrame]) -> tuple[np.ndarray, np.ndarray, int]:
    """(grams of all items, number of documents with each, number of documents), in one scan."""
    known, short = np.zeros(0, np.uint64), set()
    for items in parts:
        held = held_items(items)
        known, short = np.union1d(known, held.known), short | set(held.short)
    shared = docs.sparkSession.sparkContext.broadcast((known, sorted(short)))

    def count(batches):
        (known, short), n = shared.value, 0
        df, held = np.zeros(len(known), np.int64), Known(known)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, w = word_hashes(*buffers(piece.column(0)))
                of, _, number = grams_of(words, w.first, short, held)
                pair = np.unique(of * len(df) + number)
                df += np.bincount(pair % max(len(df), 1), minlength=len(df))
                n += piece.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n))], ["gram", "n"])

    # One row for each gram of the items at most.
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = np.asarray(found.column(0).combine_chunks()), np.asarray(found.column(1).combine_chunks())
    df = np.zeros(len(known), np.int64)
    df[gram[gram >= 0]] = n[gram >= 0]
    return known, df, int(n[gram < 0].sum())


def seeded(docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcast items with their seeds, one chunk after the other."""
    parts = chunks(benchmark)
    known, df, n_docs = counted(docs, parts)
    for items in parts:
        held = held_items(items)
        yield docs.sparkSession.sparkContext.broadcast(held.seeds(df[find_in(known, held.known)], n_docs))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, last_word, n_seeds of every pair at or above the threshold."""
    out = None
    for shared in seeded(docs, benchmark):

        def scan(batches, shared=shared):
            held = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    doc, item, similarity, end, n = matches(held, *buffers(piece.column(1)), threshold)
                    keep = similarity >= threshold
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc[keep])), pa.array([held.ids[i] for i in item[keep]], pa.int64()), pa.array(similarity[keep]), pa.array(end[keep]), pa.array(n[keep].astype(np.int64))], ["doc_id", "item_id", "similarity", "last_word", "n_seeds"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(scan), "doc_id long, item_id long, similarity double, last_word long, n_seeds long")
        out = found if out is None else out.union(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, with all their columns. Rows without id or text and repeated rows
    are judged each by their text; an empty table of documents or items leaves all as it is."""
    clean = docs
    for k, shared in enumerate(seeded(docs, benchmark)):

        def keep(batches, shared=shared):
            for batch in batches:
                for piece in pieces(batch, "text"):
                    doc, _, similarity, _, _ = matches(shared.value, *buffers(piece.column(piece.schema.get_field_index("text"))))
                    bad = np.zeros(piece.num_rows, bool)
                    bad[doc[similarity >= THRESHOLD]] = True
                    yield piece.filter(pa.array(~bad))

        # Between chunks the rest is written, so that a task holds one of them.
        clean = (common.settle(clean, "clean") if k else clean).mapInArrow(common.tidy(keep), docs.schema)
    return clean
