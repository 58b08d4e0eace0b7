"""Removal of repeated byte strings with a distributed, sampled suffix array.

A string of LENGTH bytes that starts at two places is found through one suffix it holds:
the start of its GRAM-byte gram of least hash, the same in every occurrence. Only these
sampled suffixes, about one in seventy, are sorted, which is exact: the string's windows
form a run around their suffix, and equal strings have equal suffixes at equal distance.

1. Every text gives its sampled suffixes with the run of windows around each. A shuffle by
   the suffix's gram drops suffixes seen once. Equal texts are one string that is there twice.
2. The others are fetched as bytes. Sampled splitters range-partition them by their leading
   GRAM bytes, as many ranges as the rows ask for. Splitters fall between unlike leads, so two
   suffixes on either side of a boundary share less than a window can need. A range is worked on
   in chunks of whole leads: suffixes are sorted by multikey quicksort (a word of eight bytes at
   a time, ties only), and so is what stands before them, read backwards. Common prefixes of
   neighbours cut each order into classes for every depth; a window of LENGTH bytes that begins
   d before its suffix repeats if another row has its class at depth d backwards and at
   LENGTH - d forwards. Bytes decide here. Hashes decide before: equal texts (128 bits), and
   runs that are equal as a whole within one piece of 2 MB, of which one stands for all.
3. Suffixes with more than HOT unlike surroundings are dealt by window instead: counts of
   their hashes (128 bits) are aggregated before the shuffle, so no task holds them.

Cases: null and short texts lose nothing; equal texts of LENGTH bytes or more are removed
whole, also when doc_ids repeat or are null; an empty table gives no rows; other columns
are ignored. Matches never cross texts. Which copy comes first never matters: all are removed, so
there are no ties. Very long texts are cut in tasks that hold one of them at a time.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import settle
from .textkit import buffers, mix, pieces, windows

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM + 1  # grams of a window
HOT = 50_000
CHUNK = 20_000  # rows that are sorted together, if no lead has more
RANGE = 200_000  # rows of a range


def sampled(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, suffix start, first window, last window, gram hash, hash of the whole run)."""
    n = len(raw)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram, at = windows(raw, GRAM), np.arange(n - GRAM + 1)
    bits = int(n).bit_length()
    least = (gram >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    size = np.diff(off)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    count = np.maximum(size - LENGTH + 1, 0)
    window = off[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    if not len(window):
        return sampled(raw[:0], off[:1])
    suffix = (least[window] & np.uint64((1 << bits) - 1)).astype(np.int64)
    cut = np.flatnonzero((suffix[1:] != suffix[:-1]) | (doc[1:] != doc[:-1])) + 1
    a = np.concatenate([[0], cut])
    b = np.concatenate([cut, [len(window)]]) - 1
    p, first, last, of = suffix[a], window[a], window[b], doc[a]
    # The first and last window overlap, so together they are the run.
    whole = windows(raw, LENGTH)
    run = mix(mix(whole[first] + (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + whole[last] + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return of, p - off[of], first - off[of], last - off[of], gram[p], run


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their words, and the group (equal in all words) of each row in that order.
    Each pass splits the groups still tied by their next word."""
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(words.shape[1]):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        value = words[order[tied], k]
        inner = np.lexsort((value, group[tied]))
        order[tied] = order[tied][inner]
        value = value[inner]
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        split = np.flatnonzero((value[1:] != value[:-1]) & (group[tied][1:] == group[tied][:-1])) + 1
        new[tied[split]] = True
        group = np.cumsum(new) - 1
    return order, group


def shared(chars: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted table shares with the row before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    unlike = chars[order[1:]] != chars[order[:-1]]
    out[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), chars.shape[1])
    return out


def laid(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """A table of bytes: of each row ``size`` from ``start`` on, forwards or backwards, then zeros."""
    out = np.zeros((len(start), width), np.uint8)
    for k in range(width):
        mine = np.flatnonzero(size > k)
        out[mine, k] = raw[start[mine] + step * k]
    return out


def repeated(raw: np.ndarray, begin: np.ndarray, da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, window of the row) for every window that another row has at the same distance. Row k
    holds the windows that begin da to db bytes before its suffix, the first of them at begin."""
    n = len(begin)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tables = [laid(raw, begin + da, LENGTH - db, LENGTH, 1), laid(raw, begin + da - 1, da, REACH - 1, -1)]
    orders, commons = [], []
    for chars in tables:
        order, _ = multikey_order(chars.view(">u8").astype(np.uint64))
        orders.append(order)
        commons.append(shared(chars, order))
    hit = np.zeros((n, REACH), bool)  # by the window's place in the row
    place, first = np.arange(n), np.empty(n, np.int64)
    for d in range(int(db.min()), int(da.max()) + 1):
        mine = np.flatnonzero((db <= d) & (d <= da))
        if len(mine) < 2:
            continue
        key = np.zeros(len(mine), np.int64)
        for order, common_bytes, depth in zip(orders, commons, (LENGTH - d, d)):
            first[order] = np.maximum.accumulate(np.where(common_bytes < depth, place, 0))
            key = key * n + first[mine]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        r = mine[by[np.append(same, False) | np.insert(same, 0, False)]]
        hit[r, da[r] - d] = True
    return np.nonzero(hit)


def spans(row: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows: (row, first, last)."""
    if not len(row):
        return row, row, row
    cut = np.flatnonzero((row[1:] != row[:-1]) | (within[1:] != within[:-1] + 1)) + 1
    a = np.concatenate([[0], cut])
    b = np.concatenate([cut, [len(row)]]) - 1
    return row[a], within[a], within[b]


KEY = "h1 long, h2 long"
KNOWN = 1 << 62  # marks a place whose run is known to repeat


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


def find(docs: DataFrame) -> DataFrame:
    """(h1, h2, first, last): runs of window starts, by hash of the text, whose strings repeat."""

    def sample(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                # Two copies show that a text repeats; more of them in a piece add nothing.
                h = np.stack([np.asarray(piece.column(1)), np.asarray(piece.column(2))])
                _, kind = np.unique(h, axis=1, return_inverse=True)
                order = np.argsort(kind.ravel(), kind="stable")
                sorted_kind = kind.ravel()[order]
                third = np.zeros(len(order), bool)
                third[2:] = sorted_kind[2:] == sorted_kind[:-2]
                piece = piece.take(pa.array(np.sort(order[~third])))
                of, p, a, b, gram, run = sampled(*buffers(piece.column(0)))
                h = [np.asarray(piece.column(k))[of] for k in (1, 2)]
                place = p << 16 | (p - a) << 8 | (p - b)
                # Runs that repeat within the piece are known to: they travel marked, each under a
                # key of its own, and one of them stands for all. So a frequent gram stays few rows.
                both = mix(gram) ^ run
                order = np.argsort(both, kind="stable")
                left = np.zeros(len(both), bool)
                left[1:] = both[order][1:] == both[order][:-1]
                known = order[left | np.append(left[1:], False)]
                rest = np.sort(order[~left])
                alone = mix(h[0][known].view(np.uint64) ^ mix(h[1][known].view(np.uint64) + place[known].astype(np.uint64)))
                gram = np.concatenate([gram[rest], alone])
                h = [np.concatenate([x[rest], x[known]]) for x in h]
                place = np.concatenate([place[rest], place[known] | KNOWN])
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(h[0]), pa.array(h[1]), pa.array(place)], ["gram", "h1", "h2", "place"])

    def pair(batches):
        """Rows sorted by gram, text and place. kind 0: the whole run repeats, as its text does or as it is
        known to; 1: another row has its gram."""
        held, twice0, others0 = None, False, False  # the last row, and what is known of it by then
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if held is None:
                    return
                rows = held
            else:
                rows = [np.asarray(batch.column(k)) for k in range(4)]
                if not len(rows[0]):
                    continue
                if held is not None:
                    rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
            at = np.arange(len(rows[0]))
            same_gram = rows[0][1:] == rows[0][:-1]
            same_row = same_gram & np.logical_and.reduce([r[1:] == r[:-1] for r in rows[1:]])
            gram_from, row_from = (np.maximum.accumulate(np.where(np.insert(same, 0, False), 0, at)) for same in (same_gram, same_row))
            twice = (at > row_from) | ((row_from == 0) & twice0)
            others = (row_from > gram_from) | ((row_from == 0) & others0)
            last = np.append(~same_row, batch is None)  # of its equals
            masks = [last & (twice | (rows[3] >= KNOWN)), last & (others | np.append(same_gram, False)) & (rows[3] < KNOWN)]
            held, twice0, others0 = [r[-1:] for r in rows], bool(twice[-1]), bool(others[-1])
            pick = np.concatenate([np.flatnonzero(m) for m in masks])
            kind = np.repeat(np.arange(2, dtype=np.int32), [m.sum() for m in masks])
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(r[pick]) for r in rows[:3]), pa.array(rows[3][pick] & (KNOWN - 1))], ["kind", "gram", "h1", "h2", "place"])

    texts = _identified(docs)
    grams = texts.select("text", "h1", "h2").mapInArrow(common.tidy(sample), f"gram long, {KEY}, place long")
    paired = settle(grams.repartition("gram").sortWithinPartitions("gram", "h1", "h2", "place").mapInArrow(common.tidy(pair), f"kind int, gram long, {KEY}, place long"), "paired")
    p, before, after = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = paired.where("kind = 0").select("h1", "h2", (p - before).alias("first"), (p - after).alias("last"))

    lists = paired.where("kind = 1").groupBy("h1", "h2").agg(F.collect_list(F.struct("place", "gram")).alias("runs"))
    holders = texts.join(lists, ["h1", "h2"]).select("h1", "h2", "text", "runs")

    def cut(batches):
        seen = set()  # equal texts meet in a task: one of them is enough
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if own in seen:
                    continue
                seen.add(own)
                text = (batch.column(2)[k].as_py() or "").encode()
                runs = batch.column(3)[k].values
                place, gram = np.asarray(runs.field(0)), np.asarray(runs.field(1))
                p, da, db = place >> 16, place >> 8 & 255, place & 255
                part = [text[i:j] for i, j in zip((p - da).tolist(), (p - db + LENGTH).tolist())]
                n = len(place)
                yield pa.RecordBatch.from_arrays([pa.array([text[i : i + GRAM] for i in p.tolist()], pa.binary()), pa.array(gram), pa.array(np.full(n, own[0])), pa.array(np.full(n, own[1])), pa.array(place), pa.array(part, pa.binary())], ["lead", "gram", "h1", "h2", "place", "part"])

    suffixes = settle(holders.mapInArrow(common.tidy(cut), f"lead binary, gram long, {KEY}, place long, part binary"), "suffixes")
    hot = suffixes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram")
    some_hot = hot.first() is not None
    rest = suffixes.join(hot, "gram", "left_anti") if some_hot else suffixes

    def judge(table):
        h1, h2, place = (np.asarray(table.column(k)) for k in (1, 2, 3))
        # Equal texts that were fetched in two tasks are one occurrence.
        _, one = np.unique(np.stack([h1, h2, place]), axis=1, return_index=True)
        h1, h2, place = h1[one], h2[one], place[one]
        raw, off = buffers(table.column(4).take(pa.array(one)))
        p, da, db = place >> 16, place >> 8 & 255, place & 255
        r, first, last = spans(*repeated(raw, off[:-1], da, db))
        return pa.RecordBatch.from_arrays([pa.array(h1[r]), pa.array(h2[r]), pa.array(p[r] - da[r] + first), pa.array(p[r] - da[r] + last)], ["h1", "h2", "first", "last"])

    def bucket(batches):
        """Rows sorted by lead, in chunks of whole leads."""
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n = [*held, batch], n + batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                lead = table.column(0)
                unlike = np.flatnonzero(np.asarray(pc.not_equal(lead[1:], lead[:-1]).cast(pa.uint8())))
                if len(unlike):
                    to = int(unlike[-1]) + 1
                    yield judge(table.slice(0, to))
                    table = table.slice(to)
                held, n = [table], table.num_rows
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // RANGE)
    dealt = rest.select("lead", "h1", "h2", "place", "part").repartitionByRange(ranges, "lead").sortWithinPartitions("lead")
    parts = dealt.mapInArrow(common.tidy(bucket), f"{KEY}, first long, last long")
    out = whole.union(parts)
    if some_hot:

        def windows_of(batches):
            for batch in batches:
                raw, off = buffers(batch.column(3))
                h1, h2, place = (np.asarray(batch.column(k)) for k in range(3))
                p, da, db = place >> 16, place >> 8 & 255, place & 255
                n = da - db + 1
                row = np.repeat(np.arange(len(n)), n)
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = off[:-1][row] + within
                half = windows(raw, LENGTH // 2)
                w1, w2 = windows(raw, LENGTH)[start], mix(half[start] * np.uint64(0x5851F42D4C957F2D) + half[start + LENGTH // 2])
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(h1[row]), pa.array(h2[row]), pa.array((p - da)[row] + within)], ["w1", "w2", "h1", "h2", "first"])

        each = settle(suffixes.join(hot, "gram", "left_semi").select("h1", "h2", "place", "part").mapInArrow(common.tidy(windows_of), f"w1 long, w2 long, {KEY}, first long").distinct(), "windows")
        twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        out = out.union(each.join(twice, ["w1", "w2"]).select("h1", "h2", "first", F.col("first").alias("last")))
    return out


def covered(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) of bytes under windows that start in the given runs."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], last[order] + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return begin[at], reach[np.append(at[1:], len(begin)) - 1]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (begin and end bytes), and the
    remaining bytes if asked for."""
    runs = find(docs).distinct().groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def remove(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for k in range(batch.num_rows):
                text, found = (batch.column(1)[k].as_py() or "").encode(), batch.column(2)[k].values
                begin = end = np.zeros(0, np.int64)
                if found is not None and len(found):
                    begin, end = covered(np.asarray(found.field(0)), np.asarray(found.field(1)))
                edge = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edge[::2], edge[1::2]))
                for c, v in zip(out, (batch.column(0)[k].as_py(), len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), np.stack([begin, end], 1).ravel().tolist(), kept if with_text else None)):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()))})

    joined = _identified(docs).join(runs, ["h1", "h2"], "left").select("doc_id", "text", "runs")
    done = joined.mapInArrow(common.tidy(remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    return done if with_text else done.drop("kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents")).drop("spans")
