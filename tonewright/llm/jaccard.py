"""Exact Jaccard join of documents on word shingles, and the classes that its links make.

Size-aware, heavy and light: a small ("light") set posts every pair of the least frequent
elements of its prefix, a large ("heavy") one posts its prefix elements and is compared by
scanning inverted lists. The boundary is the size with the least expected cost.

1. A fixed-size sketch counts all shingles of the corpus; prefixes take rare shingles first.
   The order only steers cost: any fixed order is exact.
2. Every distinct set posts its keys. Large sets post a few more than one that links must share, so
   that such pairs share several: on short lists pairs are counted, and one that shares too few is
   none. Long texts meet by chance on some key with a number of others that grows with the
   table; without the count they would make one cluster. On long lists all sets between two
   that share the key are chained by size, so one edge for each neighbour suffices: copies never make all pairs.
3. Chained sets form candidate clusters. Each cluster's texts meet once, and inverted lists give
   the overlaps of all its sets, hence exact links: short ("light") lists give their pairs, long
   ("heavy") ones are columns of a matrix whose product with itself counts for all sets at once.
   Large clusters are dealt in pairs of blocks, so no task holds more than two.
4. Links make classes; equal sets were one set all along.

Cases: null, empty and blank texts have no shingles and link with nothing; fewer words than
a shingle has make one; equal texts, repeated rows and ties are one set and share a class; a
very long text is cut into shingles whole, in one task and memory of some thirty times its size;
null doc_ids take part but are never a class id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import settle
from .graph import components
from .textkit import Words, buffers, mix, pieces, shingles, unique_per_doc

SIZE, PART, WHOLE = 5, 80, 100  # shingle words; 100 * intersection >= 80 * union
SLOT_BITS, SLAB_BITS = 22, 16  # the sketch: 2**22 counters, moved in slabs of 2**16
SHARE, SLAB = 11, 512  # lists of more than one in SHARE of the sets of a comparison are heavy; columns of a product
PAIRS = 1 << 18  # pairs of light lists that are counted at once
SCAN_COST = 1.0  # cost of scanning one posting, in postings written
BROADCAST_ROWS = 500_000  # members (about 60 bytes each) that are broadcast to fetch their texts; more are joined by a shuffle
LISTS = 1 << 26  # postings whose lists are sorted at a time
COUNTED, ALWAYS, SPENT = 128, 4, 1  # sets of the longest list whose pairs are counted, of one whose always are; pairs for each posting that longer ones may make
BLOCK, BLOCK_SHINGLES = 1024, 1_500_000  # sets, and their shingles, of a cluster that stand on one side of a comparison


def sets_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(document index, distinct shingle hash) of an Arrow string column."""
    return unique_per_doc(*shingles(Words(*buffers(column)), SIZE))


def sets_in(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same of a whole table, a piece at a time: hashing takes many times the text's memory."""
    docs, values, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    for batch in table.to_batches():
        for piece in pieces(batch, text, 1 << 20):
            doc, value = sets_of(piece.column(piece.schema.get_field_index(text)))
            docs.append(doc + base)
            values.append(value)
            base += piece.num_rows
    return np.concatenate(docs), np.concatenate(values)


def identity(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit identity of each document's set."""
    size = np.bincount(doc, minlength=n).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    out = []
    for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value * np.uint64(k)), out=total[1:])
        out.append(mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)).view(np.int64))
    return size, out[0], out[1]


def packed(part: np.ndarray) -> list[bytes]:
    """Counts of a slab for the shuffle: a byte each, and places and counts of what goes beyond; places
    and counts alone where few are there."""
    pairs = lambda at, n: at.astype("<u2").tobytes() + n.astype("<u2").tobytes()
    at = np.flatnonzero(part)
    if 4 * len(at) < len(part):
        return [pairs(at, part[at])] if len(at) else []
    over, most = np.flatnonzero(part > 0xFF), len(part) // 4 - 1
    more = [over[k : k + most] for k in range(0, len(over), most)]
    return [np.minimum(part, 0xFF).astype(np.uint8).tobytes(), *(pairs(x, part[x] - 0xFF) for x in more)]


def unpack(data: bytes, total: np.ndarray) -> None:
    """Adds what ``packed`` gave."""
    if len(data) == len(total):
        total += np.frombuffer(data, np.uint8)
    else:
        half = len(data) // 2
        total[np.frombuffer(data[:half], "<u2")] += np.frombuffer(data[half:], "<u2")


def sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequency level (six steps for each doubling of the count) of each slot over all shingles, and how many
    documents there are of each number of shingles, up to 255."""
    slab = 1 << SLAB_BITS

    def count(batches):
        slots, hist = np.zeros(1 << SLOT_BITS, np.uint32), np.zeros(256, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                doc, value = shingles(Words(*buffers(piece.column(0))), SIZE)
                slot, times = np.unique((value >> np.uint64(64 - SLOT_BITS)).astype(np.uint32), return_counts=True)
                slots[slot] += times.astype(np.uint32)  # a bincount would be as long as the sketch, in eight bytes
                hist += np.bincount(np.minimum(np.bincount(doc, minlength=piece.num_rows), 255), minlength=256)
        small = np.minimum(slots, 0xFFFF).astype("<u2")
        for k in range(len(slots) >> SLAB_BITS):
            for data in packed(small[k * slab : (k + 1) * slab]):
                yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary())})
        yield pa.RecordBatch.from_pydict({"slab": pa.array([-1], pa.int32()), "data": pa.array([hist.astype("<i8").tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k < 0:
                    sums[k] = sums.get(k, 0) + np.frombuffer(data, "<i8")
                    continue
                unpack(data, sums.setdefault(k, np.zeros(slab, np.int64)))
        for k, total in sums.items():
            data = total.astype("<i8") if k < 0 else np.minimum(np.rint(6 * np.log2(total + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"slab": pa.array([k], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    level, hist = np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(256, np.int64)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(count), "slab int, data binary").repartition("slab").mapInArrow(common.tidy(add), "slab int, data binary")
    for row in counted.collect():  # 2**22 bytes in all, whatever the table's size
        if row["slab"] < 0:
            hist += np.frombuffer(row["data"], "<i8")
        else:
            level[row["slab"] * slab : (row["slab"] + 1) * slab] = np.frombuffer(row["data"], np.uint8)
    return level, hist


def spare(size):
    """Elements that a set of this size may lack in any set it links with."""
    return size - -(-size * PART // WHOLE)


def needed(size, light: int):
    """Keys that two sets share at least if they link and the lesser has this size: of the elements they
    share the k-th lies among the first spare + k of both. Light sets share one pair of elements."""
    return np.where(size > light, np.maximum(3, 1 + (size + 50) // 100), 1)


def boundary(hist: np.ndarray) -> int:
    """The largest size of a light set: light sets post pairs of their prefix, heavy ones post and
    scan; sets a heavy one may reach below the boundary do both. A set of 10 posts more pairs than
    it would postings twice over, so the least cost lies well below 40, and sizes above 255 (the last
    entry of the table) are heavy at any boundary."""
    a = np.arange(256)
    p = spare(a) + 1
    light, heavy = hist * p * (p + 1) // 2, hist * (spare(a) + needed(a, 0)) * (1 + SCAN_COST)
    cost = [light[2 : x + 1].sum() + heavy[max(2, -(-(x + 1) * PART // WHOLE)) :].sum() for x in range(1, 41)]
    return int(np.argmin(cost)) + 1


def keys_of(doc: np.ndarray, value: np.ndarray, size: np.ndarray, level: np.ndarray, light: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all that each set posts."""
    rank = (level[(value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(value) >> np.uint64(8))
    order = np.lexsort((rank, doc))
    doc, value = doc[order], value[order]
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(doc)) - first[doc]
    n = size[doc]
    prefix = spare(n) + needed(n, light)
    one = (place < prefix) & (n >= -(-(light + 1) * PART // WHOLE)) & (n > 1)
    out_doc, out_key = [doc[one]], [mix(value[one])]
    at = np.flatnonzero((place <= prefix) & (n <= light) & (n > 1))  # light: the prefix is one longer
    for gap in range(1, int(spare(light)) + 2):
        low = at[(place[at] + gap <= prefix[at]) & (place[at] + gap < n[at])]
        x, y = value[low], value[low + gap]
        out_doc.append(doc[low])
        out_key.append(mix(mix(np.minimum(x, y)) ^ np.maximum(x, y) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out_doc), np.concatenate(out_key)


def candidates(batches, light: int):
    """(u, v, shared, needed) of batches sorted by (key, n_shingles, s1): pairs of sets that share a key, how many they
    share here and how many they need; neighbours on long lists need none. A list is counted or chained as a whole."""
    kept, chained, budget = None, False, 0

    def found(key, size, s1, first_chained):
        nonlocal budget
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(start, len(key)))
        budget += SPENT * len(key)
        count = n <= ALWAYS
        for k in np.flatnonzero((n > ALWAYS) & (n <= COUNTED)):
            pairs = int(n[k]) * (int(n[k]) - 1) // 2
            if pairs <= budget:
                count[k], budget = True, budget - pairs
        if first_chained:
            count[0] = False
        left = np.repeat(start + n, n) - np.arange(len(key)) - 1
        after = np.where(np.repeat(count, n), left, np.minimum(left, 1))
        x = np.repeat(np.arange(len(key)), after)
        y = x + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after) + 1
        near = PART * size[y] <= WHOLE * size[x]
        x, y = x[near], y[near]
        need = np.where(np.repeat(count, n)[x], needed(size[x], light), 0)
        pair, shared = np.unique(np.stack([np.minimum(s1[x], s1[y]), np.maximum(s1[x], s1[y]), need]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(shared), pa.array(pair[2])], ["u", "v", "shared", "needed"])

    for batch in batches:
        rows = [np.asarray(batch.column(k)) for k in range(3)]
        if kept is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(kept, rows)]
        if not len(rows[0]):
            continue
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in rows], axis=0)])
        rows = [x[new] for x in rows]
        key = rows[0]
        last = int(np.searchsorted(key, key[-1]))  # the last list may go on
        long = len(key) - last > COUNTED
        if last or long:
            out = found(*(x[: len(key) if long else last] for x in rows), chained)
            if out.num_rows:
                yield out
        chained = long or (chained and not last)
        kept = [x[-1 if long else last :] for x in rows]
    if kept is not None and len(kept[0]):
        out = found(*kept, chained)
        if out.num_rows:
            yield out


def links(doc: np.ndarray, value: np.ndarray, size: np.ndarray, copies: np.ndarray, side: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least set that each set reaches by links, number of documents it links with). across: only
    sets of different sides are held against each other."""
    n = len(size)
    _, term = np.unique(value, return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted, length = doc[order], np.bincount(term, minlength=1)
    first = np.cumsum(length) - length
    # The one large matrix: floats are exact up to 2**24, doubles beyond.
    both = np.zeros((n, n), np.float32 if size.max(initial=0) < 1 << 24 else np.float64)
    heavy = np.flatnonzero(length > max(16, n // SHARE))
    for k in range(0, len(heavy), SLAB):
        lists = heavy[k : k + SLAB]
        column = np.repeat(np.arange(len(lists)), length[lists])
        row = posted[np.arange(len(column)) + np.repeat(first[lists] - np.cumsum(length[lists]) + length[lists], length[lists])]
        holds = np.zeros((n, len(lists)), np.float32)
        holds[row, column] = 1
        for r in range(0, n, 256):
            both[r : r + 256] += holds[r : r + 256] @ holds.T
    # Light lists: each posting with all after it in its list.
    light = (length > 1) & (length <= max(16, n // SHARE))
    after = np.where(light[term[order]], (first + length)[term[order]] - np.arange(len(order)) - 1, 0)
    ends, k = np.cumsum(after), 0
    flat = both.reshape(-1)
    while k < len(order) and ends[-1] > (ends[k - 1] if k else 0):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(k, to), after[k:to])
        y = x + np.arange(len(x)) - np.repeat(np.cumsum(after[k:to]) - after[k:to], after[k:to]) + 1
        pair, times = np.unique(posted[x] * n + posted[y], return_counts=True)
        flat[pair] += times
        flat[pair % n * n + pair // n] += times
        k = to
    linked, found = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for k in range(0, n, 256):  # a few rows at a time: the matrix alone is in memory whole
        rows = slice(k, k + 256)
        shared = both[rows].astype(np.float64)
        linked[rows] = WHOLE * shared >= PART * (size[rows, None] + size[None, :] - shared)
        if across:
            linked[rows] &= side[rows, None] != side[None, :]
    np.fill_diagonal(linked, False)
    for k in range(0, n, 256):
        found[k : k + 256] = linked[k : k + 256] @ copies
    root = np.full(n, -1)
    for x in range(n):
        if root[x] < 0:
            root[x], edge = x, np.array([x])
            while len(edge):
                edge = np.flatnonzero(linked[edge].any(0) & (root < 0))
                root[edge] = x
    return root, found


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (linked documents) for every row of docs(doc_id, text)."""
    return _join(docs).drop("row_id")


def _join(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    # Rows without an id are told apart by a hash of their text.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_id", F.coalesce("doc_id", F.xxhash64("text")))
    level, hist = sketch(docs)
    light = boundary(hist)
    held = spark.sparkContext.broadcast(level)

    def post(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                n = piece.num_rows
                doc, value = sets_of(piece.column(1))
                size, s1, s2 = identity(doc, value, n)
                # Of equal sets in a piece one posts.
                first = np.zeros(n, bool)
                first[np.unique(np.stack([s1, s2]), axis=1, return_index=True)[1]] = True
                keep = first[doc]
                of, key = keys_of(doc[keep], value[keep], np.where(first, size, 0), held.value, light)
                order = np.argsort(of, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(size), pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order].view(np.int64)))], ["doc_id", "row_id", "n_shingles", "s1", "s2", "keys"])

    posted = settle(docs.mapInArrow(common.tidy(post), "doc_id long, row_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "posted")
    common.sweep(spark)  # the sketch's

    # Lists are sorted a share of all keys at a time, so that the disk holds one share.
    shares = -(-int(posted.agg(F.coalesce(F.sum(F.size("keys").cast("long")), F.lit(0))).first()[0]) // LISTS) or 1
    edges = []
    for k in range(shares):
        mine = F.filter("keys", lambda x: F.pmod(x, F.lit(shares)) == k) if shares > 1 else F.col("keys")  # noqa: B023
        lists = posted.select(F.explode(mine).alias("key"), F.col("n_shingles"), "s1").repartition("key").sortWithinPartitions("key", "n_shingles", "s1")
        edges.append(lists.mapInArrow(common.tidy(functools.partial(candidates, light=light)), "u long, v long, shared long, needed long").groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed")))
        if shares > 1:
            edges[-1] = settle(edges[-1], "edges")
            common.sweep(spark)
    pairs = functools.reduce(DataFrame.unionByName, edges)
    if shares > 1:
        pairs = pairs.groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed"))
    cluster = components(pairs.where("shared >= needed").select("u", "v"), "clusters")
    common.sweep(spark)

    kinds = posted.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("row_id").alias("node"), F.first("n_shingles").alias("size"))
    kinds = settle(kinds, "kinds")
    member = settle(kinds.join(cluster.withColumnRenamed("node", "s1"), "s1").select("node", "s1", "s2", "copies", "size", F.col("component").alias("cluster")), "members")
    blocks = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = member.join(blocks, "cluster").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "copies", "s1", "s2")
    # Most texts are in no cluster and needn't move.
    wanted = common.sift(docs.select(F.col("row_id").alias("node"), "text"), "node", common.sieve(member, "node"), "wanted").where("wanted")
    if dealt.count() <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    named = wanted.join(dealt, "node").select("cluster", "i", "j", "mine", "node", "copies", "s1", "s2", "text")

    def compare(batches):
        group, rows = None, []

        def done():
            table = pa.Table.from_batches(rows)
            # Rows that repeat an id may have fetched each other's text: the set's identity tells.
            doc, value = sets_in(table, "text")
            _, s1, s2 = identity(doc, value, table.num_rows)
            right = (s1 == np.asarray(table.column(6).combine_chunks())) & (s2 == np.asarray(table.column(7).combine_chunks()))
            _, at = np.unique(np.where(right, np.stack([s1, s2]), 0), axis=1, return_index=True)
            at = np.sort(at[right[at]])
            table = table.take(pa.array(at))
            doc, value = sets_in(table, "text")
            size = np.bincount(doc, minlength=len(at)).astype(np.int64)
            node, copies, side = (np.asarray(table.column(k).combine_chunks()) for k in (4, 5, 3))
            root, found = links(doc, value, size, copies, side, group[1] != group[2])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root]), pa.array(found)], ["node", "root", "links"])

        for batch in batches:
            ids = [np.asarray(batch.column(k)) for k in range(3)]
            cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in ids], axis=0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                this = tuple(int(x[a]) for x in ids)
                if this != group:
                    if rows:
                        yield done()
                    group, rows = this, []
                rows.append(batch.slice(a, b - a))
        if rows:
            yield done()

    found = settle(named.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(common.tidy(compare), "node long, root long, links long"), "links")
    common.sweep(spark)
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = kinds.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").join(counts, "node", "left").select("s1", "s2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return posted.select("doc_id", "row_id", "n_shingles", "s1", "s2").join(known, ["s1", "s2"], "left").select("doc_id", "row_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the class's own id; one row of each id. A row without id
    stays if no row of its class has one, once for each text. Rows that surely stay aren't moved."""
    found = settle(_join(docs).select("row_id", "doc_id", "component_id"), "kept")
    stays = F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id"))
    judged = found.groupBy("row_id").agg(F.min(stays).alias("stays"), F.count("*").alias("n"))
    doubtful = settle(judged.where("NOT stays OR n > 1"), "doubtful")
    own = common.unused(docs)
    key, flag = own + "key", own + "flag"
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    sifted = common.sift(keyed, key, common.sieve(doubtful, "row_id"), flag)
    again = sifted.where(F.col(flag))
    told = doubtful.select(F.col("row_id").alias(own + "row"), F.col("stays").alias(own + "stays"), F.col("n").alias(own + "n"))
    again = again.join(told, F.col(key) == F.col(own + "row"), "left").where(F.coalesce(F.col(own + "stays"), F.lit(True)))
    once = again.where(F.coalesce(F.col(own + "n"), F.lit(1)) == 1).select(*docs.columns).unionByName(again.where(F.col(own + "n") > 1).dropDuplicates([key]).select(*docs.columns))
    return sifted.where(~F.col(flag)).select(*docs.columns).unionByName(once)
