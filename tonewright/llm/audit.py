"""Audit of how filters interact: what each removes, alone and in every order.

Which filters a document fails is one mask of bits. Whether its text repeats that of a smaller id is
found by routing: documents go to partitions by the xxhash of their text, as one record for each text
and task, and meet there in the order of hash and id. A hash has a chain of the different texts that
share it, each in full with its smallest id; ids above it are emitted as repeats. Within a task, what
repeats a smaller id is settled at once and travels without its text, so copies of one text never
gather in one partition: it gets one record of each task (one more for every HELD bytes of texts).
``combineByKey`` adds the masks up to one vector of counts for each part, in the tasks first; the
counts of all orders, and the Shapley sums over them, follow from the vector.

Cases: a null text is empty; a row without id repeats nothing and nothing repeats it; rows equal in id
and text are copies of no smaller id, and each counts; a null part is the empty string; of several
labels of one id each mark counts once; documents without labels are neither good nor toxic; a very
long text is worked on whole, in memory of a multiple of its size; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 100, 80, 10, b"#$%&*|"
HELD = 32 << 20  # bytes of texts that a task holds to find repeats among its own rows
ROUTED = 64 << 20  # bytes of texts for each partition that they are routed to
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_SIGN = re.compile(b"[" + re.escape(SIGNS) + b"]")
_REPEAT = 1 << LETTERS.index("E")


def fails(body: bytes, n_chars: int) -> int:
    """The mask of the filters that judge a text by itself."""
    words = body.split()  # at space, and tab to carriage return
    capitals = len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 | (100 * capitals > MOST_CAPITALS * n_chars) << 2 | (_SIGN.search(body) is not None) << 3


def _own(rows: Iterable) -> Iterator[tuple]:
    """((hash, id), (text or None, part, mask, n)) of a task's rows. Without a text the mask is final; with
    one, the id is the smallest that the task has seen of that text, and n rows have it."""
    chains: dict[int, list] = {}
    held = 0

    def told() -> Iterator[tuple]:
        for key, chain in chains.items():
            for body, least, marks in chain:
                for k, ((part, mask), n) in enumerate(marks.items()):
                    yield (key, least), (body, part, mask, n)

    for doc_id, part, text in rows:
        text, part = text or "", part or ""
        body = text.encode()
        mask = fails(body, len(text))
        if doc_id is None:
            yield (xxhash.xxh64_intdigest(part.encode(), mask), 0), (None, part, mask, 1, None)
            continue
        key = xxhash.xxh64_intdigest(body)
        chain = chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == body:
                break
        else:
            chain.append(entry := [body, doc_id, Counter()])
            held += len(body) + 200
        if doc_id > entry[1]:
            yield (xxhash.xxh64_intdigest(str(doc_id)), 0), (None, part, mask | _REPEAT, 1, doc_id)
            continue
        if doc_id < entry[1]:
            for (p, m), n in entry[2].items():
                yield (xxhash.xxh64_intdigest(str(entry[1])), 0), (None, p, m | _REPEAT, n, entry[1])
            entry[1:] = [doc_id, Counter()]
        entry[2][part, mask] += 1
        if held > HELD:
            yield from told()
            chains, held = {}, 0
    yield from told()


def _met(records: Iterable) -> Iterator[tuple]:
    """(id, part, mask, n), final, of a partition's records in the order of hash and id."""
    now, chain = None, []
    for (key, doc_id), (body, part, mask, n, *known) in records:
        if body is None:
            yield known[0], part, mask, n
            continue
        if key != now:
            now, chain = key, []
        for other, least in chain:
            if other == body:
                yield doc_id, part, mask | (_REPEAT if doc_id > least else 0), n
                break
        else:
            chain.append((body, doc_id))
            yield doc_id, part, mask, n


def masks(docs: DataFrame, part: str = "lang") -> RDD:
    """(doc_id, part, mask, n) of all documents: n rows of this id and part fail the filters of the mask."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(size // ROUTED, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col(part).cast("string"), F.col("text").cast("string"))
    routed = rows.rdd.mapPartitions(_own).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    return routed.mapPartitions(_met)


def _one(row) -> np.ndarray:
    return _more(np.zeros((1 << len(LETTERS), 3), np.int64), row)


def _more(vector: np.ndarray, row) -> np.ndarray:
    mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def orders(vector: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the rows,
    good rows and toxic rows of each mask."""
    mask = np.arange(len(vector))
    bit = {c: 1 << k for k, c in enumerate(LETTERS)}
    found, shapley = [], Counter()
    for order in itertools.permutations(LETTERS):
        gone = 0
        for step, c in enumerate(order, 1):
            failing, before = (mask & bit[c]) > 0, (mask & gone) > 0
            removed, good, toxic = vector[failing & ~before].sum(0).tolist()
            gone |= bit[c]
            found.append(("".join(order), step, int(vector[(mask & gone) == 0, 0].sum()), removed, int(vector[failing & before, 0].sum()), int(vector[bit[c], 0]), good, toxic))
            shapley[c] += removed
    for row in found:
        yield *row, shapley[row[0][row[1] - 1]]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """docs(doc_id, text, part), labels(doc_id, quality, toxic) -> one row for each part, order and step."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(masks(docs, part), "doc_id long, part string, mask int, n long", verifySchema=False)
    rows = common.settle(rows, "masks")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", *[F.coalesce(c, F.lit(False)).cast("int").alias(c) for c in ("good", "toxic")])
    bare = rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    vectors = marked.unionByName(bare).rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_one, _more, np.add)
    return spark.createDataFrame(vectors.flatMap(lambda x: [(x[0], *row) for row in orders(x[1])]), COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INT
    + 4 * (100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > {MOST_CAPITALS} * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT substr('ABCDE', i, 1) AS c, 1 << (i - 1) AS bit FROM range(1, 6) r(i)),
o AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM o, (SELECT unnest(range(1, 6)) AS step)),
x AS (SELECT part, filter_order, step, any_value(bit) AS bit, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS toxic_lost FROM v, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""
