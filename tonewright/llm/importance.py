"""Resampling documents towards a target distribution, by importance weights of hashed n-grams.

Features are the runs of 1 to ``most`` words of a text, joined by one space, hashed into buckets by
CRC-32. No run is ever written out: each word's CRC is computed once, and that of a run follows from
those of its words, since crc(AB) = L(crc(A), len(B)) xor crc(B), L being the linear map over GF(2)
that feeds zero bytes to the register. L for any length is a product of its powers of two, each kept
as four look-up tables of 256 entries. Counts of a task are added up in one array of ``buckets``
numbers before the shuffle; the gains, one number a bucket, are broadcast. The draw adds Gumbel noise
from the id's hash to a document's weight and takes the highest scores: the K best of N, without
replacement, in proportion to the weights. Ranks come from a histogram of scores, one exchange by
ranges of (score, id) of what can be drawn, and a count for each range.

Cases: null and empty texts, and texts without words, have no features, weight 0, and are never drawn
if ``least`` is above 0; a null id is hashed as the text ``null`` and precedes others in ties; repeated
rows count and are drawn as rows of their own; a very long text is worked on whole, in memory of a
multiple of its size; without target texts all counts there are 0; an empty table gives no rows;
other columns, whatever their names, are ignored by ``scores`` and kept by ``select_texts``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .textkit import LOWER, buffers, pieces

MOST, BUCKETS, SEED, LEAST, SHARE = 1, 10_000, 2024, 20, (10, 100)
BIN = 16  # of scores in a bar of the histogram
LONG = 64  # bytes of a word from which on it is hashed by itself

#: Bytes of words: digits, a to z, and whatever isn't ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    """The register after one byte, for the 256 values of its low byte (reflected CRC-32)."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(0xEDB88320), register >> 1)
    return register


TABLE = _table()


def _powers(n: int = 40) -> list[np.ndarray]:
    """For each power of two, the map that feeds as many zero bytes, as tables for the register's bytes."""
    unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    maps = [TABLE[unit & 255] ^ (unit >> 8)]
    while len(maps) < n:
        maps.append(_apply(maps[-1], maps[-1]))
    return maps


def _apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    return m[0][x & 255] ^ m[1][x >> 8 & 255] ^ m[2][x >> 16 & 255] ^ m[3][x >> 24]


POWERS = _powers()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC moved past ``length`` bytes that follow."""
    out = crc.copy()
    for bit, m in enumerate(POWERS[: int(length.max(initial=0)).bit_length()]):
        at = np.flatnonzero(length >> bit & 1)
        out[at] = _apply(m, out[at])
    return out


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, index of each document's first word) of the words of a run of texts."""
    raw = LOWER[raw]
    inside = INSIDE[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[:1], after[-1:] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = off[(off > 0) & (off < len(raw))]
    before[edge], after[edge - 1] = False, False  # words never cross documents
    start = np.flatnonzero(inside & ~before)
    return raw, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, off)


def crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice, all slices one byte at a time; those of LONG bytes and more one by one."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    begin, left = start[order], size[order]
    now = np.full(len(order), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-left, -LONG, "right"))  # slices before this one are long
    for k in range(min(LONG, int(left[first]) if first < len(left) else 0)):
        live = int(np.searchsorted(-left, -k, "left"))
        now[first:live] = TABLE[(now[first:live] ^ raw[begin[first:live] + k]) & 255] ^ (now[first:live] >> 8)
    out = np.empty_like(now)
    out[order] = ~now
    for k in range(first):
        out[order[k]] = zlib.crc32(raw[begin[k] : begin[k] + left[k]])
    return out


def features(raw: np.ndarray, off: np.ndarray, most: int = MOST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each document, for each size up to ``most`` (document, CRC-32) of every run of words)."""
    raw, start, end, first = words(raw, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    size, one = end - start, crcs(raw, start, end)
    found = [(doc, one)]
    if most > 1:
        place = np.arange(len(doc)) - first[doc]
        spaced = shifted(np.full(len(one), zlib.crc32(b" "), np.uint32), size) ^ one  # of the word and a space before it
        run = one
        for k in range(1, most):
            longer = np.zeros_like(run)
            longer[1:] = shifted(run[:-1], size[1:] + 1) ^ spaced[1:]
            run, at = longer, np.flatnonzero(place >= k)
            found.append((doc[at], run[at]))
    return count, found


def counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket; those without any are left out."""

    @common.tidy
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                for _, crc in features(*buffers(part.column(0)), most)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: thousandths of the logarithm of how much
    likelier it is in the target. ``buckets`` numbers come to the driver, whatever the tables' sizes."""
    both = counts(docs, most, buckets).withColumn("own", F.lit(True)).unionByName(counts(target, most, buckets).withColumn("own", F.lit(False)))
    found = both.collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in found:
        (s if row.own else t)[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int = MOST, prefix: str = "", keep: bool = False) -> DataFrame:
    """The rows with n_words, n_features and weight, the floored mean of the gains of a document's features,
    under names that begin with ``prefix``; without ``keep`` doc_id is the only other column."""
    gain = docs.sparkSession.sparkContext.broadcast(gain)
    columns = docs.columns if keep else ["doc_id"]
    added = [prefix + c for c in ("n_words", "n_features", "weight")]
    text = prefix + "text_"
    asked = docs.select(*columns, F.col("text").cast("string").alias(text))
    schema = T.StructType([*asked.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in added)])

    @common.tidy
    def weigh(batches):
        for batch in batches:
            for part in pieces(batch, text):
                n_words, found = features(*buffers(part.column(len(columns))), most)
                total, n = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for doc, crc in found:
                    at = np.bincount(doc, minlength=len(n))
                    total += np.add.reduceat(np.append(gain.value[crc % np.uint32(len(gain.value))], 0), np.minimum(np.cumsum(at) - at, len(doc))) * (at > 0) if len(at) else 0
                    n += at
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, (n_words, n, total // np.maximum(n, 1)))], names=[*columns, *added])

    return asked.mapInArrow(weigh, schema)


def noise(seed: int, doc_id: str = "doc_id"):
    """Gumbel noise in thousandths, floored, from the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, prefix: str = "", share: tuple[int, int] = SHARE, least: int = LEAST) -> DataFrame:
    """Settled rows with n_words and score -> the same with ``rank`` (long) from 1 of the share that is drawn."""
    n_words, score, rank, place, part, before = (prefix + c for c in ("n_words", "score", "rank", "place", "range", "before"))
    rows = rows.withColumn(place, F.monotonically_increasing_id())  # tells repeated rows apart
    may = F.col(n_words) >= least
    bars = rows.where(may).groupBy(F.floor(F.col(score) / BIN).alias("bar")).agg(F.count("*").alias("n"))
    down = bars.withColumns({"above": F.sum("n").over(Window.orderBy(F.desc("bar"))), "all": F.sum("n").over(Window.partitionBy())})
    found = down.select((F.floor(F.col("all") * share[0] / share[1])).alias("drawn"), "bar", F.expr("above - n").alias("over")).where("over < drawn").agg(F.min("bar").alias("bar"), F.max("drawn").alias("drawn")).first()
    none = F.lit(None).cast("long")
    if not found.drawn:
        return rows.withColumn(rank, none).drop(place)
    high = may & (F.col(score) >= found.bar * BIN)
    order = [F.desc(score), F.asc_nulls_first("doc_id"), F.asc(place)]
    # Ranges of equal numbers of rows; then how many rows stand before each of them.
    dealt = common.settle(rows.where(high).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(part).agg(F.count("*").alias(before))
    sums = sums.select(F.col(part).alias(part + "_"), (F.sum(before).over(Window.orderBy(part)) - F.col(before)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    told = dealt.withColumn(rank, inside).join(F.broadcast(sums), F.col(part) == F.col(part + "_"))  # a row for each range
    told = told.withColumn(rank, F.col(rank) + F.col(before)).withColumn(rank, F.when(F.col(rank) <= found.drawn, F.col(rank)))
    return rows.where(~high).withColumn(rank, none).unionByName(told.drop(part, part + "_", before)).drop(place)


def scores(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED, share: tuple[int, int] = SHARE, least: int = LEAST) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn), n_words of every document."""
    found = weights(docs.withColumn("doc_id", F.col("doc_id").cast("long")), gains(docs, target, most, buckets), most)
    found = common.settle(found.withColumn("score", F.col("weight") + noise(seed)), "scores")
    return ranked(found, "", share, least).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def select_texts(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED, share: tuple[int, int] = SHARE, least: int = LEAST) -> DataFrame:
    """The documents that are drawn, with all their columns."""
    own = common.unused(docs)
    found = weights(docs, gains(docs, target, most, buckets), most, own, keep=True)
    found = common.settle(found.withColumn(own + "score", F.col(own + "weight") + noise(seed)), "scores")
    return ranked(found, own, share, least).where(F.col(own + "rank").isNotNull()).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The register's table and the CRC of a blob's hexadecimal digits, for DuckDB.
CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({0}, '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"

ORACLE = f"""
WITH t AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT row, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
v AS (SELECT word, {CRC.format('h')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)), t),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN v USING (word) GROUP BY ALL),
g AS (SELECT bucket, count(*) AS n FROM bw JOIN v USING (word) GROUP BY ALL),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM g), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket)),
f AS (SELECT row, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM dw JOIN v USING (word) JOIN gain USING (bucket) GROUP BY row),
a AS (SELECT doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight, len(w) AS n_words,
    coalesce(f.weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN f USING (row)),
r AS (SELECT *, CASE WHEN n_words >= {LEAST} THEN row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM a WHERE n_words >= {LEAST}) * {SHARE[0]} // {SHARE[1]} THEN place END AS rank, n_words FROM r
"""
