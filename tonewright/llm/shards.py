"""Shards of nearly equal bytes by histogram sort. DataFrame operations only.

Rows are ordered by a key: 60 bits of the text's md5, then the id, then the row's place in the table,
which tells repeated rows apart. Splitters of the order are found without sorting: the bytes and rows
below evenly spaced probes are counted over all partitions, and each round puts new probes only into
the stretches that matter: those in which a splitter falls, and those with more rows than a task
should hold. A round reads keys and sizes alone, from a table written once, and shuffles one row a
stretch. A splitter falls between two texts, the nearest such place, if that keeps the bytes below it
within TOLERANCE of a shard's mean; so equal texts share a shard. Only a group of copies too large for
that is split, between the two rows nearest to the target. Then all rows are exchanged once, by
stretch, and numbered; what stands before a stretch is known from the counts, so shards are no tasks
of their own, and a group of copies is dealt over many.

Cases: a null text has no bytes, size 1, and is one text with the empty one; rows without id come first
among copies; repeated rows are rows of their own; a text larger than a shard leaves shards beside it
empty; an empty table gives no rows; very long texts are whole; other columns, whatever their names, are
ignored by ``place`` and kept by ``write``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .importance import CRC, CRC_TABLE

SHARDS = 8
TOLERANCE = (1, 100)  # of a shard's mean bytes
PROBES = 4096  # of the first round, and of a stretch in which a splitter falls
STRETCH = 1_000_000  # rows of a stretch, where a table has many; else a 1,024th of all
_KEY = ("k", "high", "low", "place")  # each fits in 63 bits, so does the difference of two


def keyed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Every row's id, size and text_crc32, the key but for ``place``, and if asked all columns as ``row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.struct("*").alias("row")] * keep, F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("k"))
    # An id in two halves; a null one stands before all others.
    return rows.withColumns({"high": F.coalesce(F.shiftright("doc_id", 32), F.lit(-(1 << 31) - 1)), "low": F.coalesce(F.col("doc_id").bitwiseAND((1 << 32) - 1), F.lit(0))})


def _counted(rows: DataFrame) -> DataFrame:
    """A row for each stretch: its path, rows, bytes, and the ends of each part of the key."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in _KEY for f in (F.min, F.max)]
    return rows.groupBy("path").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def _divided(rows: DataFrame, busy: DataFrame) -> DataFrame:
    """Rows of busy stretches go to one of ``probes`` parts, by the first part of the key that isn't the same
    in all of the stretch, and are marked ``moved``; the others stay where they are."""
    at, low, high = (F.coalesce(*[F.when(F.expr(f"min_{c} < max_{c}"), F.col(x + c)) for c in _KEY]) for x in ("", "min_", "max_"))
    held = busy.select(F.col("path").alias("_path"), "probes", *[f"{x}_{c}" for c in _KEY for x in ("min", "max")])
    found = rows.drop("moved").join(F.broadcast(held), F.col("path") == F.col("_path"), "left")  # a row for each busy stretch
    found = found.withColumns({"_at": at - low, "_width": high - low})
    moved = F.col("_path").isNotNull()
    return found.withColumn("path", F.when(moved, F.concat("path", F.array(F.expr("_at div (_width div probes + 1)")))).otherwise(F.col("path"))).withColumn("moved", moved).select(*[c for c in rows.columns if c != "moved"], "moved")


def _judged(found: DataFrame, shards: int, tolerance: tuple[int, int]) -> DataFrame:
    """Stretches with what stands before them, the edges of texts around them, the numbers j of the targets
    j * all / shards that fall into each, and whether it is ``busy``: a splitter can still move
    in it, or it has more rows than a task should hold."""
    order = Window.orderBy("path")
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    exact = lambda c: c.cast("decimal(28,0)")
    out = found.withColumns({"before": exact(F.coalesce(F.sum("bytes").over(past), F.lit(0))), "rows_before": F.coalesce(F.sum("rows").over(past), F.lit(0)), "all": exact(F.sum("bytes").over(whole)), "all_rows": F.sum("rows").over(whole), "_starts": F.coalesce(F.col("min_k") > F.lag("max_k").over(order), F.lit(True)), "_ends": F.coalesce(F.col("max_k") < F.lead("min_k").over(order), F.lit(True))})
    out = out.withColumn("after", exact(F.expr("before + bytes")))
    out = out.withColumns({"text_start": F.max(F.when(F.col("_starts"), F.col("before"))).over(order), "text_end": F.min(F.when(F.col("_ends"), F.col("after"))).over(Window.orderBy(F.desc("path")))})
    first, last = (f"CAST({x} * {shards} / all AS INT)" for x in ("before", "after"))
    out = out.withColumn("targets", F.expr(f"filter(sequence({first}, {last} + 1), j -> j > 0 AND j < {shards} AND j * all >= before * {shards} AND j * all < after * {shards})"))
    out = out.withColumn("most", F.greatest(F.lit(1), F.least(F.lit(STRETCH), F.expr("all_rows div 1024"))))
    loose = f"exists(targets, j -> NOT {_near(shards, tolerance)})"
    return out.withColumn("busy", F.expr(f"rows > 1 AND (rows > most OR size(targets) > 0 AND (min_k < max_k OR {loose}))"))


def _near(shards: int, tolerance: tuple[int, int]) -> str:
    """Whether an edge of texts is near enough to target j."""
    return f"least(j * all - text_start * {shards}, text_end * {shards} - j * all) * {tolerance[1]} <= all * {tolerance[0]}"


def stretches(rows: DataFrame, shards: int = SHARDS, tolerance: tuple[int, int] = TOLERANCE, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(rows with the ``path`` of their stretch, stretches in which no splitter can move any more)."""
    rows = rows.withColumns({"path": F.array().cast("array<long>"), "moved": F.lit(True)})
    found = _counted(rows)
    while True:
        many = F.greatest(F.when(F.expr("size(targets) > 0 OR size(path) = 0"), probes).otherwise(64), F.least(F.expr("2 * rows div most"), F.lit(1 << 20))).cast("long")
        told = common.settle(_judged(found, shards, tolerance).withColumn("probes", many), "stretches")
        busy = told.where("busy")
        if busy.isEmpty():
            return rows, told
        rows = _divided(rows, busy)
        inside = _counted(rows.where("moved"))
        found = told.where("NOT busy").select(*inside.columns).unionByName(inside)


def _cut(told: DataFrame, shards: int, tolerance: tuple[int, int]) -> DataFrame:
    """path, shard, and the slot of the first row of each stretch."""
    ends = told.select(F.explode("targets").alias("j"), "before", "after", "text_start", "text_end", "all")
    pick = "CASE WHEN j * all - {0} * {2} <= {1} * {2} - j * all THEN {0} ELSE {1} END"
    edge = F.expr(f"CASE WHEN {_near(shards, tolerance)} THEN {pick.format('text_start', 'text_end', shards)} ELSE {pick.format('before', 'after', shards)} END")
    edges = ends.groupBy(edge.alias("edge")).agg(F.count("*").alias("cuts"))
    out = told.join(F.broadcast(edges), F.col("before") == F.col("edge"), "left")  # a row for each splitter at most
    out = out.withColumn("shard", F.coalesce(F.sum("cuts").over(Window.orderBy("path")), F.lit(0)).cast("int"))
    return out.select(F.col("path").alias("_path"), "shard", (F.col("rows_before") - F.min("rows_before").over(Window.partitionBy("shard"))).alias("_first"))


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: tuple[int, int] = TOLERANCE, probes: int = PROBES, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0, in the order of the key) of every row; if asked all its
    columns as ``row``."""
    rows = common.settle(keyed(docs, keep), "keys").withColumn("place", F.monotonically_increasing_id())
    rows, told = stretches(rows, shards, tolerance, probes)
    cut = common.settle(_cut(told, shards, tolerance), "cuts")
    number = F.row_number().over(Window.partitionBy("path").orderBy(*_KEY))
    out = rows.withColumn("_number", number).join(cut, F.col("path") == F.col("_path"))
    return out.select(*["row"] * keep, "doc_id", "size", "text_crc32", "shard", F.expr("CAST(_first + _number - 1 AS BIGINT)").alias("slot"))


def place(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: a shard more moves splitters) of every row."""
    return assign(docs, **options).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, **options) -> str:
    """Writes the rows as Parquet, a folder for each shard, with their slot. The names of both begin with
    underscores enough to clash with none; that prefix is returned."""
    own = common.unused(docs)
    found = assign(docs, keep=True, **options).select("row.*", F.col("shard").alias(own + "shard"), F.col("slot").alias(own + "slot"))
    found.write.partitionBy(own + "shard").parquet(path)
    return own


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS ({CRC_TABLE}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
r AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, {CRC.format("hex(encode(text))")} AS text_crc32, ('0x' || md5(text)[1:15])::BIGINT AS k FROM d, t),
o AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER w AS after, sum(size) OVER () AS everything FROM r WINDOW w AS (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, min(before) OVER (PARTITION BY k) AS text_start, max(after) OVER (PARTITION BY k) AS text_end FROM o),
j AS (SELECT unnest(range(1, {SHARDS})) AS j),
e AS (SELECT CASE WHEN least(j * everything - text_start * {SHARDS}, text_end * {SHARDS} - j * everything) * {TOLERANCE[1]} <= everything * {TOLERANCE[0]}
    THEN CASE WHEN j * everything - text_start * {SHARDS} <= text_end * {SHARDS} - j * everything THEN text_start ELSE text_end END
    ELSE CASE WHEN j * everything - before * {SHARDS} <= after * {SHARDS} - j * everything THEN before ELSE after END END AS edge
  FROM p JOIN j ON j * everything >= before * {SHARDS} AND j * everything < after * {SHARDS}),
s AS (SELECT p.*, (SELECT list(edge) FROM e) AS edges FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INT AS grown_shard
FROM (SELECT *, coalesce(len(list_filter(edges, lambda x: x <= before)), 0)::INT AS shard FROM s)
"""
