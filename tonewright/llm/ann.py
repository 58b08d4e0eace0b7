"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each with its own codebook; a cell is a pair of centroids.
A query walks the cells by the sum of its halves' products with the centroids, best first,
with a heap (the multi-sequence walk), until they hold enough vectors, and these are
ranked by their exact inner product. How many are enough is measured: a few queries are
answered by brute force, and the walk is made as long as TARGET of their neighbours need.

Equal vectors are one entry of the index with their RESULTS + 1 smallest ids, which is all
that a list of RESULTS with ties to smaller ids can hold. Cells are dealt to shards of
bounded size; a cell larger than a shard is dealt over several. The queries that visit a shard
meet it in batches of bounded size, so no task holds more than one shard and one batch.

Cases: vectors null, zero, of another length than most, or with null or non-finite
components, and rows without id, take no part; where there are fewer candidates all are
returned; rows that repeat an id are candidates each; ties go to the smaller id; a table without queries or vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import settle

EVERY, RESULTS = 20, 20
TARGET, PROBES = 0.95, 128  # recall to reach on so many queries, those of least hash
SAMPLE = 20_000  # vectors, about, that the codebooks are fitted on, those of least hash
SHARD, BATCH = 8_192, 8_192  # vectors in a shard, and queries (about) that meet it in one task
ROUNDS = 12


def codebook(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k-means (Lloyd) with centroids started at distinct sample rows."""
    if not x.shape[1]:  # the second half of vectors of one component
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, c)
        size = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def walk(s1: np.ndarray, s2: np.ndarray, count: list[int], enough: int) -> list[int]:
    """Cells in falling order of s1 + s2 until they hold enough vectors; empty cells are passed."""
    k2 = len(s2)
    o1, o2 = np.argsort(-s1, kind="stable").tolist(), np.argsort(-s2, kind="stable").tolist()
    a, b = s1[o1].tolist(), s2[o2].tolist()
    heap, out, held = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heap[0]
        cell = o1[i] * k2 + o2[j]
        if count[cell]:
            out.append(cell)
            held += count[cell]
        if j + 1 < k2:
            heapq.heapreplace(heap, (-(a[i] + b[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return out


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of one length, in double precision."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def enough(placed: DataFrame, asked: DataFrame, books: list, parts: tuple, sizes: np.ndarray, results: int, target: float) -> int:
    """How many vectors a walk has to collect for ``target`` of the true neighbours of PROBES queries."""
    picked = asked.select("embedding").distinct().orderBy(F.xxhash64("embedding")).limit(PROBES).toArrow()
    if not picked.num_rows:
        return 0
    q = matrix(picked.column(0).combine_chunks())

    def exact(batches):
        best = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.concatenate([best[0], q @ matrix(batch.column(1)).T], 1)
            cell = np.concatenate([best[1], np.broadcast_to(np.asarray(batch.column(0)), (len(q), batch.num_rows))], 1)
            keep = np.argsort(-score, 1, kind="stable")[:, : results + 1]
            best = np.take_along_axis(score, keep, 1), np.take_along_axis(cell, keep, 1)
        r = np.repeat(np.arange(len(q)), best[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(best[1].ravel().astype(np.int32)), pa.array(best[0].ravel())], ["q", "cell", "score"])

    top = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    found = placed.select("cell", "embedding").mapInArrow(common.tidy(exact), "q int, cell int, score double").withColumn("r", F.row_number().over(top)).where(F.col("r") <= results + 1).select("q", "cell").collect()
    total = (q[:, parts[0]] @ books[0].T)[:, :, None] + (q[:, parts[1]] @ books[1].T)[:, None, :]
    total = total.reshape(len(q), -1)
    need = []
    for r in range(len(q)):
        order = np.argsort(-total[r], kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(sizes[order])
        need += [int(before[row["cell"]]) for row in found if row["q"] == r]
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(target * len(need))))])


def search(vectors: DataFrame, every: int = EVERY, results: int = RESULTS, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("embedding") == dim)
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= results + 1)
    entries = settle(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    sample = common.hash_sample(entries.select("embedding", F.col("ids")[0].alias("id")), SAMPLE, n, "embedding").toArrow()
    x = matrix(sample.column(0).combine_chunks())[np.argsort(np.asarray(sample.column(1).combine_chunks()), kind="stable")]
    k = int(np.clip(2 ** round(np.log2(0.5 * n**0.45)), 2, 256))
    half = max(1, dim // 2)
    parts = (slice(0, half), slice(half, dim)) if dim > 1 else (slice(0, 1), slice(0, 0))
    books = [codebook(x[:, p], k) for p in parts]
    k2 = len(books[1])

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                cell = nearest(v[:, parts[0]], books[0]) * k2 + nearest(v[:, parts[1]], books[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "embedding", "ids"])

    placed = settle(entries.select("embedding", "ids").mapInArrow(common.tidy(cells), "cell int, embedding array<double>, ids array<long>"), "cells")
    # At most 65,536 cells, whatever the number of vectors.
    sizes = np.zeros(len(books[0]) * k2, np.int64)
    for row in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[row["cell"]] = row["n"]
    candidates = enough(placed, rows.where(F.col("vec_id") % every == 0), books, parts, sizes, results, target)
    shard_of, over, shard, held = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > SHARD:
            shard, held = shard + 1, 0
        shard_of[cell], over[cell] = shard, -(-size // SHARD) or 1
        held += size
        if over[cell] > 1:
            shard, held = shard + int(over[cell]), 0
    deal = spark.sparkContext.broadcast((shard_of, over))

    def dealt(batches):
        first, n_over = deal.value
        for batch in batches:
            cell = np.asarray(batch.column(0))
            spread = np.abs(np.array([ids[0] for ids in batch.column(2).to_pylist()], np.int64)) if batch.num_rows else cell
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + spread % n_over[cell]).astype(np.int32)), *batch.columns], ["shard", "cell", "embedding", "ids"])

    def probes(batches):
        first, n_over = deal.value
        count = sizes.tolist()
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1))
            s1, s2 = q[:, parts[0]] @ books[0].T, q[:, parts[1]] @ books[1].T
            at, shards, lists = [], [], []
            for r in range(len(q)):
                by: dict[int, list[int]] = {}
                for cell in walk(s1[r], s2[r], count, candidates):
                    for k in range(int(n_over[cell])):
                        by.setdefault(int(first[cell]) + k, []).append(cell)
                at += [r] * len(by)
                shards += by.keys()
                lists += by.values()
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists, pa.list_(pa.int32()))], ["shard", "qid", "embedding", "cells"])

    asked = rows.where(F.col("vec_id") % every == 0)
    distinct = settle(asked.groupBy("embedding").agg(F.min("vec_id").alias("qid")), "queries")
    visits = settle(distinct.select("qid", "embedding").mapInArrow(common.tidy(probes), "shard int, qid long, embedding array<double>, cells array<int>"), "visits")
    # A shard is copied as often as the queries that visit it fill batches, and not at all if none does.
    batches = visits.groupBy("shard").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("batches"))
    left = visits.join(batches, "shard").withColumn("batch", F.pmod(F.xxhash64("qid"), "batches").cast("int")).drop("batches")
    right = placed.mapInArrow(common.tidy(dealt), "shard int, cell int, embedding array<double>, ids array<long>").join(batches, "shard").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).drop("batches")

    def rank(queries: pa.Table, held: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and held.num_rows:
            held = held.combine_chunks()
            cell = np.asarray(held.column("cell").combine_chunks())
            order = np.argsort(cell, kind="stable")
            cell, v = cell[order], matrix(held.column("embedding").combine_chunks())[order]
            ids = held.column("ids").combine_chunks()
            id_off, id_flat = np.asarray(ids.offsets), np.asarray(ids.values)
            q = matrix(queries.column("embedding").combine_chunks())
            for r, (qid, want) in enumerate(zip(queries.column("qid").to_pylist(), queries.column("cells").to_pylist())):
                a = np.searchsorted(cell, want, "left")
                size = np.searchsorted(cell, want, "right") - a
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                score = (v @ q[r])[at] if 4 * len(at) > len(v) else v[at] @ q[r]
                if len(at) > results + 1:
                    top = np.flatnonzero(score >= np.partition(score, -(results + 1))[-(results + 1)])
                    at, score = at[top], score[top]
                found = sorted((-s, int(i)) for s, o in zip(score.tolist(), order[at].tolist()) for i in id_flat[id_off[o] : id_off[o + 1]])[: results + 1]
                out[0].extend([qid] * len(found))
                out[1].extend(i for _, i in found)
                out[2].extend(-s for s, _ in found)
        return pa.table({"qid": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInArrow(rank, "qid long, vec_id long, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= results + 1).select("qid", F.col("vec_id").alias("found"), "score")
    every_query = asked.join(distinct, "embedding").select("vec_id", "qid")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_query.join(top, "qid").where("found <> vec_id").select(F.col("vec_id").alias("query_id"), F.col("found").alias("vec_id"), "score").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= results).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
