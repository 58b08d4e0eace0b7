"""Content-addressed results: written once under a key, by whoever comes first."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Cache:
    """Results under root/kind/key, every write in a folder of its own. The result is the write that was
    complete first; one that comes second sees so, removes its own and takes the first. No rename is
    needed, and writers never touch each other's folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.hits: list[str] = []
        self.misses: list[str] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, kind: str, key: str) -> str:
        return f"{self.root}/{kind}/{key}"

    def _listed(self, pattern: str) -> list:
        return list(self._fs.globStatus(self._path(pattern)) or [])

    def _first(self, kind: str, key: str) -> str | None:
        """The name of the write that was complete first."""
        done = [(s.getModificationTime(), s.getPath().getParent().getName()) for s in self._listed(self._at(kind, key) + "/*/_SUCCESS")]
        return min(done)[1] if done else None

    def get(self, kind: str, key: str) -> DataFrame | None:
        """The result, if all of it is there."""
        first = self._first(kind, key)
        (self.hits if first else self.misses).append(kind)
        return self.spark.read.parquet(f"{self._at(kind, key)}/{first}") if first else None

    def put(self, kind: str, key: str, df: DataFrame) -> DataFrame:
        mine = uuid.uuid4().hex
        df.write.parquet(f"{self._at(kind, key)}/{mine}")
        first = self._first(kind, key)
        if first != mine:
            self._fs.delete(self._path(f"{self._at(kind, key)}/{mine}"), True)
        return self.spark.read.parquet(f"{self._at(kind, key)}/{first}")

    def _newest(self, path) -> int:
        """When anything in a folder was last written: a writer at work keeps its folder young."""
        newest, files = self._fs.getFileStatus(path).getModificationTime(), self._fs.listFiles(path, True)
        while files.hasNext():
            newest = max(newest, files.next().getModificationTime())
        return newest

    def sweep(self, age_s: float = 86400.0) -> int:
        """Removes writes in which nothing has happened for an age and that aren't results: those never completed,
        and those that came second but whose writers were killed before they removed them; returns how many."""
        n, first = 0, {}
        for write in self._listed(f"{self.root}/*/*/*"):
            path = write.getPath()
            kind, key = path.getParent().getParent().getName(), path.getParent().getName()
            if (kind, key) not in first:
                first[kind, key] = self._first(kind, key)
            if path.getName() != first[kind, key] and time.time() - self._newest(path) / 1000 > age_s:
                self._fs.delete(path, True)
                n += 1
        return n

    def size_bytes(self) -> int:
        return self._fs.getContentSummary(self._path(self.root)).getLength() if self._fs.exists(self._path(self.root)) else 0

    def clear(self) -> int:
        n = self.size_bytes()
        self._fs.delete(self._path(self.root), True)
        return n

    def summary(self) -> dict:
        return {"root": self.root, "hits": sorted(set(self.hits)), "misses": sorted(set(self.misses)), "bytes": self.size_bytes()}


class Results:
    """Results of stages by song, under root/kind: what is known is read, and only the rest is computed.

    Each write has a folder of its own, with the rows of its songs and, written after them, their keys; a song is
    known once its key is there, also one without rows. Writers that compute the same song at the same
    time do no harm: the write that was complete first is the one that is read. Nothing comes to the
    driver but the folders' names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _writes(self, kind: str) -> list[str]:
        """Folders of complete writes, the first to be complete first."""
        done = self._fs.globStatus(self._path(f"{self.root}/{kind}/*/keys/_SUCCESS")) or []
        return [x[1] for x in sorted((s.getModificationTime(), s.getPath().getParent().getParent().toString()) for s in done)]

    def keys(self, kind: str) -> DataFrame:
        """(key, write): the write that each known key is read from."""
        writes = self._writes(kind)
        if not writes:
            return self.spark.createDataFrame([], "key string, write int")
        parts = [self.spark.read.schema("key string").parquet(f"{w}/keys").withColumn("write", F.lit(k)) for k, w in enumerate(writes)]
        while len(parts) > 1:  # pairwise, so that the plan stays shallow
            parts = [a.unionByName(b[0]) if b else a for a, *b in (parts[k : k + 2] for k in range(0, len(parts), 2))]
        return parts[0].groupBy("key").agg(F.min("write").alias("write"))

    def of(self, kind: str, songs: DataFrame, compute) -> DataFrame:
        """Rows of ``songs`` (song_id, key). ``compute`` takes (song_id, key) of those that aren't known and gives
        rows with their song_id; it isn't called where all are known. Songs of one key are computed once."""
        songs = songs.select("song_id", "key").distinct()
        missing = songs.join(self.keys(kind), "key", "left_anti").groupBy("key").agg(F.min("song_id").alias("song_id"))
        if not missing.isEmpty():
            write = f"{self.root}/{kind}/{uuid.uuid4().hex}"
            # The choice is written first: what is computed and what is noted are the same songs.
            missing.write.parquet(f"{write}/asked")
            missing = self.spark.read.schema(missing.schema).parquet(f"{write}/asked")
            compute(missing).join(missing, "song_id").withColumnRenamed("key", "_key").drop("song_id").write.parquet(f"{write}/rows")
            missing.select("key").distinct().write.parquet(f"{write}/keys")
        known, parts = self.keys(kind), []
        for k, w in enumerate(self._writes(kind)):
            parts.append(self.spark.read.parquet(f"{w}/rows").withColumn("_write", F.lit(k)))
        while len(parts) > 1:
            parts = [a.unionByName(b[0], allowMissingColumns=True) if b else a for a, *b in (parts[k : k + 2] for k in range(0, len(parts), 2))]
        asked = songs.join(known, "key")
        return asked.join(parts[0], F.expr("key = _key AND write = _write")).drop("key", "write", "_key", "_write")

    def compact(self, kind: str) -> None:
        """All writes as one, so that reading needs few folders; for when nothing else writes."""
        writes = self._writes(kind)
        if len(writes) > 1:
            new = f"{self.root}/{kind}/{uuid.uuid4().hex}"
            known = self.keys(kind)
            rows = None
            for k, w in enumerate(writes):
                part = self.spark.read.parquet(f"{w}/rows").join(known.where(F.col("write") == k).select(F.col("key").alias("_key")), "_key", "left_semi")
                rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
            rows.write.parquet(f"{new}/rows")
            known.select("key").write.parquet(f"{new}/keys")
            for w in writes:
                self._fs.delete(self._path(w), True)


def summary(entries: DataFrame) -> DataFrame:
    """Of a table of entries(kind, key, bytes, hit): bytes, and the kinds that were hit and missed."""
    kinds = lambda hit: F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit") == hit, F.col("kind")))), ",")
    return entries.agg(F.sum("bytes").alias("bytes"), kinds(True).alias("hits"), kinds(False).alias("misses"))


def stale(entries: DataFrame, now: float, age_s: float = 86400.0) -> DataFrame:
    """Unfinished entries older than an age. entries(name, modified_s)."""
    return entries.where(F.col("name").startswith(".tmp-") & (F.lit(now) - F.col("modified_s") > age_s))
