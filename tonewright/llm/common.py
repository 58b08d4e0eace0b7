"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of an Arrow batch, where the session keeps Spark's default: long texts make rows large.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Where the session keeps Spark's default of rows in an Arrow batch, it is
    set to BATCH_ROWS for the session: it can't be set for one query."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); where none is set and
    driver and executors are one process, as in tests, a temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="tonewright-")
        context.setCheckpointDir(found)
        found = context.getCheckpointDir()
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tonewright-{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    atexit.register(remove)
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def unsettle(df: DataFrame) -> None:
    """Remove the files behind a settled table that nothing reads any more."""
    drop(df.sparkSession, df._settled_at)


def sweep(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of steps that are settled. It does so when the driver's memory is
    collected; a driver with room to spare may not come to that before the job ends."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def hash_sample(df: DataFrame, n: int, total: int, *columns: str) -> DataFrame:
    """About n of ``total`` rows, those whose hash lies lowest; never more than 2 n. What a task
    sends on is its share of the sample, so this stays bounded however many tasks there are."""
    if total > n:
        df = df.where(F.xxhash64(*columns) < int(-(1 << 63) + (1 << 64) * n // total))
    return df.limit(2 * n)


def within(rows: DataFrame, key: str, size: str, most: int, *parts: str) -> DataFrame:
    """One row of each key of a settled table whose number of keys is bounded: those of least hash of the
    key that together have at most ``most`` of the column ``size``, in each of the parts. Of rows with one
    key that of least hash is taken; keys with more than ``most`` by themselves are left out."""
    h = F.xxhash64(*rows.columns)
    one = rows.groupBy(key).agg(F.min(F.struct(h.alias("h"), F.col(size).alias("n"), *parts)).alias("m"))
    order = Window.partitionBy(*(f"m.{c}" for c in parts)).orderBy(F.xxhash64(key), key)
    chosen = one.where(F.col("m.n") <= most).withColumn("_total", F.sum("m.n").over(order)).where(F.col("_total") <= most).select(key, F.col("m.h").alias("_h"))
    return rows.withColumn("_h", h).join(F.broadcast(chosen), [key, "_h"], "left_semi").dropDuplicates([key]).drop("_h")


SIEVE_BITS = 1 << 23


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashes of a long column: at most 256 rows of 4 KB, whatever the table's size."""
    slot = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    return keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def sift(df: DataFrame, key: str, held: DataFrame, flag: str) -> DataFrame:
    """Adds ``flag``: whether the sieve may hold the row's key. False is certain, so rows that need no
    join can pass by it without a shuffle. Broadcasts the sieve, of at most 1 MB."""
    slot = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    place = F.bitmap_bit_position(slot)
    bits = held.select(F.col("bucket").alias(flag + "_b"), F.col("bits").alias(flag + "_s"))
    byte = F.conv(F.hex(F.substring(F.col(flag + "_s"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col(flag + "_b"), "left")
    return found.withColumn(flag, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(flag + "_b", flag + "_s")


def unused(df: DataFrame) -> str:
    """A prefix that no column's name begins with."""
    own = "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    return own


def tidy(f):
    """For functions of ``mapInArrow``: a worker lives on after its task, so what the task freed goes
    back to the system rather than waiting in the allocators for the next one."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run
