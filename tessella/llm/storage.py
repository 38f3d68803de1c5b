"""Shared work folders: everything a later job reads again lies where all executors see it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shipping import ship

#: Rows and bytes of one Arrow batch handed to a Python kernel; bounds a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a folder of our own in a local run, which is one machine;
    an error on a cluster, whose executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own_root[app]


def work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: lineage ends here, lost executors
    cost only the task that ran, and no kernel above runs twice."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_folder = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that `cut` gave, once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._work_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim_memory() -> None:
    """Give a worker's freed memory back to the system, where its library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another system's library
        pass


def small_batches(spark: SparkSession) -> None:
    """What every Python kernel asks of a session: bounded batches, and this package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Most bits of a filter (16 MB): it has BITS_A_KEY a key up to that. Three bits are set a key.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16


def filter_bits(keys: DataFrame, most: int = FILTER_BITS, a_key: int = BITS_A_KEY) -> int:
    """Bits of a filter of keys (a table that is read, not worked out again): a power of two, 2^16 to most."""
    return min(most, 1 << max(16, (keys.count() * a_key - 1).bit_length()))


class KeyFilter:
    """Bloom filter of the 64-bit hashes in a column, sized by their number: tells most other rows before they move.

    It is gathered word by word, at most FILTER_BITS / 32 rows in all. Beyond some eight million keys it is
    fuller and lets more rows pass; what passes is joined exactly afterwards, so no result depends on it.
    """

    SHIFTS = (0, 18, 36)

    def __init__(self, hashes: DataFrame, column: str, bits: int | None = None):
        self.bits = bits = bits or filter_bits(hashes)
        at = F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in self.SHIFTS])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int"))
        words = hashes.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 5).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
        self.words = np.zeros(bits // 32, np.uint32)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)

    def may_hold(self, hashed: int) -> bool:
        hashed &= (1 << 64) - 1
        return all(int(self.words[(at := hashed >> s & self.bits - 1) >> 5]) >> (at & 31) & 1 for s in self.SHIFTS)

    def may_hold_each(self, hashed: np.ndarray) -> np.ndarray:
        """Whether each of an array of unsigned hashes may be held."""
        if not hasattr(self, "_bit"):  # one byte a bit, made where it is used
            self._bit = np.unpackbits(self.words.view(np.uint8), bitorder="little").view(bool)
        out = self._bit[hashed & np.uint64(self.bits - 1)]
        i = np.flatnonzero(out)
        for s in self.SHIFTS[1:]:
            i = i[self._bit[hashed[i] >> np.uint64(s) & np.uint64(self.bits - 1)]]
        out[:] = False
        out[i] = True
        return out


def filter_row(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """One row (words): the same kind of filter as an array for built-in functions."""
    at = F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(bits - 1)) for s in KeyFilter.SHIFTS])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(F.explode(at).alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(bit).alias("b"))
    got = words.toArrow()  # at most bits / 64 rows
    dense = np.zeros(bits // 64, np.int64)
    dense[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return cut(keys.sparkSession.createDataFrame(pa.table({"words": pa.array([dense], pa.list_(pa.int64()))})), "filter")


def dense_row(words: DataFrame, n: int) -> DataFrame:
    """One row (words): the values b of words (w, b) in order of w from 0 to n - 1, 0 where there is none."""
    every = words.sparkSession.range(n).select(F.col("id").cast("int").alias("w")).join(words, "w", "left")
    pairs = F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    return every.agg(F.transform(pairs, lambda x: x["b"]).alias("words"))


def may_hold(words: Column, hashed: Column, bits: int) -> Column:
    out = F.lit(True)
    for s in KeyFilter.SHIFTS:
        at = F.shiftrightunsigned(hashed, s).bitwiseAND(F.lit(bits - 1))
        out = out & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return out


class Told:
    """Built-in filter over the 64-bit hashes of a column: of(hash) is false only for hashes that it doesn't hold.
    hashes is a table that is read, not worked out again."""

    def __init__(self, hashes: DataFrame, column: str):
        self.bits = filter_bits(hashes)
        self.words = filter_row(hashes, column, self.bits)

    def of(self, hashed: Column) -> Column:
        return may_hold(self.words.scalar(), hashed, self.bits)
