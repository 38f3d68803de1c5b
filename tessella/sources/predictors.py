"""Wide predictor tables (permno, yyyymm, one column a signal) and their long panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources import store

KEYS = ("permno", "yyyymm", "date")


def unzipped_csv(spark: SparkSession, archive: str, folder: str | None = None) -> str:
    """Path of the first CSV in an archive, unpacked to folder, which all executors see. Both lie in any file system
    that Spark reads; bytes are streamed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = folder or store.scratch(spark, "unzipped")
    path = jvm.org.apache.hadoop.fs.Path(archive)
    stream = jvm.java.util.zip.ZipInputStream(path.getFileSystem(conf).open(path))
    try:
        while (entry := stream.getNextEntry()) is not None:
            if entry.getName().lower().endswith(".csv"):
                target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{entry.getName().rpartition('/')[2]}")
                out = target.getFileSystem(conf).create(target, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
                out.close()
                return target.toString()
    finally:
        stream.close()
    raise ValueError(f"no CSV in {archive}")


def read_wide(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A wide table from CSV or zipped CSV; blanks around column names go, all signals are doubles."""
    path = unzipped_csv(spark, path, folder) if path.lower().endswith(".zip") else path
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[F.col(f"`{c}`").cast("long" if c == "permno" else "int" if c == "yyyymm" else "double").alias(c) for c in df.columns])


def signal_names(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in KEYS]


def to_panels(wide: DataFrame, names: list[str] | None = None, order: str | None = None) -> DataFrame:
    """(name, month_idx, permno, value) of every present value. Where a stock and month have several rows, each
    signal takes its first present value in the order of column `order`."""
    names = names or [c for c in signal_names(wide) if c != order]
    idx = (F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100).cast("int").alias("month_idx")
    place = F.col(order) if order else F.monotonically_increasing_id()
    long = wide.select("permno", idx, place.alias("__order"), *[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    long = long.unpivot(["permno", "month_idx", "__order"], names, "name", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("name", "month_idx", "permno").agg(F.min_by("value", "__order").alias("value"))


def to_panel(wide: DataFrame, name: str, order: str | None = None) -> DataFrame:
    return to_panels(wide, [name], order).drop("name")


def signal_doc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def present_first(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row a key: each column's first non-missing value in order (windows; for tables that stay wide)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*keys, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in columns]).distinct()
