"""Panel store: named parquet tables under one folder, read or built."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.tessella.panels"


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see: under spark.checkpoint.dir, else (in a local run only) a
    temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="tessella-")
        _own[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_folder(spark: SparkSession, path: str) -> None:
    spark.conf.set(FOLDER, path.rstrip("/"))


def path_of(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get(FOLDER, 'panels')}/{name}.parquet"


def exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path_of(spark, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def save(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").parquet(path_of(df.sparkSession, name))


def load(spark: SparkSession, name: str) -> DataFrame:
    if not exists(spark, name):
        raise FileNotFoundError(f"no panel {name} at {path_of(spark, name)}")
    return spark.read.parquet(path_of(spark, name))


def load_or_build(spark: SparkSession, name: str, build: Callable[..., DataFrame], **options) -> DataFrame:
    if not exists(spark, name):
        save(build(**options), name)
    return load(spark, name)


def query(spark: SparkSession, sql: str, url: str, **options: str) -> DataFrame:
    """A JDBC scan; credentials come as options (user, password) and are not kept."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


#: Column types of embedded tables by Spark's.
EMBEDDED = {"int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP", "string": "CLOB"}


def embedded(df: DataFrame, table: str) -> str:
    """URL of a database, by the engine that Spark ships, with df as a table. That engine's databases belong to one
    process while they can be written; so the driver fills and closes it, from files that the executors wrote, and packs
    it into an archive in the shared folder, which any number of processes read at a time."""
    spark = df.sparkSession
    files, archive = scratch(spark, "rows"), scratch(spark, "database").removeprefix("file://") + ".jar"
    if not archive.startswith("/"):
        raise ValueError("an embedded database needs a spark.checkpoint.dir that is mounted as a folder (file://)")
    df.write.option("escape", '"').csv(files)
    files, folder, drivers = files.removeprefix("file://"), tempfile.mkdtemp(prefix="tessella-"), spark._jvm.java.sql.DriverManager
    try:
        connection = drivers.getConnection(f"jdbc:derby:{folder}/db;create=true", "APP", "APP")
        try:
            columns = ", ".join(f'"{n}" {EMBEDDED[kind]}' for n, kind in df.dtypes)
            connection.createStatement().execute(f"CREATE TABLE {table} ({columns})")
            for part in sorted(f for f in os.listdir(files) if f.startswith("part-")):
                connection.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{files}/{part}', ',', '\"', 'UTF-8', 0)")
        finally:
            connection.close()
            try:
                drivers.getConnection(f"jdbc:derby:{folder}/db;shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # the state that tells a shutdown
                    raise
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(f"{folder}/db"):
                for n in names:
                    z.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", folder))
    finally:
        shutil.rmtree(folder)
    return f"jdbc:derby:jar:({archive})db"


class Connection:
    """A source behind a URL, opened with credentials of the caller's and closed by leaving its block: scans after that
    are refused. Executors open and close their own connections for each scan."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.options = None

    def query(self, sql: str) -> DataFrame:
        if self.options is None:
            raise ValueError("the connection is closed")
        return query(self.spark, sql, self.url, **self.options)
