"""Following the append-only progress logs of running searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS = "schema_version string, elapsed_sec double, run_name string, pair string, generation long, stage string, event string, message string"


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events from JSON-line files as they appear under folder."""
    return spark.readStream.schema(PROGRESS).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(folder)


def latest(events: DataFrame) -> DataFrame:
    """(pair, generation, stage, event): each pair's last event so far; the state is one row a pair."""
    last = F.max_by(F.struct("generation", "stage", "event"), "elapsed_sec")
    return events.groupBy("pair").agg(last.alias("l")).select("pair", "l.*")
