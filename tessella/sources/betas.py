"""Store of monthly betas with a description that says what they were made of."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(value) -> str:
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def save(betas: DataFrame, folder: str, spec) -> None:
    """betas (signal_id, month_idx, beta) and a one-row description: hash of the spec, months and signals."""
    betas.select("signal_id", "month_idx", "beta").write.mode("overwrite").parquet(f"{folder}/betas")
    shape = betas.agg(F.countDistinct("signal_id").alias("signals"), F.countDistinct("month_idx").alias("months"), F.min("month_idx").alias("first"), F.max("month_idx").alias("last"))
    shape.select(F.lit(VERSION).alias("version"), F.lit(fingerprint(spec)).alias("spec_hash"), "*").coalesce(1).write.mode("overwrite").json(f"{folder}/description")


def load(spark: SparkSession, folder: str, spec) -> DataFrame:
    """The stored betas; ValueError if they were made of something else, or don't have the described shape."""
    told = spark.read.schema("version int, spec_hash string, signals long, months long, first int, last int").json(f"{folder}/description").first()
    if told is None or told.version != VERSION or told.spec_hash != fingerprint(spec):
        raise ValueError("stored betas were made of another specification")
    betas = spark.read.schema("signal_id string, month_idx int, beta double").parquet(f"{folder}/betas")
    got = betas.agg(F.countDistinct("signal_id"), F.countDistinct("month_idx"), F.min("month_idx"), F.max("month_idx")).first()
    if tuple(got) != tuple(told)[2:]:
        raise ValueError("stored betas don't have the described shape")
    return betas


def load_or_build(spark: SparkSession, folder: str, spec, build) -> DataFrame:
    try:
        return load(spark, folder, spec)
    except Exception:  # absent or of another making: build anew
        save(build(), folder, spec)
        return load(spark, folder, spec)
