"""Factor tables by month, in decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIVE = ("Mkt-RF", "SMB", "HML", "RMW", "CMA")
Q_FACTORS = {"R_F": "R_F", "R_MKT": "R_MKT", "R_ME": "R_ME", "R_IA": "R_IA", "R_ROE": "R_ROE"}


def _percent(name: str):
    return (F.col(f"`{name}`").cast("double") / 100).alias(name)


def five_and_momentum(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """(month_idx, month_end, Mkt-RF, SMB, HML, RMW, CMA, Mom, RF) from two tables in percent keyed by yyyymm."""
    both = five.join(momentum.select("yyyymm", "Mom"), "yyyymm")
    end = F.last_day(F.to_date(F.col("yyyymm").cast("string"), "yyyyMM"))
    idx = (F.floor(F.col("yyyymm") / 100) * 12 + F.col("yyyymm") % 100).cast("int")
    return both.select(idx.alias("month_idx"), end.alias("month_end"), *[_percent(c) for c in (*FIVE, "Mom", "RF")])


def q_factors(spark: SparkSession, path: str) -> DataFrame:
    """(month_idx, month_end, R_F, R_MKT, R_ME, R_IA, R_ROE) from a CSV in percent with year and month."""
    schema = "year int, month int, R_F double, R_MKT double, R_ME double, R_IA double, R_ROE double, R_EG double"
    df = spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)
    return df.select((F.col("year") * 12 + F.col("month")).alias("month_idx"), F.last_day(F.make_date("year", "month", F.lit(1))).alias("month_end"), *[_percent(c) for c in Q_FACTORS])
