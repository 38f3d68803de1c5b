"""Stock-month source: returns with names by date range, delistings by month, market equity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalar

# Fixed value: share codes of common stock.
COMMON = (10, 11)


def stock_months(monthly: DataFrame, names: DataFrame, delistings: DataFrame, start: str, end: str) -> DataFrame:
    """Common stocks' months from start to end. names join on permno with the date inside the name's range;
    delistings join on permno and month. ret carries the delisting's loss; me is market equity."""
    m = monthly.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    n = names.where(F.col("shrcd").isin(*COMMON)).select("permno", "namedt", "nameendt", "shrcd", "exchcd", "siccd")
    df = m.join(n, "permno").where(F.col("date").between(F.col("namedt"), F.col("nameendt"))).drop("namedt", "nameendt")
    d = delistings.select("permno", F.trunc("dlstdt", "MM").alias("__month"), "dlret", "dlstcd")
    df = df.withColumn("__month", F.trunc("date", "MM")).join(d, ["permno", "__month"], "left").drop("__month")
    ret = scalar.delisting_return(scalar.clean(F.col("ret")), scalar.clean(F.col("dlret")), F.col("dlstcd"))
    df = df.withColumns({"ret": ret, "me": scalar.market_equity(scalar.clean(F.col("prc")), scalar.clean(F.col("shrout")))}).drop("dlret", "dlstcd")
    return df.withColumns({"month": F.month("date"), "year": F.year("date")})


def to_panel(rows: DataFrame) -> DataFrame:
    """The long panel of the operators: a row for each stock and month, the first by date of those that have several."""
    df = rows.withColumn("month_idx", scalar.month_index(F.col("date")))
    order = F.struct("date")
    firsts = {c: F.min_by(c, order).alias(c) for c in ("ret", "me", "siccd", "exchcd") if c in rows.columns}
    out = df.groupBy("permno", "month_idx").agg(F.last_day(F.min("date")).alias("month_end"), *firsts.values())
    out = out.withColumn("nyse", scalar.is_nyse(F.col("exchcd"))) if "exchcd" in firsts else out
    return out.withColumn("form_year", scalar.formation_year(F.col("month_end")))
