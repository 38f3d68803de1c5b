"""Panels in long form: (month_idx, permno, value). NULL is missing; an absent row is absent.

`month_idx` is year * 12 + month; windows over it use RANGE frames, so a lag is a calendar lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import average_rank, is_financial, percentile_rank

FIRST_MONTH = 1963 * 12 + 7


def to_months(months: DataFrame, firm_year: DataFrame, columns: list[str]) -> DataFrame:
    """Each stock-month (permno, form_year) with its firm-year's columns; NULL where there is none."""
    return months.join(firm_year.select("permno", "form_year", *columns), ["permno", "form_year"], "left")


def calendar(panel: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """(month_idx): every month between the panel's first and last, or the given bounds where tighter."""
    bounds = panel.agg(F.greatest(F.min("month_idx"), F.lit(first)).alias("a"), F.least(F.max("month_idx"), F.lit(last)).alias("b"))
    return bounds.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("month_idx"))


def month_end_of(month_idx: Column) -> Column:
    return F.last_day(F.make_date(F.floor((month_idx - 1) / 12).cast("int"), ((month_idx - 1) % 12 + 1).cast("int"), F.lit(1)))


def fill_months(panel: DataFrame, value: str, persist: int = 12) -> DataFrame:
    """The panel on every month of each stock's span and up to `persist` later: a missing value takes the
    last one of the `persist` calendar months before. Stocks are densified by themselves; the span is
    held to the panel's last month."""
    end = panel.agg(F.max("month_idx").alias("last_month"))
    spans = panel.groupBy("permno").agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))
    spans = spans.withColumn("last_month", end.scalar())
    dense = spans.select("permno", F.explode(F.sequence("a", F.least(F.col("b") + persist, F.col("last_month")))).alias("month_idx"))
    w = Window.partitionBy("permno").orderBy("month_idx").rowsBetween(-persist, 0)
    filled = dense.join(panel.select("permno", "month_idx", value), ["permno", "month_idx"], "left")
    return filled.withColumn(value, F.last(value, ignorenulls=True).over(w))


def cross_rank(panel: DataFrame, value: str, centred: bool = True) -> DataFrame:
    """value replaced by its average-tie percentile rank in the month, less 0.5."""
    rank = percentile_rank(F.col(value), Window.partitionBy("month_idx"))
    return panel.withColumn(value, rank - 0.5 if centred else rank)


def row_rank(panel: DataFrame, value: str) -> DataFrame:
    """value replaced by its average rank in the month; NULL in months of fewer than two values."""
    month = Window.partitionBy("month_idx")
    return panel.withColumn(value, F.when(F.count(value).over(month) >= 2, average_rank(F.col(value), month)))


def fill_var(panel: DataFrame, value: str, me: str = "me") -> DataFrame:
    """Centred rank over all stocks with a signal; 0 where only market equity is there; NULL without it."""
    ranked = cross_rank(panel, value)
    return ranked.withColumn(value, F.when(F.col(me).isNotNull(), F.coalesce(value, F.lit(0.0))))


def monthly_sample(stock_month: DataFrame, first: int | None = FIRST_MONTH, last: int | None = None) -> DataFrame:
    """(month_idx, permno, ret, me, nyse, siccd) in the common range of months with returns and with market
    equity, of stocks that have both somewhere. nyse is FALSE where unknown."""
    has = stock_month.agg(
        *[f(F.when(F.col(c).isNotNull(), F.col("month_idx"))).alias(f"{n}_{c}") for c in ("ret", "me") for n, f in (("a", F.min), ("b", F.max))]
    ).select(F.greatest("a_ret", "a_me", F.lit(first)).alias("lo"), F.least("b_ret", "b_me", F.lit(last)).alias("hi"))
    both = stock_month.groupBy("permno").agg(F.count("ret").alias("r"), F.count("me").alias("m")).where("r > 0 AND m > 0").select("permno")
    bounds = stock_month.withColumns({"lo": has.select("lo").scalar(), "hi": has.select("hi").scalar()})
    kept = bounds.where(F.col("month_idx").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    return kept.join(both, "permno", "left_semi").withColumn("nyse", F.coalesce("nyse", F.lit(False)))


def coverage(sample: DataFrame, signal: str) -> DataFrame:
    """One row: share of the dense months x stocks grid that has the signal."""
    grid = (F.max("month_idx") - F.min("month_idx") + 1) * F.countDistinct("permno")
    return sample.agg((F.count(signal) / grid).alias("coverage"))


def microcap(sample: DataFrame, share: float = 0.1) -> DataFrame:
    """(month_idx, cutoff): the quantile of NYSE market equity that a stock must exceed."""
    return sample.groupBy("month_idx").agg(F.percentile(F.when(F.col("nyse"), F.col("me")), share).alias("cutoff"))


def prepare_signal(sample: DataFrame, signal: str, financials: bool = False, microcaps: bool = False) -> DataFrame:
    """The ranked signal of the eligible, in this order: rank all and fill 0 where market equity is there;
    blank months without any raw signal; blank financial firms; blank microcaps (all, in a month without NYSE stocks)."""
    month = Window.partitionBy("month_idx")
    df = sample.withColumn("__any", F.count(signal).over(month) > 0)
    df = fill_var(df, signal)
    keep = F.col("__any")
    if not financials:
        keep = keep & ~is_financial(F.col("siccd"))
    if not microcaps:
        df = df.join(microcap(sample), "month_idx", "left")
        keep = keep & F.coalesce(F.col("me") > F.col("cutoff"), F.lit(False))
    return df.withColumn(signal, F.when(keep, F.col(signal))).drop("__any", "cutoff")


def require_unique(panel: DataFrame, keys: list[str]) -> None:
    """ValueError if a key is repeated: two rows are looked at, not all."""
    twice = panel.groupBy(*keys).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"labels must be unique; repeated: {[twice[0][k] for k in keys]}")


def require_contiguous(panel: DataFrame) -> None:
    """ValueError if a month is missing between the first and the last."""
    r = panel.agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"), F.countDistinct("month_idx").alias("n")).first()
    if r.n and r.b - r.a + 1 != r.n:
        raise ValueError(f"months must be contiguous: {r.n} of {r.b - r.a + 1} are there")


#: Ranges that a column is dealt into when it is ranked as a whole.
RANGES = 64


def pooled_ranks(values: DataFrame, column: str, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """(column, out): average-tie rank of each distinct value of a numeric column among all rows. Values are counted,
    dealt into ranges at approximate quantiles, summed up within each, and moved on by the sums of the ranges before."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    points = counts.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cut = F.array(*map(F.lit, sorted(set(points)))) if points else F.array().cast("array<double>")
    counts = counts.withColumn("__range", F.size(F.filter(cut, lambda b: b <= F.col(column))))
    # One row a range.
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.groupBy("__range").agg(F.sum("__n").alias("__s")).select("__range", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy("__range").orderBy(column)) + F.col("__before")
    return counts.join(F.broadcast(offset), "__range").select(column, (upto - (F.col("__n") - 1) / 2.0).alias(out))


def correlations(panel: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """One row: pooled Pearson and Spearman correlation of two columns over rows that have both."""
    pairs = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    both = pairs.join(pooled_ranks(pairs, "a", "ra"), "a").join(pooled_ranks(pairs, "b", "rb"), "b")
    enough = F.count("*") >= least
    return both.agg(F.when(enough, F.corr("a", "b")).alias("pearson"), F.when(enough, F.corr("ra", "rb")).alias("spearman"), F.count("*").alias("n"))


def rolling(panel: DataFrame, aggregate: Column, out: str, window: int, key: str = "permno") -> DataFrame:
    """aggregate over the last `window` rows of each stock; shorter at its start."""
    return panel.withColumn(out, aggregate.over(Window.partitionBy(key).orderBy("month_idx").rowsBetween(1 - window, 0)))


def expanding(panel: DataFrame, aggregate: Column, out: str, min_periods: int = 1, key: str = "permno") -> DataFrame:
    """aggregate over all rows of each stock so far; NULL before min_periods rows."""
    w = Window.partitionBy(key).orderBy("month_idx").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, F.when(F.count("*").over(w) >= min_periods, aggregate.over(w)))


#: Plotting positions by method: (shift of the rank, shift of the count).
POSITIONS = {"weibull": (0.0, 1.0), "hazen": (-0.5, 0.0), "blom": (-0.375, 0.25)}


def inverse_percentile(sample: DataFrame, queries: DataFrame, value: str, out: str = "percentile", key: str = "month_idx", method: str = "weibull") -> DataFrame:
    """queries (key, value, ...) with `out`: the share, 0 to 100, of the key's sample (key, value) that lies below,
    interpolated between plotting positions; 0 below the least, 100 above the greatest, NULL without a sample."""
    rank, count = POSITIONS[method]
    by = Window.partitionBy(key)
    s = sample.where(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"))
    s = s.select(key, "__v", F.row_number().over(by.orderBy("__v")).alias("__k"), (F.count("*").over(by) + count).alias("__n"), F.lit(0).alias("__kind"))
    both = queries.withColumns({"__v": F.col(value), "__kind": F.lit(1)}).unionByName(s, allowMissingColumns=True)
    point = F.when(F.col("__kind") == 0, F.struct("__v", "__k", "__n"))
    # The next point above is the last one passed when the order is turned round: frames to the end cost their square.
    # Of equal values the last one counts below and the first one above, so their places are told apart by rank.
    up, down = by.orderBy(F.col("__v").asc_nulls_first(), "__kind", "__k"), by.orderBy(F.col("__v").desc_nulls_last(), F.desc("__kind"), F.desc("__k"))
    passed = lambda order: F.last(point, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__lo": passed(up), "__hi": passed(down)}).where("__kind = 1")
    x, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    place = lambda part: (lo["__k"] + rank + part) / lo["__n"] * 100
    between = place((x - lo["__v"]) / (hi["__v"] - lo["__v"]))
    found = F.when(lo.isNull() & hi.isNull() | x.isNull(), None).when(lo.isNull(), 0.0).when(x == lo["__v"], place(F.lit(0.0))).when(hi.isNull(), 100.0).otherwise(between)
    return both.withColumn(out, found).select(*queries.columns, out)
