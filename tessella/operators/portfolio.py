"""Portfolio sorts on long panels (month_idx, permno, ...): breakpoints, assignments, returns.

Breakpoints are a small aggregate by month (partial sums first), joined back to the stocks; lags are
calendar windows by stock; portfolio returns are sums by (month, label) over a full grid of labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least stocks of a month that is sorted, and least that set its breakpoints.
LEAST_VALID, LEAST_POINTS = 5, 3


def _shares(n: int | list[float]) -> Column:
    """Quantiles of n equal groups, or the given percentiles."""
    points = [i / n for i in range(1, n)] if isinstance(n, int) else [p / 100 for p in n]
    return F.array(*map(F.lit, points))


def breakpoints(panel: DataFrame, value: str, n: int | list[float] = 5, only: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month_idx, points): quantiles of value, over stocks flagged by `only` where given. keys (say, signal_id)
    tell panels of several signals apart, here and below."""
    x = F.col(value)
    base = F.when(F.coalesce(F.col(only), F.lit(False)), x) if only else x
    out = panel.groupBy(*keys, "month_idx").agg(F.count(x).alias("valid"), F.count(base).alias("base"), F.percentile(base, _shares(n)).alias("points"))
    return out.where((F.col("valid") >= LEAST_VALID) & (F.col("base") >= LEAST_POINTS)).select(*keys, "month_idx", "points")


def cap_weighted_breakpoints(panel: DataFrame, value: str, n: int = 5, me: str = "me", only: str | None = None) -> DataFrame:
    """(month_idx, points): values at which running market equity first reaches i / n of the month's total."""
    x = F.col(value)
    month = Window.partitionBy("month_idx")
    base = panel.withColumn("__valid", F.count(x).over(month)).where(x.isNotNull() & (F.col("__valid") >= LEAST_VALID))
    if only:
        base = base.where(F.coalesce(F.col(only), F.lit(False)))
    base = base.where(F.col(me) > 0)
    run = F.sum(me).over(month.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = base.select("month_idx", x.alias("x"), run.alias("run"), F.sum(me).over(month).alias("total"), F.count("*").over(month).alias("n")).where(F.col("n") >= LEAST_POINTS)
    # The least value is taken among those that reach the target; ties in x reach it together.
    points = [F.min(F.when(F.col("run") >= F.col("total") * i / n, F.col("x"))) for i in range(1, n)]
    return run.groupBy("month_idx").agg(F.array(*[F.coalesce(p, F.max("x")) for p in points]).alias("points"))


def bucket(value: Column, points: Column) -> Column:
    """1 + number of points no larger than value; NULL for a missing value or month."""
    return F.when(value.isNotNull() & points.isNotNull(), F.size(F.filter(points, lambda b: b <= value)) + 1)


def sort_panel(panel: DataFrame, value: str, points: DataFrame, label: str = "ptf", keys: tuple[str, ...] = ()) -> DataFrame:
    return panel.join(points, [*keys, "month_idx"], "left").withColumn(label, bucket(F.col(value), F.col("points"))).drop("points")


def univariate_sort(panel: DataFrame, value: str, n: int | list[float] = 5, only: str | None = None, label: str = "ptf", cap_weighted: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    if cap_weighted and keys:
        raise ValueError("cap-weighted breakpoints are those of one signal")
    points = cap_weighted_breakpoints(panel, value, n, only=only) if cap_weighted else breakpoints(panel, value, n, only, keys)
    return sort_panel(panel, value, points, label, keys)


def bivariate_sort(panel: DataFrame, first: str, second: str, n1: int = 5, n2: int = 5, only: str | None = None, conditional: bool = False, label: str = "ptf") -> DataFrame:
    """Label (i - 1) n2 + j. Conditional: the second sort within each bucket of the first, of at least three stocks."""
    df = univariate_sort(panel, first, n1, only, "__i")
    if not conditional:
        df = univariate_sort(df, second, n2, only, "__j")
    else:
        y = F.col(second)
        base = F.when(F.coalesce(F.col(only), F.lit(False)), y) if only else y
        points = df.where(F.col("__i").isNotNull()).groupBy("month_idx", "__i").agg(F.count("*").alias("members"), F.count(base).alias("base"), F.percentile(base, _shares(n2)).alias("points"))
        points = points.where((F.col("members") >= LEAST_POINTS) & (F.col("base") >= LEAST_POINTS)).select("month_idx", "__i", "points")
        df = df.join(points, ["month_idx", "__i"], "left").withColumn("__j", bucket(y, F.col("points"))).drop("points")
    return df.withColumn(label, (F.col("__i") - 1) * n2 + F.col("__j")).drop("__i", "__j")


def lagged(column: str, months: int = 1, keys: tuple[str, ...] = ()) -> Column:
    """The stock's value exactly `months` calendar months before."""
    return F.first(column).over(Window.partitionBy(*keys, "permno").orderBy("month_idx").rangeBetween(-months, -months))


def held_labels(panel: DataFrame, label: str, holding: int) -> DataFrame:
    """(month_idx, permno, held): labels of the month before, renewed every `holding` months from the first
    month that has any, carried between; a stock that a renewal leaves out keeps its label."""
    given = panel.where(F.col(label).isNotNull()).select("permno", (F.col("month_idx") + 1).alias("month_idx"), F.col(label).alias("given"))
    if holding > 1:
        first = given.agg(F.min("month_idx").alias("first"))
        given = given.withColumn("first", first.scalar()).where((F.col("month_idx") - F.col("first")) % holding == 0).drop("first")
    rows = panel.select("permno", "month_idx", F.lit(None).cast("int").alias("given"), F.lit(True).alias("real"))
    every = rows.unionByName(given.withColumn("real", F.lit(False)))
    w = Window.partitionBy("permno").orderBy("month_idx")
    w = w.rangeBetween(Window.unboundedPreceding, 0) if holding > 1 else w.rangeBetween(0, 0)
    return every.withColumn("held", F.last("given", ignorenulls=True).over(w)).where("real").select("permno", "month_idx", "held")


def portfolio_returns(panel: DataFrame, label: str = "ptf", n_ptf: int = 5, weighting: str = "value", min_stocks: int = 1, holding: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month_idx, ptf, ret, n, mve) for every month of the panel and label 1..n_ptf. Labels and market equity
    are those of the month before. An empty portfolio has n 0, mve 0 and no return."""
    df = panel.withColumn("__w", lagged("me", keys=keys))
    if holding > 1 and keys:
        raise ValueError("holding periods are those of one signal")
    if holding > 1:
        df = df.join(held_labels(panel, label, holding), ["permno", "month_idx"])
    else:
        df = df.withColumn("held", lagged(label, keys=keys))
    df = df.where(F.col("held").isNotNull() & F.col("ret").isNotNull())
    if weighting == "value":
        df = df.where(F.col("__w").isNotNull())
        ret, mve = F.when(F.sum("__w") > 0, F.sum(F.col("__w") * F.col("ret")) / F.sum("__w")), F.when(F.sum("__w") > 0, F.sum("__w")).otherwise(0.0)
    else:
        ret, mve = F.avg("ret"), F.coalesce(F.sum("__w"), F.lit(0.0))
    sums = df.groupBy(*keys, "month_idx", F.col("held").alias("ptf")).agg(ret.alias("ret"), F.count("*").alias("n"), mve.alias("mve")).where(F.col("n") >= min_stocks)
    grid = panel.select(*keys, "month_idx").distinct().select(*keys, "month_idx", F.explode(F.sequence(F.lit(1), F.lit(n_ptf))).alias("ptf"))
    out = grid.join(sums, [*keys, "month_idx", "ptf"], "left")
    return out.select(*keys, "month_idx", "ptf", "ret", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mve", F.lit(0.0)).alias("mve"))


def require_labels(panel: DataFrame, label: str, n_ptf: int) -> None:
    """ValueError if a label lies outside 1..n_ptf."""
    odd = panel.where(F.col(label).isNotNull() & ~F.col(label).between(1, n_ptf)).select(label).head(1)
    if odd:
        raise ValueError(f"portfolio label {odd[0][0]} lies outside 1..{n_ptf}")


def long_short(returns: DataFrame, n_ptf: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month_idx, ls): last label less first; NULL where either is."""
    def of(k: int) -> Column:
        return F.max(F.when(F.col("ptf") == k, F.col("ret")))

    return returns.groupBy(*keys, "month_idx").agg((of(n_ptf) - of(1)).alias("ls"))
