"""Portfolio analyses in one call: sort, returns, long-short, factor regressions, joint test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import portfolio as S
from tessella.operators import regression as R


def _within(panel: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        panel = panel.where(F.col("month_idx") >= first)
    return panel if last is None else panel.where(F.col("month_idx") <= last)


def returns_with_spread(returns: DataFrame, n_ptf: int) -> DataFrame:
    """(month_idx, ptf string, ret) of the portfolios and, as LS, of the last less the first."""
    spread = S.long_short(returns, n_ptf).select("month_idx", F.lit("LS").alias("ptf"), F.col("ls").alias("ret"))
    return returns.select("month_idx", F.col("ptf").cast("string").alias("ptf"), "ret").unionByName(spread)


def run_univariate(
    panel: DataFrame, value: str, factors: DataFrame, names: list[str], n: int | list[float] = 5, weighting: str = "value", holding: int = 1, only: str | None = None,
    long_short: bool = True, rf: str | None = "RF", nw_lags: int = 6, first: int | None = None, last: int | None = None, cap_weighted: bool = False,
) -> DataFrame:
    """A row a portfolio (and LS): factor regression as in regression.factor_regressions, mean number of stocks and market
    equity, and the joint test's statistic and p-value (NULL with fewer than two portfolios). first and last bound the
    months. Stocks are read once: what follows works on the portfolios' months, which are written out in memory."""
    n_ptf = n if isinstance(n, int) else len(n) + 1
    sorted_ = S.univariate_sort(_within(panel, first, last), value, n, only, cap_weighted=cap_weighted)
    rets = S.portfolio_returns(sorted_, n_ptf=n_ptf, weighting=weighting, holding=holding)
    every = returns_with_spread(rets, n_ptf) if long_short else rets.withColumn("ptf", F.col("ptf").cast("string"))
    out = R.factor_regressions(every, factors, names, rf, nw_lags)
    held = rets.groupBy(F.col("ptf").cast("string").alias("ptf")).agg(F.avg("n").alias("mean_n"), F.avg("mve").alias("mean_mve"))
    out = out.join(held, "ptf", "left")
    if n_ptf < 2:
        return out.withColumns({"grs_f": F.lit(None).cast("double"), "grs_p": F.lit(None).cast("double")})
    joint = R.grs_test(rets, factors, names, rf).select(F.col("f_stat").alias("grs_f"), F.col("p_value").alias("grs_p"))
    return out.join(F.broadcast(joint), F.lit(True), "left")  # one row


def run_bivariate(
    panel: DataFrame, first_by: str, then_by: str, factors: DataFrame, names: list[str], n1: int = 5, n2: int = 5, conditional: bool = False, weighting: str = "value",
    only: str | None = None, rf: str | None = "RF", nw_lags: int = 0, first: int | None = None, last: int | None = None,
) -> DataFrame:
    """A row for each cell of the grid: its factor regression, with plain t's unless nw_lags says otherwise."""
    sorted_ = S.bivariate_sort(_within(panel, first, last), first_by, then_by, n1, n2, only, conditional)
    rets = S.portfolio_returns(sorted_, n_ptf=n1 * n2, weighting=weighting)
    return R.factor_regressions(rets.withColumn("ptf", F.col("ptf").cast("string")), factors, names, rf, nw_lags)
