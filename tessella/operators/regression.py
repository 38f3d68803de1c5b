"""Regressions: Fama-MacBeth, Newey-West means, factor models, GRS, tangency portfolios.

Cross-sections are reduced to moments by month in the JVM; kernels see one row a month (k by k
moments) or one portfolio's monthly series, never the stocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import linear
from tessella.functions.scalar import clip

# Columns of the factor models by id.
MODELS = {1: ["Mkt-RF"], 3: ["Mkt-RF", "SMB", "HML"], 4: ["Mkt-RF", "SMB", "HML", "Mom"], 5: ["Mkt-RF", "SMB", "HML", "RMW", "CMA"], 6: ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom"], 7: ["R_MKT", "R_ME", "R_IA", "R_ROE"]}


def factor_columns(model: int) -> list[str]:
    if model not in MODELS:
        raise ValueError(f"unknown factor model {model}; known: {sorted(MODELS)}")
    return MODELS[model]


def lagged_by(keys: list[str], column: str, months: int) -> Column:
    return F.first(column).over(Window.partitionBy(*keys).orderBy("month_idx").rangeBetween(-months, -months))


def univariate_betas(panel: DataFrame, signal: str = "signal", ret: str = "ret", n_lags: int = 1, min_obs: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, month_idx, beta, const, r2, nobs): slope of ret on the signal n_lags months before, of months with
    min_obs pairs and some variation. keys (say, signal_id) tell panels of several signals apart."""
    df = panel.withColumn("__x", lagged_by([*keys, "permno"], signal, n_lags)).where(F.col("__x").isNotNull() & F.col(ret).isNotNull())
    x, y = F.col("__x"), F.col(ret)
    out = df.groupBy(*keys, "month_idx").agg(
        F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("const"), F.when(F.var_pop(y) > 0, F.regr_r2(y, x)).alias("r2"), F.count("*").alias("nobs"), F.var_pop(x).alias("__v")
    )
    return out.where((F.col("nobs") >= min_obs) & (F.col("__v") > 0)).drop("__v")


def newey_west(betas: DataFrame, value: str = "beta", lags: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, mean, tstat, n): mean of a monthly series and its t-statistic with Bartlett weights; pairs of lag l
    are exactly l calendar months apart. Windows and sums only."""
    by = [F.col(k) for k in keys] or [F.lit(0)]
    part = Window.partitionBy(*by)
    df = betas.where(F.col(value).isNotNull()).withColumn("__d", F.col(value) - F.avg(value).over(part))
    order = part.orderBy("month_idx")
    leads = {f"__l{k}": F.first("__d").over(order.rangeBetween(k, k)) for k in range(1, lags + 1)}
    df = df.withColumns(leads) if leads else df
    n = F.count("*")
    var = F.sum(F.col("__d") * F.col("__d")) / n
    for k in range(1, lags + 1):
        var = var + F.lit(2.0 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("__d") * F.col(f"__l{k}")), F.lit(0.0)) / n
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0)) / n).alias("se"), n.alias("n"))
    return out.select(*keys, "mean", F.when((F.col("n") >= 2) & (F.col("se") > 0), F.col("mean") / F.col("se")).alias("tstat"), "n")


def plain_t(betas: DataFrame, value: str = "beta", keys: tuple[str, ...] = ()) -> DataFrame:
    out = betas.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))
    return out.select(*keys, "mean", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("tstat"), "n")


def _bounded_by_month(panel: DataFrame, columns: list[str], pct: float, bound) -> DataFrame:
    """columns replaced by bound(value, low, high) of the month's pct and 100 - pct percentiles, as they are in months of
    fewer than three values. The percentiles of all columns are one grouped aggregate, joined back."""
    ends = F.array(F.lit(pct / 100), F.lit(1 - pct / 100))
    stats = panel.groupBy("month_idx").agg(*[F.struct(F.percentile(c, ends).alias("b"), F.count(c).alias("n")).alias(f"__s_{i}") for i, c in enumerate(columns)])
    df = panel.join(stats.withColumnRenamed("month_idx", "__month"), F.col("month_idx").eqNullSafe(F.col("__month")))
    out = {}
    for i, c in enumerate(columns):
        s, x = F.col(f"__s_{i}"), F.col(c)
        out[c] = F.when(s["n"] < 3, x).otherwise(bound(x, s["b"][0], s["b"][1]))
    return df.withColumns(out).select(*panel.columns)


def trim_by_month(panel: DataFrame, columns: list[str], pct: float) -> DataFrame:
    """Values outside the month's pct and 100 - pct percentiles become NULL (months of at least three values)."""
    return _bounded_by_month(panel, columns, pct, lambda x, low, high: F.when(x.between(low, high), x))


def winsorize_by_month(panel: DataFrame, columns: list[str], pct: float) -> DataFrame:
    """Values outside the month's pct and 100 - pct percentiles become the nearer one (months of at least three values)."""
    return _bounded_by_month(panel, columns, pct, clip)


def monthly_moments(panel: DataFrame, chars: list[str], ret: str = "ret", n_lags: int = 1, weight: str | None = None, trim_pct: float = 0) -> DataFrame:
    """(month_idx, n, moments): weighted sums of products of (1, chars, ret) over complete rows, upper triangle row by row."""
    names = [f"__c{i}" for i in range(len(chars))]
    df = panel.withColumns({n: lagged_by(["permno"], c, n_lags) for n, c in zip(names, chars, strict=True)} | ({"__w": lagged_by(["permno"], weight, n_lags)} if weight else {}))
    df = trim_by_month(df, names, trim_pct) if trim_pct > 0 else df
    complete = F.col(ret).isNotNull()
    for n in names:
        complete = complete & F.col(n).isNotNull()
    if weight:
        complete = complete & (F.col("__w") > 0)
    w = F.col("__w") if weight else F.lit(1.0)
    z = [F.lit(1.0), *map(F.col, names), F.col(ret)]
    sums = [F.sum(w * z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.where(complete).groupBy("month_idx").agg(F.count("*").alias("n"), F.array(*sums).alias("moments"))


def _solved(n: float, m: np.ndarray) -> tuple[float | None, np.ndarray | None]:
    """R2 and coefficients of a regression from its moments (const, chars, ret); None where it isn't identified or
    has fewer than two rows more than chars."""
    gram, cross, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    if n < len(gram) + 1 or not linear.identified(gram):
        return None, None
    beta = np.linalg.solve(gram, cross)
    explained, total = beta @ cross - m[0, -1] ** 2 / m[0, 0], yy - m[0, -1] ** 2 / m[0, 0]
    return float(explained / total) if total > 0 else None, beta


def solve_moments(moments: DataFrame, k: int) -> DataFrame:
    """(month_idx, nobs, r2, beta array): each month's regression from its moments; NULL where it isn't identified or has fewer than k + 2 rows."""
    size = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = np.zeros((size, size))
                m[np.triu_indices(size)] = flat
                r2, beta = _solved(n, m + np.triu(m, 1).T)
                rows.append((n, r2, None if beta is None else beta.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["month_idx", "nobs", "r2", "beta"])

    return moments.select(F.col("month_idx").cast("int").alias("month_idx"), "n", "moments").mapInArrow(run, "month_idx int, nobs long, r2 double, beta array<double>")


def pattern_moments(panel: DataFrame, chars: list[str], ret: str = "ret", n_lags: int = 1) -> DataFrame:
    """(month_idx, pattern, n, moments): sums of products of (1, chars, ret) as in monthly_moments, apart for the rows of
    each pattern of chars that are there ('1' or '0' for each). Any subset's regression is solved from them, over just
    the rows that have all of it, without another look at the stocks."""
    names = [f"__c{i}" for i in range(len(chars))]
    df = panel.withColumns({n: lagged_by(["permno"], c, n_lags) for n, c in zip(names, chars, strict=True)})
    df = df.withColumn("pattern", F.concat(*[F.when(F.col(n).isNotNull(), "1").otherwise("0") for n in names])).where(F.col(ret).isNotNull() & F.contains("pattern", F.lit("1")))
    z = [F.lit(1.0), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names], F.col(ret)]
    sums = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.groupBy("month_idx", "pattern").agg(F.count("*").alias("n"), F.array(*sums).alias("moments"))


def subset_betas(moments: DataFrame, chars: list[str], subsets: list[list[str]]) -> DataFrame:
    """(subset, name, month_idx, beta): coefficients of the regressions of each subset of chars (by its position), from pattern_moments."""
    size = len(chars) + 2
    places = [[chars.index(c) for c in s] for s in subsets]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        matrices = []
        for flat in table.column("moments").to_pylist():
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = flat
            matrices.append(m + np.triu(m, 1).T)
        patterns, counts = table.column("pattern").to_pylist(), table.column("n").to_pylist()
        for i, at in enumerate(places):
            fits = [k for k, p in enumerate(patterns) if all(p[c] == "1" for c in at)]
            keep = [0, *(c + 1 for c in at), size - 1]
            if fits:
                beta = _solved(sum(counts[k] for k in fits), sum(matrices[k] for k in fits)[np.ix_(keep, keep)])[1]
                if beta is not None:
                    rows += [(i, n, b) for n, b in zip(["const", *subsets[i]], beta.tolist(), strict=True)]
        month = pa.array([key[0].as_py()] * len(rows), pa.int32())
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), month, pa.array([r[2] for r in rows], pa.float64())], names=["subset", "name", "month_idx", "beta"])

    return moments.select(F.col("month_idx").cast("int").alias("month_idx"), "pattern", "n", "moments").groupBy("month_idx").applyInArrow(run, "subset int, name string, month_idx int, beta double")


def fama_macbeth(panel: DataFrame, chars: list[str], ret: str = "ret", n_lags: int = 1, nw_lags: int | None = 6, weight: str | None = None, trim_pct: float = 0) -> DataFrame:
    """(name, mean, tstat, n) of const and each characteristic. nw_lags None: plain t-statistics."""
    months = solve_moments(monthly_moments(panel, chars, ret, n_lags, weight, trim_pct), len(chars)).where("beta IS NOT NULL")
    names = ["const", *chars]
    long = months.select("month_idx", F.posexplode("beta").alias("i", "beta"))
    long = long.withColumn("name", F.get(F.array(*map(F.lit, names)), F.col("i")))
    return plain_t(long, keys=("name",)) if nw_lags is None else newey_west(long, lags=nw_lags, keys=("name",))


REGRESSION = "ptf string, alpha double, talpha double, rsq double, sharpe double, ir double, mean_ret double, t_mean_ret double, nobs long, beta array<double>, tbeta array<double>"


def _aligned(pdf: pd.DataFrame, factors: list[str], rf: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("month_idx")
    y = pdf["ret"].to_numpy(float)
    if rf is not None and str(pdf["ptf"].iloc[0]) != "LS":
        y = y - pdf[rf].to_numpy(float)
    return pdf["month_idx"].to_numpy(), y, pdf[factors].to_numpy(float)


def factor_regressions(returns: DataFrame, factor_table: DataFrame, factors: list[str], rf: str | None = "RF", nw_lags: int = 6) -> DataFrame:
    """A row for each portfolio of returns (month_idx, ptf, ret): time-series regression of its excess return on
    the factors of the same month (LS is an excess return as it is). alpha is monthly; mean and Sharpe annual."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        months, y, f = _aligned(pdf, factors, rf)
        x = np.column_stack([np.ones(len(y)), f])
        k = f.shape[1]
        fit = linear.least_squares(y, x)
        alpha = talpha = rsq = ir = np.nan
        beta = tbeta = [np.nan] * k
        if fit.nobs >= k + 2 and np.isfinite(fit.beta).all():
            alpha, beta, rsq, t = fit.beta[0], fit.beta[1:].tolist(), fit.rsq, fit.tstat
            if nw_lags > 0:
                se = linear.hac_errors(x[fit.used], fit.resid[fit.used], months[fit.used], nw_lags)
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, fit.beta / se, np.nan)
            talpha, tbeta = t[0], t[1:].tolist()
            sd = np.nanstd(fit.resid, ddof=1) * np.sqrt(12)
            ir = alpha * 12 / sd if sd > 0 else np.nan
        ok = y[np.isfinite(y)]
        mean, sd = (ok.mean(), ok.std(ddof=1)) if len(ok) > 1 else (np.nan, np.nan)
        sharpe, t_mean = (mean * 12 / (sd * np.sqrt(12)), mean / (sd / np.sqrt(len(ok)))) if sd > 0 else (np.nan, np.nan)
        return pd.DataFrame([[str(pdf["ptf"].iloc[0]), alpha, talpha, rsq, sharpe, ir, mean * 12, t_mean, fit.nobs, beta, tbeta]], columns=[c.split()[0] for c in REGRESSION.split(", ")])

    joined = returns.join(factor_table, "month_idx").withColumn("ptf", F.col("ptf").cast("string"))
    return joined.groupBy("ptf").applyInPandas(run, REGRESSION)


def grs_test(returns: DataFrame, factor_table: DataFrame, factors: list[str], rf: str | None = "RF") -> DataFrame:
    """One row (f_stat, p_value, df1, df2): all portfolios but LS, over the months that have all of them. Input is
    one row a portfolio and month (some hundreds of months), so one group is small by nature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="month_idx", columns="ptf", values="ret").sort_index()
        f = pdf.drop_duplicates("month_idx").set_index("month_idx").loc[wide.index]
        y = wide.to_numpy(float) - (f[rf].to_numpy(float)[:, None] if rf else 0.0)
        full = np.isfinite(y).all(axis=1) & np.isfinite(f[factors].to_numpy(float)).all(axis=1)
        y, x = y[full], f[factors].to_numpy(float)[full]
        fits = [linear.least_squares(y[:, j], np.column_stack([np.ones(len(x)), x])) for j in range(y.shape[1])]
        return pd.DataFrame([linear.grs(np.array([q.beta[0] for q in fits]), np.column_stack([q.resid for q in fits]), x)])

    joined = returns.where("cast(ptf AS string) <> 'LS'").join(factor_table, "month_idx")
    return joined.groupBy().applyInPandas(run, "f_stat double, p_value double, df1 long, df2 long")


def mean_variance(returns: DataFrame) -> DataFrame:
    """(ptf, weight, sharpe): the tangency portfolio of returns (month_idx, ptf, ret)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="month_idx", columns="ptf", values="ret", dropna=False)
        w, sharpe = linear.tangency(wide.to_numpy(float))
        return pd.DataFrame({"ptf": wide.columns.astype("int64"), "weight": w, "sharpe": sharpe})

    return returns.groupBy().applyInPandas(run, "ptf long, weight double, sharpe double")
