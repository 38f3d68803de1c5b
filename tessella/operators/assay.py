"""Post-search tests: multiple testing, Bayesian p-values, bootstrap, horse race, subsamples, decay, spanning.

Monthly betas and monthly moments are the reuse points: each is one pass over the stocks; what follows
works on a row per signal and month. Stepwise procedures loop on the driver over such small tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tessella.functions import linear
from tessella.functions.scalar import average_rank
from tessella.operators import regression as R
from tessella.operators.panel import row_rank

# Significance, the priors, recessions (first and last month) and subsamples (year * 12 + month).
CRITICAL, PRIORS = 1.96, (0.05, 0.20, 0.50)
RECESSIONS = (
    ("1960-04", "1961-02"), ("1969-12", "1970-11"), ("1973-11", "1975-03"), ("1980-01", "1980-07"), ("1981-07", "1982-11"),
    ("1990-07", "1991-03"), ("2001-03", "2001-11"), ("2007-12", "2009-06"), ("2020-02", "2020-04"),
)
SUBSAMPLES = {
    "full": (None, None), "pre_anomaly": ("1963-07", "1990-12"), "post_publication": ("1991-01", None), "pre_2000": ("1963-07", "2000-06"),
    "post_2000": ("2000-07", None), "post_2010": ("2011-01", None), "ex_recession": "ex_recession",
}
LEAST_MONTHS = 24


def month_number(text: str) -> int:
    return int(text[:4]) * 12 + int(text[5:7])


# Multiple testing. -----------------------------------------------------------------------------------


@pandas_udf(DoubleType())
def two_sided_p(t: pd.Series) -> pd.Series:
    """2 (1 - Phi(|t|)) of a column, NULL where t isn't finite; no such function is built in."""
    x = t.to_numpy(float, na_value=np.nan)
    return pd.Series(np.where(np.isfinite(x), linear.two_sided_ps(x), np.nan)).where(np.isfinite(x))


def adjusted(df: DataFrame, p: str = "p_value", order: str = "pos", alpha: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with rank, Bonferroni, Holm and Benjamini-Hochberg-Yekutieli columns over rows that have a p-value.
    keys tell families of tests apart; ties keep the order of column `order`. A family is sorted once each way: its
    harmonic number is a sum of 1 / rank, and the minimum over the rows onward is one over those before, from the end."""
    by = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)]))
    asc = by.orderBy(p, order)
    upto, onward = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (asc, by.orderBy(F.desc("rank"))))
    df = df.where(F.col(p).isNotNull()).withColumns({"rank": F.row_number().over(asc), "m": F.count("*").over(by)})
    one = F.lit(1.0)
    df = df.withColumn("c_m", F.sum(1.0 / F.col("rank")).over(by))
    df = df.withColumns({
        "bonf_adj_p": F.least(F.col("m") * F.col(p), one),
        "holm_adj_p": F.least(F.max((F.col("m") - F.col("rank") + 1) * F.col(p)).over(upto), one),
        "bhy_critical": F.col("rank") / (F.col("m") * F.col("c_m")) * alpha,
        "bhy_adj_p": F.least(F.min(F.col("m") * F.col("c_m") / F.col("rank") * F.col(p)).over(onward), one),
    })
    last = F.coalesce(F.max(F.when(F.col(p) <= F.col("bhy_critical"), F.col("rank"))).over(by), F.lit(0))
    return df.withColumns({"bonf_reject": F.col("bonf_adj_p") <= alpha, "holm_reject": F.col("holm_adj_p") <= alpha, "bhy_reject": F.col("rank") <= last}).drop("c_m")


def testing_summary(adjusted_rows: DataFrame, alpha: float = 0.05) -> dict:
    """Counts of rejections and the hurdles in t: Bonferroni's (and Holm's first), and BHY's at its last rejection."""
    r = adjusted_rows.agg(F.count("*").alias("m"), *[F.count_if(f"{k}_reject").alias(k) for k in ("bonf", "holm", "bhy")]).first()
    m = r.m
    if not m:
        return {"m": 0, "n_reject_bonf": 0, "n_reject_holm": 0, "n_reject_bhy": 0, "bonf_t": math.nan, "holm_t": math.nan, "bhy_t": math.nan}
    first = linear.normal_ppf(1 - alpha / (2 * m))
    bhy = linear.normal_ppf(1 - alpha * r.bhy / (m * sum(1 / k for k in range(1, m + 1))) / 2) if r.bhy else math.nan
    return {"m": m, "n_reject_bonf": r.bonf, "n_reject_holm": r.holm, "n_reject_bhy": r.bhy, "bonf_t": first, "holm_t": first, "bhy_t": bhy}


def bayes_factor(t: Column) -> Column:
    return F.exp(-t * t / 2)


def sd_bayes_factor(p: Column) -> Column:
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(-math.e * p * F.ln(p))


def posterior_null(factor: Column, prior: Column | float) -> Column:
    odds = (1 - F.lit(prior)) / F.lit(prior) if isinstance(prior, float) else (1 - prior) / prior
    return factor * odds / (1 + factor * odds)


def bayesian_report(df: DataFrame, t: str = "t_stat", priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """df with bayes_p_005, bayes_p_020, bayes_p_050: posterior probability of the null by prior of an effect."""
    return df.withColumns({f"bayes_p_{round(p * 100):03d}": posterior_null(bayes_factor(F.col(t)), p) for p in priors})


def required_t(prior: float = 0.20, threshold: float = 0.05, method: str = "mbf") -> float:
    """Least |t| whose posterior null probability is within the threshold, by bisection on [0, 10]."""
    if not 0 < prior < 1:
        raise ValueError(f"the prior must lie in (0, 1), not {prior}")
    odds, low, high = (1 - prior) / prior, 0.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        p = linear.two_sided_p(mid)
        factor = math.exp(-mid * mid / 2) if method == "mbf" else 0.0 if p <= 0 else 1.0 if p >= 1 else -math.e * p * math.log(p)
        low, high = (mid, high) if factor * odds / (1 + factor * odds) > threshold else (low, mid)
    return (low + high) / 2


# Double bootstrap. -----------------------------------------------------------------------------------

GRID = tuple(round(1 + 0.1 * i, 1) for i in range(41))
RATES = ("tp", "fp", "fn", "tn", "type1", "type2", "oratio")
#: Most bytes of a matrix of betas that is collected and broadcast (700 months of 48,000 signals).
MATRIX_BYTES = 256 << 20


def column_t(matrix: np.ndarray, nw_lags: int = 0) -> np.ndarray:
    """A t-statistic for each column of months x signals; 0 where it can't be told."""
    if nw_lags > 0:
        return np.nan_to_num(np.array([linear.hac_mean_t(c, nw_lags)[1] if np.isfinite(c).sum() >= 2 else 0.0 for c in matrix.T]), nan=0.0, posinf=0.0, neginf=0.0)
    n = np.isfinite(matrix).sum(axis=0)
    with np.errstate(all="ignore"):
        mean = np.nansum(matrix, axis=0) / n
        se = np.sqrt(np.nansum((matrix - mean) ** 2, axis=0) / (n - 1)) / np.sqrt(n)
        return np.where((n > 1) & (se > 0), np.nan_to_num(mean / se), 0.0)


def _outcomes(t: np.ndarray, truth: np.ndarray, grid: np.ndarray, mode: str) -> np.ndarray:
    rejected = (np.abs(t) if mode == "two_sided" else t)[:, None] > grid
    yes, no = truth[:, None], ~truth[:, None]
    tp, fp, fn, tn = ((a & b).sum(axis=0).astype(float) for a, b in ((rejected, yes), (rejected, no), (~rejected, yes), (~rejected, no)))

    def share(a, b):
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    return np.stack([tp, fp, fn, tn, share(fp, fp + tp), share(fn, fn + tn), share(fp, fn)])


def one_ranking(x0: np.ndarray, seed: int, share: float, n_eval: int, grid: np.ndarray, ranking: str, testing: str, nw_lags: int) -> np.ndarray:
    """Sums over n_eval evaluation resamples of one ranking resample: RATES x grid."""
    rng = np.random.RandomState(seed)
    months, n = x0.shape
    xi = x0[rng.choice(months, size=months, replace=True)]
    t = column_t(xi, nw_lags)
    truth = np.zeros(n, bool)
    truth[np.argsort(-(np.abs(t) if ranking == "two_sided" else t))[: min(max(int(math.floor(share * n)), 0), n)]] = True
    pseudo = x0 - np.nanmean(x0, axis=0) + np.where(truth, np.nanmean(xi, axis=0), 0.0)
    return sum(_outcomes(column_t(pseudo[rng.choice(months, size=months, replace=True)], nw_lags), truth, grid, testing) for _ in range(n_eval))


def double_bootstrap(spark: SparkSession, matrix: np.ndarray, share_true: float, n_rank: int = 100, n_eval: int = 200, grid: tuple[float, ...] = GRID, ranking: str = "signed", testing: str = "signed", nw_lags: int = 0) -> DataFrame:
    """(t, type1, type2, oratio) by threshold: realised error rates with known truth. Seeds are 0..n_rank - 1, so a
    lost task is redone alike. matrix (months x signals of betas, oriented) is broadcast; MATRIX_BYTES bounds it."""
    if np.asarray(matrix).size * 8 > MATRIX_BYTES:
        raise ValueError(f"a matrix of {np.asarray(matrix).shape} is beyond {MATRIX_BYTES} bytes")
    sent, points = spark.sparkContext.broadcast(np.asarray(matrix, float)), np.asarray(grid, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                sums = one_ranking(sent.value, seed, share_true, n_eval, points, ranking, testing, nw_lags)
                yield pa.RecordBatch.from_arrays([pa.array(points), *map(pa.array, sums)], ["t", *RATES])

    each = spark.range(0, n_rank, 1, min(n_rank, spark.sparkContext.defaultParallelism * 4)).mapInArrow(run, "t double, " + ", ".join(f"{r} double" for r in RATES))
    total = float(n_rank * n_eval)
    return each.groupBy("t").agg(*[(F.sum(r) / total).alias(r) for r in ("type1", "type2", "oratio")])


def hurdle(rates: DataFrame, target: float = 0.05, rate: str = "type1") -> float:
    """First threshold whose rate is within the target, else the last."""
    r = rates.agg(F.min(F.when(F.col(rate) <= target, F.col("t"))).alias("first"), F.max("t").alias("last")).first()
    return r.last if r.first is None else r.first


def beta_matrix(betas: DataFrame, nw_lags: int = 6) -> tuple[list, np.ndarray]:
    """Signals, and months x signals of betas (signal_id, month_idx, beta); signals need more than max(3, nw_lags + 2)
    months. ValueError, before anything is collected, if the matrix would be beyond MATRIX_BYTES."""
    betas = betas.select("signal_id", "month_idx", "beta").persist()
    try:
        enough = betas.groupBy("signal_id").agg(F.count("beta").alias("n")).where(F.col("n") > max(3, nw_lags + 2))
        usable = betas.join(enough, "signal_id", "left_semi")
        signals, months = usable.agg(F.countDistinct("signal_id"), F.countDistinct("month_idx")).first()
        if signals * months * 8 > MATRIX_BYTES:
            raise ValueError(f"betas of {signals} signals in {months} months are beyond {MATRIX_BYTES} bytes; take fewer signals at a time")
        pdf = usable.toPandas()
    finally:
        betas.unpersist()
    wide = pdf.pivot(index="month_idx", columns="signal_id", values="beta").sort_index()
    return [*wide.columns], wide.to_numpy(float)


# Subsamples and decay. -------------------------------------------------------------------------------


def in_recession(month_idx: Column) -> Column:
    out = F.lit(False)
    for a, b in RECESSIONS:
        out = out | month_idx.between(month_number(a), month_number(b))
    return out


def _active(period) -> Column:
    m = F.col("month_idx")
    if period == "ex_recession":
        return ~in_recession(m)
    return (m >= month_number(period[0]) if period[0] else F.lit(True)) & (m <= month_number(period[1]) if period[1] else F.lit(True))


def subsamples(months: DataFrame, betas: DataFrame, periods: dict = SUBSAMPLES, nw_lags: int = 6) -> DataFrame:
    """(label, n_months, tstat, status): betas of the period's return months; NULL t where the calendar (months:
    month_idx) has fewer than LEAST_MONTHS of them. Betas are reused, so a month left out never shifts a lag."""
    labels = F.array(*[F.when(_active(p), F.lit(n)) for n, p in periods.items()])

    def tagged(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(labels).alias("label")).where("label IS NOT NULL")

    counts = tagged(months.select("month_idx").distinct()).groupBy("label").agg(F.count("*").alias("n_months"))
    t = R.newey_west(tagged(betas), lags=nw_lags, keys=("label",)).select("label", "tstat")
    every = betas.sparkSession.createDataFrame([(n,) for n in periods], "label string")
    out = every.join(counts, "label", "left").join(t, "label", "left").withColumn("n_months", F.coalesce("n_months", F.lit(0)))
    t = F.when(F.col("n_months") >= LEAST_MONTHS, F.col("tstat"))
    return out.select("label", "n_months", t.alias("tstat"), F.when(t.isNotNull(), "ok").otherwise("not_estimable").alias("status"))


def subsample_counts(rows: DataFrame, expected_sign: str = "positive") -> DataFrame:
    """(n_available, n_pass, pass_ratio): periods with a t beyond CRITICAL of the expected sign."""
    oriented = -F.col("tstat") if expected_sign == "negative" else F.col("tstat")
    available, passed = F.count("tstat"), F.count_if(oriented > CRITICAL)
    return rows.agg(available.alias("n_available"), passed.alias("n_pass"), F.when(available > 0, passed / available).alias("pass_ratio"))


def decay_windows(months: DataFrame, betas: DataFrame, window: int = 60, step: int = 12, nw_lags: int = 6) -> DataFrame:
    """(win, centre, tstat) of windows of `window` months, `step` apart; the first month of a window has no lag in it."""
    span = months.agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b"))
    starts = span.where(F.col("b") - F.col("a") + 1 >= window).select(F.posexplode(F.sequence(F.col("a"), F.col("b") - window + 1, F.lit(step))).alias("win", "start"))
    # A month belongs to few windows: their numbers are computed, not searched by a range join.
    first = months.agg(F.min("month_idx")).scalar()
    off = F.col("month_idx") - F.col("first")
    low = F.greatest(F.ceil((off - window + 1) / step), F.lit(0)).cast("int")
    high = F.floor((off - 1) / step).cast("int")
    tagged = betas.withColumn("first", first).where(high >= low).select("month_idx", "beta", F.explode(F.sequence(low, high)).alias("win"))
    t = R.newey_west(tagged, lags=nw_lags, keys=("win",)).select("win", "tstat")
    return starts.join(t, "win", "left").select("win", (F.col("start") + window // 2).alias("centre"), "tstat")


def decay_trend(windows: DataFrame, window: int = 60, step: int = 12) -> dict:
    """Trend of |t| over windows, with HAC errors: slope, t and a classification."""
    rows = windows.select("win", "tstat").orderBy("win").toPandas()
    y = np.abs(rows["tstat"].to_numpy(float))
    ok = np.isfinite(y)
    lags = max(1, math.ceil(window / step) - 1)
    if ok.sum() < max(5, 3 * (lags + 1)):
        return {"slope": math.nan, "tstat": math.nan, "classification": "insufficient_data"}
    x = np.column_stack([np.ones(ok.sum()), rows["win"].to_numpy(float)[ok]])
    fit = linear.least_squares(y[ok], x)
    # Valid windows are taken as consecutive.
    se = linear.hac_errors(x, fit.resid, np.arange(len(x)), lags)[1]
    t = fit.beta[1] / se if se > 0 and np.std(fit.resid) >= 1e-10 * max(1.0, y[ok].max()) else 0.0
    return {"slope": float(fit.beta[1]), "tstat": float(t), "classification": "strengthening" if t > CRITICAL else "decaying" if t < -CRITICAL else "stable"}


# Correlations, horse race, spanning. -----------------------------------------------------------------


def oriented(t: float | None, sign: str) -> float:
    return -math.inf if t is None or not math.isfinite(t) else -t if sign == "negative" else t


def sampled_months(panel: DataFrame, every: int = 12, beyond: int = 60) -> DataFrame:
    """(month_idx): every `every`-th of the panel's months, by position, if there are more than `beyond`."""
    months = panel.select("month_idx").distinct()
    w = Window.orderBy("month_idx")
    # One row a month: hundreds of rows at most.
    df = months.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return df.where((F.col("n") <= beyond) | (F.col("i") % every == 0)).select("month_idx")


#: Rows of a month's cross-section that one task turns into sums of products.
BLOCK_ROWS = 1 << 15


def in_blocks(panel: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """panel with `block`: the stocks of a month dealt into blocks of about `rows`, told by the month's size."""
    sizes = panel.groupBy("month_idx").agg(F.ceil(F.count("*") / rows).cast("int").alias("__blocks"))
    return panel.join(sizes, "month_idx").withColumn("block", F.pmod(F.xxhash64("permno"), F.col("__blocks")).cast("int")).drop("__blocks")


def pair_moments(panel: DataFrame, names: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """(month_idx, a, b, n, sa, sb, saa, sbb, sab) of every two columns, by their positions in names: sums over the
    stocks that have both. A month's blocks become products of matrices, whatever the number of columns, and meet as sums."""
    k = len(names)
    upper = np.triu_indices(k, 1)

    def run(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(k)]).astype(float)
        has = np.isfinite(x)
        x, m = np.where(has, x, 0.0), has.astype(float)
        n, sa, saa, sab = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
        month = np.full(len(upper[0]), table.column("month_idx")[0].as_py(), np.int32)
        cols = [n[upper], sa[upper], sa.T[upper], saa[upper], saa.T[upper], sab[upper]]
        return pa.table([pa.array(month), pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *map(pa.array, cols)], names=["month_idx", "a", "b", *_MOMENTS])

    few = panel.select(F.col("month_idx").cast("int").alias("month_idx"), "permno", *[F.col(f"`{n}`").cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    parts = in_blocks(few, rows).groupBy("month_idx", "block").applyInArrow(run, "month_idx int, a int, b int, " + ", ".join(f"{c} double" for c in _MOMENTS))
    return parts.groupBy("month_idx", "a", "b").agg(*[F.sum(c).alias(c) for c in _MOMENTS])


_MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab")


def correlation_matrix(panel: DataFrame, names: list[str], min_stocks: int = 31, min_dates: int = 3, every: int = 12) -> DataFrame:
    """(a, b, n_months, corr) of every two signals (columns of panel, ranked): mean monthly correlation over their
    joint stocks, from the months' sums of products. NULL: overlap too thin."""
    df = panel.join(sampled_months(panel, every), "month_idx", "left_semi")
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in _MOMENTS)
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    tiny = F.lit(1e-12)  # a deviation that is nothing but rounding is none
    r = F.when((va > tiny * saa) & (vb > tiny * sbb), (sab - sa * sb / n) / F.sqrt(va * vb))
    usable = F.when((n >= min_stocks) & r.isNotNull(), r)
    out = pair_moments(df, names).groupBy("a", "b").agg(F.count(usable).alias("n_months"), F.when(F.count(usable) >= min_dates, F.avg(usable)).alias("corr"))
    named = F.array(*map(F.lit, names))
    return out.select(F.get(named, F.col("a")).alias("a"), F.get(named, F.col("b")).alias("b"), "n_months", "corr")


@dataclass
class HorseRace:
    conditional_t: dict[str, float]
    survivors: list[str]
    survivor_t: dict[str, float]
    dropped: dict[str, str] = field(default_factory=dict)
    status: str = "ok"


def _t_of(moments: DataFrame, every: list[str], subsets: list[list[str]]) -> list[dict[str, float]]:
    """Fama-MacBeth t's of each subset's joint regression, from the moments (regression.pattern_moments) of all: one job."""
    got = R.newey_west(R.subset_betas(moments, every, subsets), keys=("subset", "name")).where("name <> 'const'").collect()
    t = {(r.subset, r.name): r.tstat for r in got}
    return [{n: math.nan if t.get((i, n)) is None else t[i, n] for n in names} for i, names in enumerate(subsets)]


def deduplicated(names: list[str], corr: dict[tuple[str, str], float | None], score: dict[str, float], threshold: float = 0.95) -> tuple[list[str], dict[str, str]]:
    """Of two signals correlated beyond the threshold, the one of the higher score stays (the first, of equals)."""
    gone: dict[str, str] = {}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a in gone:
                break
            r = corr.get((a, b))
            if b not in gone and r is not None and abs(r) > threshold:
                gone[b if score[a] >= score[b] else a] = "near_duplicate"
    return [n for n in names if n not in gone], gone


def horse_race(panel: DataFrame, signs: dict[str, str], threshold: float = CRITICAL) -> HorseRace:
    """Signals (columns of panel, ranked) against each other: joint t's, near-duplicates out, then backward
    elimination: the last inestimable, else the worst of wrong sign, else the weakest within the threshold. The stocks
    are read twice, for moments and for correlations; each elimination works on the months' moments."""
    names = [*signs]
    moments = R.pattern_moments(panel, names).persist()
    try:
        return _raced(moments, panel, names, signs, threshold)
    finally:
        moments.unpersist()


def _raced(moments: DataFrame, panel: DataFrame, names: list[str], signs: dict[str, str], threshold: float) -> HorseRace:
    joint, *alone = _t_of(moments, names, [names, *([n] for n in names)])
    corr = {(r.a, r.b): r.corr for r in correlation_matrix(panel, names).collect()} if len(names) > 1 else {}
    score = {n: oriented(t[n], signs[n]) for n, t in zip(names, alone, strict=True)}
    left, dropped = deduplicated(names, corr, score)
    finite = any(math.isfinite(t) for t in joint.values())
    while left:
        (t,) = _t_of(moments, names, [left])
        finite = finite or any(math.isfinite(x) for x in t.values())
        lost = [n for n in left if not math.isfinite(t[n])]
        worst = min(left, key=lambda n: oriented(t[n], signs[n]))
        if lost:
            name, why = lost[-1], "conditional_t_not_estimable"
        elif oriented(t[worst], signs[worst]) <= 0:
            name, why = worst, "conditional_sign_mismatch"
        elif oriented(t[worst], signs[worst]) <= threshold:
            name, why = worst, "conditional_t_below_threshold"
        else:
            return HorseRace(joint, left, t, dropped)
        dropped[name] = why
        left = [n for n in left if n != name]
    return HorseRace(joint, [], {}, dropped, "ok" if finite else "not_estimable")


def spanning_correlations(panel: DataFrame, signal: str, controls: list[str], every: int = 12) -> DataFrame:
    """(control, n_months, corr) sorted by |corr|: mean monthly rank correlation of the signal (ranked over its
    own stocks) and a control (ranked over the stocks both ever have)."""
    df = panel.join(sampled_months(panel, every, beyond=0), "month_idx", "left_semi")
    new = row_rank(df.select("month_idx", "permno", F.col(signal).alias("a")), "a")
    long = df.select("month_idx", "permno", *controls).unpivot(["month_idx", "permno"], controls, "control", "b").where("b IS NOT NULL")
    stocks = new.select("permno").distinct()
    month = Window.partitionBy("control", "month_idx")
    long = long.join(stocks, "permno", "left_semi").withColumn("n_b", F.count("b").over(month)).withColumn("rb", F.when(F.col("n_b") >= 2, average_rank(F.col("b"), month)))
    shape = long.groupBy("control").agg(F.countDistinct("month_idx").alias("dates"), F.countDistinct("permno").alias("cols")).where("dates >= 6 AND cols >= 50")
    met = long.join(new.where("a IS NOT NULL"), ["month_idx", "permno"]).groupBy("control", "month_idx").agg(F.count("*").alias("n"), F.corr("a", "rb").alias("r")).where("n >= 30 AND r IS NOT NULL AND NOT isnan(r)")
    out = met.join(shape, "control", "left_semi").groupBy("control").agg(F.count("*").alias("n_months"), F.avg("r").alias("corr"))
    return out.orderBy(F.abs("corr").desc(), "control")


def design_diagnostics(panel: DataFrame, chars: list[str], ret: str | None = None, n_lags: int = 1) -> dict[str, int]:
    """Months through nested gates: enough complete rows, variation, full rank, acceptable condition. With ret, rows
    need the return n_lags months later."""
    k = len(chars)
    full = F.lit(True)
    for c in chars:
        full = full & F.col(c).isNotNull()
    df = panel
    last = panel.agg(F.max("month_idx") - n_lags).scalar()
    if ret:
        df = df.withColumn("__y", F.first(ret).over(Window.partitionBy("permno").orderBy("month_idx").rangeBetween(n_lags, n_lags)))
        full = full & F.col("__y").isNotNull()
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in chars]]
    flat = [F.max(c) == F.min(c) for c in chars]
    still = flat[0]
    for f in flat[1:]:
        still = still | f
    df = df.withColumn("__last", last).where(full & (F.col("month_idx") <= F.col("__last")))
    sums = df.groupBy("month_idx").agg(F.count("*").alias("n"), still.alias("flat"), F.array(*[F.sum(z[i] * z[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gates = []
            for n, flat_, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram = np.zeros((k + 1, k + 1))
                gram[np.triu_indices(k + 1)] = m
                rank, condition = linear.gram_rank(gram + np.triu(gram, 1).T)
                gate = 0 if n < k + 2 else 1 if flat_ else 2 if rank < k + 1 else 3 if not condition <= linear.MAX_CONDITION else 4
                gates.append(gate)
            yield pa.RecordBatch.from_arrays([pa.array(gates, pa.int32())], ["gate"])

    r = sums.select("n", "flat", "m").mapInArrow(run, "gate int").agg(*[F.count_if(F.col("gate") >= g).alias(name) for g, name in enumerate(("coverage", "nonzero_variance", "full_rank", "well_conditioned"), 1)]).first()
    return r.asDict()


@dataclass
class Spanning:
    status: str
    reason: str | None = None
    controls: list[str] = field(default_factory=list)
    correlations: list[float] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)
    t_univariate: float = math.nan
    t_conditional: float = math.nan
    control_t: dict[str, float] = field(default_factory=dict)
    identified_months: int = 0
    valid_months: int = 0
    survives_196: bool = False
    survives_300: bool = False


def _skip_reason(d: dict[str, int], least: int) -> str | None:
    for gate, why in (("coverage", "insufficient_joint_coverage"), ("nonzero_variance", "zero_cross_sectional_variance"), ("full_rank", "rank_deficient"), ("well_conditioned", "ill_conditioned")):
        if d[gate] < least:
            return why
    return None


def spanning_test(panel: DataFrame, signal: str, controls: list[str], expected_sign: str = "positive", top_k: int = 10, every: int = 12, least: int = LEAST_MONTHS) -> Spanning:
    """Whether a signal survives its most correlated controls. Controls are admitted in order of correlation while
    enough months stay identified; returns play no part in the choice."""
    ranked = spanning_correlations(panel, signal, controls, every).collect()
    if not ranked:
        return Spanning("not_estimable", "no_overlapping_controls")
    out = Spanning("not_estimable")
    for r in ranked:
        if len(out.controls) == top_k:
            break
        d = design_diagnostics(panel, [signal, *out.controls, r.control])
        why = _skip_reason(d, least)
        if why:
            out.skipped[r.control] = why
            continue
        out.controls.append(r.control)
        out.correlations.append(r.corr)
        out.identified_months = d["well_conditioned"]
    if not out.controls:
        out.reason = "no_valid_controls"
        return out
    out.valid_months = design_diagnostics(panel, [signal, *out.controls], "ret")["well_conditioned"]
    if out.valid_months < least:
        out.reason = "insufficient_joint_coverage"
        return out
    every = [signal, *out.controls]
    alone, joint = _t_of(R.pattern_moments(panel, every), every, [[signal], every])
    out.t_univariate = alone[signal]
    out.t_conditional, out.control_t = joint.pop(signal), joint
    up = oriented(out.t_conditional, expected_sign)
    out.survives_196, out.survives_300 = up > 1.96, up > 3.0
    out.status, out.reason = ("ok", None) if math.isfinite(out.t_conditional) else ("not_estimable", "non_finite_conditional_t")
    return out


def converged(hit_rates: list[float], best: list[float]) -> tuple[bool, str]:
    """Whether a search has run dry, by the hit rate and best |t| of its generations."""
    if len(hit_rates) < 2:
        return False, "too_few_generations"
    if hit_rates[-1] < 0.20:
        return True, "hit_rate_collapse"
    if best[0] > 0 and best[-1] < 0.5 * best[0]:
        return True, "diminishing_returns"
    if best[-1] < best[-2] and hit_rates[-1] < hit_rates[-2]:
        return True, "no_improvement"
    return False, "productive"
