"""Small dense linear algebra and distributions; everything here works on one series or one matrix."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

# Fixed value: designs whose scaled Gram matrix is worse conditioned than this are refused.
MAX_CONDITION = 1e12


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def normal_ppf(p: float) -> float:
    return math.inf if p >= 1 else -math.inf if p <= 0 else NormalDist().inv_cdf(p)


def two_sided_p(t: float) -> float:
    """2 (1 - Phi(|t|)), by subtraction: it reaches 0 for large t."""
    return 2.0 * (1.0 - normal_cdf(abs(t)))


_erf = np.frompyfunc(math.erf, 1, 1)


def two_sided_ps(t: np.ndarray) -> np.ndarray:
    """two_sided_p of an array."""
    return 2.0 * (1.0 - 0.5 * (1.0 + _erf(np.abs(np.asarray(t, float)) / math.sqrt(2.0)).astype(float)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + top * d, 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total


def f_cdf(f: float, df1: int, df2: int) -> float:
    return incomplete_beta(df1 / 2, df2 / 2, df1 * f / (df1 * f + df2)) if f > 0 else 0.0


def gram_rank(gram: np.ndarray) -> tuple[int, float]:
    """Rank and condition of a Gram matrix scaled to a unit diagonal."""
    d = np.diag(gram)
    if not np.all(np.isfinite(gram)) or np.any(d <= 0):
        return 0, math.inf
    scale = np.sqrt(d)
    s = np.linalg.svd(gram / np.outer(scale, scale), compute_uv=False)
    rank = int(np.sum(s > s[0] * len(s) * np.finfo(float).eps))
    return rank, float(s[0] / s[-1]) if s[-1] > 0 else math.inf


def identified(gram: np.ndarray) -> bool:
    rank, condition = gram_rank(gram)
    return rank == len(gram) and condition <= MAX_CONDITION


@dataclass
class Fit:
    beta: np.ndarray
    tstat: np.ndarray
    rsq: float
    nobs: int
    resid: np.ndarray
    used: np.ndarray


def least_squares(y: np.ndarray, x: np.ndarray, weights: np.ndarray | None = None) -> Fit:
    """OLS, or WLS, over the rows that are finite throughout (and of positive weight); NaN where the
    design has too few rows or isn't identified. R2 is NaN for a constant y."""
    y, x = np.asarray(y, float).ravel(), np.asarray(x, float)
    n_all, k = x.shape
    used = np.isfinite(y) & np.isfinite(x).all(axis=1)
    if weights is not None:
        weights = np.asarray(weights, float).ravel()
        used &= np.isfinite(weights) & (weights > 0)
    nobs = int(used.sum())
    bad = Fit(np.full(k, np.nan), np.full(k, np.nan), np.nan, nobs, np.full(n_all, np.nan), used)
    root = np.ones(nobs) if weights is None else np.sqrt(weights[used])
    a, b = x[used] * root[:, None], y[used] * root
    gram = a.T @ a
    if nobs < k + 1 or not identified(gram):
        return bad
    inverse = np.linalg.inv(gram)
    beta = inverse @ (a.T @ b)
    resid = b - a @ beta
    se = np.sqrt(np.maximum(np.diag(inverse) * (resid @ resid) / (nobs - k), 0))
    w = root**2
    centre = b - root * (np.sum(w * y[used]) / w.sum())
    total = centre @ centre
    out = np.full(n_all, np.nan)
    out[used] = y[used] - x[used] @ beta
    with np.errstate(divide="ignore", invalid="ignore"):
        return Fit(beta, np.where(se > 0, beta / se, np.nan), 1 - (resid @ resid) / total if total > 0 else np.nan, nobs, out, used)


def bartlett(scores: np.ndarray, positions: np.ndarray, lags: int) -> np.ndarray:
    """Long-run sum of outer products of scores (n, k); only rows whose positions differ by exactly l pair at lag l."""
    place = {int(p): i for i, p in enumerate(positions)}
    out = scores.T @ scores
    for lag in range(1, lags + 1):
        pairs = [(place[int(p) + lag], i) for i, p in enumerate(positions) if int(p) + lag in place]
        if pairs:
            j, i = (np.array(z) for z in zip(*pairs, strict=True))
            gamma = scores[j].T @ scores[i]
            out += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    return out


def hac_errors(x: np.ndarray, resid: np.ndarray, positions: np.ndarray, lags: int) -> np.ndarray:
    """Newey-West standard errors of OLS coefficients, without a small-sample factor."""
    inverse = np.linalg.inv(x.T @ x)
    v = inverse @ bartlett(x * resid[:, None], positions, lags) @ inverse
    return np.sqrt(np.maximum(np.diag(v), 0))


def hac_mean_t(series: np.ndarray, lags: int) -> tuple[float, float]:
    """Mean of a series with gaps (NaN) and its Newey-West t-statistic."""
    s = np.asarray(series, float)
    at = np.flatnonzero(np.isfinite(s))
    if len(at) == 0:
        return math.nan, math.nan
    mean = s[at].mean()
    if len(at) < 2:
        return mean, math.nan
    se = math.sqrt(max(bartlett((s[at] - mean)[:, None], at, lags)[0, 0], 0.0)) / len(at)
    return mean, mean / se if se > 0 else math.nan


def grs(alphas: np.ndarray, resid: np.ndarray, factors: np.ndarray) -> dict:
    """Joint test that all alphas are zero."""
    n = len(alphas)
    none = {"f_stat": math.nan, "p_value": math.nan, "df1": n, "df2": 0}
    full = np.isfinite(resid).all(axis=1) & np.isfinite(factors).all(axis=1)
    e, f = resid[full], factors[full]
    t, k = f.shape
    if n < 2 or t <= n + k or not np.isfinite(alphas).all():
        return none
    mean = f.mean(axis=0)
    try:
        top = alphas @ np.linalg.solve(e.T @ e / (t - k - 1), alphas)
        below = 1 + mean @ np.linalg.solve(np.atleast_2d(np.cov(f, rowvar=False)), mean)
    except np.linalg.LinAlgError:
        return none
    df2 = t - n - k
    stat = df2 / n * top / below
    return {"f_stat": float(stat), "p_value": 1 - f_cdf(stat, n, df2), "df1": n, "df2": df2}


def tangency(returns: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (|sum| 1) of the maximum-Sharpe portfolio and its annual Sharpe ratio, mean never negative."""
    r = np.asarray(returns, float)
    r = r[np.isfinite(r).all(axis=1)]
    t, n = r.shape
    if t < n + 1:
        return np.full(n, np.nan), math.nan
    if n == 1:
        mean, sd = r.mean(), r.std()
        return np.array([np.sign(mean)]), float(abs(mean) / sd * math.sqrt(12)) if sd else math.nan
    mean, cov = r.mean(axis=0), np.cov(r, rowvar=False)
    try:
        raw = np.linalg.solve(cov, mean)
    except np.linalg.LinAlgError:
        raw = np.linalg.pinv(cov) @ mean
    if abs(raw.sum()) < 1e-12:
        return np.full(n, np.nan), math.nan
    w = raw / raw.sum()
    w = -w if w @ mean < 0 else w
    return w, float(w @ mean / math.sqrt(max(w @ cov @ w, 1e-16)) * math.sqrt(12))
