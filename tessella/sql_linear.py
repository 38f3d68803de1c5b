"""Linear algebra as SQL text, for the oracles of regressions: elimination step by step, and what builds on it."""

from __future__ import annotations

TO_NORMAL = "list_sum(list_transform(range(0, 120), lambda n: exp((2 * n + 1) * ln(greatest(abs({x}) / sqrt(2), 1e-300)) - lgamma(n + 1.5) - {x} * {x} / 2)))"


def two_sided_p(x: str) -> str:
    """2 (1 - Phi(|x|)) by the series of the error function whose terms are all positive."""
    return f"(1 - {TO_NORMAL.format(x=x)})"


def eliminated(name: str, source: str, keys: list[str], n: int, sides: int, kept: list[str] = ()) -> str:
    """CTEs that end in `name`: of source (keys, a{i}_{j}, r{i}_{k}, kept), the solutions s{i}_{k} of a s = r, by
    Gauss and Jordan without exchanges of rows (for positive definite a)."""
    out, before = [], source
    for p in range(n):
        last = p == n - 1
        cols = []
        for i in range(n):
            factor = f"a{i}_{p} / a{p}_{p}"
            if not last:
                cols += [f"a{i}_{j} - {factor} * a{p}_{j} AS a{i}_{j}" if i != p else f"a{i}_{j}" for j in range(n)]
            cols += [(f"r{i}_{k} - {factor} * r{p}_{k}" if i != p else f"r{i}_{k}") + (f" AS r{i}_{k}" if not last else "") for k in range(sides)] if not last else []
        if last:  # what is left is a diagonal but for the last column
            for i in range(n):
                for k in range(sides):
                    cols.append((f"(r{i}_{k} - a{i}_{p} / a{p}_{p} * r{p}_{k}) / a{i}_{i}" if i != p else f"r{p}_{k} / a{p}_{p}") + f" AS s{i}_{k}")
        here = name if last else f"{name}_{p}"
        out.append(f"{here} AS (SELECT {', '.join([*keys, *kept, *cols])} FROM {before})")
        before = here
    return ", ".join(out)


def regression(name: str, source: str, key: str, xs: list[str], lags: int | None) -> str:
    """CTEs that end in `name` (key, n, b0.., t0.., rsq, resid_sd): OLS of y on a constant and xs of source (key, month_idx,
    y, xs) by key, with Newey-West t's whose pairs are exactly so many months apart, or plain t's (lags None)."""
    k = len(xs) + 1
    z = ["1.0", *xs]
    sums = [f"sum({z[i]} * {z[j]}) AS a{i}_{j}" for i in range(k) for j in range(k)]
    sides = [f"sum({z[i]} * y) AS r{i}_0" for i in range(k)] + [f"CAST({int(i == j)} AS DOUBLE) AS r{i}_{j + 1}" for i in range(k) for j in range(k)]
    fitted = " + ".join(f"s{i}_0 * {z[i]}" for i in range(k))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    out = [
        f"{name}_u AS (SELECT {key}, month_idx, y, {', '.join(xs)} FROM {source} WHERE {whole})",
        f"{name}_m AS (SELECT {key}, count(*) AS n, var_pop(y) * count(*) AS tss, {', '.join([*sums, *sides])} FROM {name}_u GROUP BY {key})",
        eliminated(f"{name}_s", f"{name}_m", [key], k, k + 1, ["n", "tss"]),
        f"{name}_e AS (SELECT u.*, y - ({fitted}) AS e FROM {name}_u u JOIN {name}_s USING ({key}))",
        f"{name}_r AS (SELECT {key}, sum(e * e) AS rss, stddev_samp(e) AS resid_sd FROM {name}_e GROUP BY {key})",
    ]
    if lags is None:
        var = {i: f"s{i}_{i + 1} * rss / (n - {k})" for i in range(k)}
        joined = f"{name}_s JOIN {name}_r USING ({key})"
    else:
        meat = [f"sum(CASE WHEN q.month_idx = p.month_idx THEN {zp[i]} * {zq[j]} * p.e * q.e ELSE (1 - (q.month_idx - p.month_idx) / {lags + 1}.0) * p.e * q.e * ({zp[i]} * {zq[j]} + {zq[i]} * {zp[j]}) END) AS m{i}_{j}" for zp, zq in [(["1.0", *[f"p.{x}" for x in xs]], ["1.0", *[f"q.{x}" for x in xs]])] for i in range(k) for j in range(k)]
        out.append(f"{name}_h AS (SELECT p.{key}, {', '.join(meat)} FROM {name}_e p JOIN {name}_e q ON p.{key} = q.{key} AND q.month_idx BETWEEN p.month_idx AND p.month_idx + {lags} GROUP BY p.{key})")
        var = {i: " + ".join(f"s{i}_{a + 1} * m{a}_{b} * s{b}_{i + 1}" for a in range(k) for b in range(k)) for i in range(k)}
        joined = f"{name}_s JOIN {name}_r USING ({key}) JOIN {name}_h USING ({key})"
    cols = [f"s{i}_0 AS b{i}" for i in range(k)] + [f"CASE WHEN {var[i]} > 0 THEN s{i}_0 / sqrt({var[i]}) END AS t{i}" for i in range(k)]
    out.append(f"{name} AS (SELECT {key}, n, {', '.join(cols)}, CASE WHEN tss > 0 THEN 1 - rss / tss END AS rsq, resid_sd FROM {joined})")
    return ", ".join(out)


def fama_macbeth(name: str, source: str, subsets: dict[str, list[str]]) -> str:
    """CTEs that end in `name` (subset, name, month_idx, beta): monthly regressions of y on each subset of source's columns
    (month_idx, y, columns), of months with two more rows than columns."""
    out, parts = [], []
    for label, xs in subsets.items():
        k = len(xs) + 1
        z = ["1.0", *xs]
        sums = [f"sum({z[i]} * {z[j]}) AS a{i}_{j}" for i in range(k) for j in range(k)] + [f"sum({z[i]} * y) AS r{i}_0" for i in range(k)]
        whole = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
        here = f"{name}_{label}"
        out.append(f"{here}_m AS (SELECT month_idx, {', '.join(sums)} FROM {source} WHERE {whole} GROUP BY month_idx HAVING count(*) >= {k + 1} AND {' AND '.join(f'var_pop({x}) > 0' for x in xs)})")
        out.append(eliminated(here, f"{here}_m", ["month_idx"], k, 1))
        parts += [f"SELECT '{label}' AS subset, '{x}' AS name, month_idx, s{i + 1}_0 AS beta FROM {here}" for i, x in enumerate(xs)]
    return ", ".join([*out, f"{name} AS ({' UNION ALL '.join(parts)})"])
