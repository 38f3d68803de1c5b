"""Queries of the expression language: each operator, nested ones, and the monthly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.fixtures import view, with_views
from tessella.operators.panel import to_months
from tessella.plans.compiler import describe, evaluate

#: Expression of each operator's query.
EXPRESSIONS = {
    "ratio": "RATIO(ib, che)", "add": "ADD(revt, xrd)", "sub": "SUB(revt, cogs)", "mul": "MUL(ib, 0.001)", "sumrank": "SUMRANK(ib, xrd)",
    "min": "MIN(ib, xrd)", "max": "MAX(ib, xrd)", "coalesce": "COALESCE(xrd, che)", "growth": "GROWTH(at)", "delta": "DELTA(xrd, 2)", "lag": "LAG(xrd)",
    "ma": "MA(xrd)", "vol": "VOL(ib)", "trend": "TREND(xrd)", "accel": "ACCEL(ib)", "ts_min": "TS_MIN(xrd, 3)", "ts_max": "TS_MAX(xrd, 3)", "ts_sum": "TS_SUM(xrd, 3)",
    "ts_count": "TS_COUNT(xrd, 3)", "ts_rank": "TS_RANK(xrd)", "abs": "ABS(ib)", "sign": "SIGN(ib)", "log": "LOG(ib)", "inv": "INV(che)", "neg": "NEG(ib)",
    "zscore": "ZSCORE(xrd)", "rank": "RANK(che)", "winsor": "WINSOR(ib, 5)", "indicator": "INDICATOR(ib, 1000)", "ind_adj": "IND_ADJ(xrd)", "ind_zscore": "IND_ZSCORE(ib)", "ind_rank": "IND_RANK(che)",
    "nested_profit_trend": "TREND(RATIO(SUB(revt, cogs), at), 4)",
    "nested_rank_of_growth": "RANK(GROWTH(MA(xrd, 2)))",
    "nested_industry": "IND_ZSCORE(DELTA(RATIO(ib, at)))",
    "nested_lags": "SUB(LAG(LAG(ib)), LAG(ib, 2))",
    "nested_winsor": "WINSOR(ZSCORE(RATIO(dltt, at)), 10)",
}
INFIX = "revt - cogs / at"

L = "(SELECT b.{x} FROM fx_firm_year b WHERE b.permno = a.permno AND b.year = a.year - {d})"


def _lag(x: str, d: int = 1) -> str:
    return L.format(x=x, d=d)


def _trail(agg: str, k: int) -> str:
    return f"(SELECT {agg} FROM fx_firm_year b WHERE b.permno = a.permno AND b.year BETWEEN a.year - {k - 1} AND a.year)"


def _pct(x: str, keys: tuple[str, ...]) -> str:
    """Average-tie rank share by counting, which no window of ours does."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    return f"CASE WHEN a.{x} IS NOT NULL THEN (SELECT (count(*) FILTER (b.{x} < a.{x}) + (count(*) FILTER (b.{x} = a.{x}) + 1) / 2.0) / count(b.{x}) FROM fx_firm_year b WHERE {same}) END"


def _stat(agg: str, keys: tuple[str, ...]) -> str:
    return f"(SELECT {agg} FROM fx_firm_year b WHERE " + " AND ".join(f"b.{k} = a.{k}" for k in keys) + ")"


def _z(x: str, keys: tuple[str, ...]) -> str:
    sd = _stat(f"stddev_samp(b.{x})", keys)
    return f"CASE WHEN {sd} > 1e-10 THEN (a.{x} - {_stat(f'avg(b.{x})', keys)}) / {sd} END"


_IND, _FY = ("year", "sic2"), ("form_year",)
ORACLES = {
    "ratio": "CASE WHEN abs(a.che) > 1e-10 THEN a.ib / a.che END", "add": "a.revt + a.xrd", "sub": "a.revt - a.cogs", "mul": "a.ib * 0.001",
    "sumrank": f"{_pct('ib', _FY)} + {_pct('xrd', _FY)} - 1",
    "min": "CASE WHEN a.ib <= a.xrd THEN a.ib WHEN a.ib > a.xrd THEN a.xrd END", "max": "CASE WHEN a.ib >= a.xrd THEN a.ib WHEN a.ib < a.xrd THEN a.xrd END",
    "coalesce": "CASE WHEN a.xrd IS NULL THEN a.che ELSE a.xrd END",
    "growth": f"""CASE WHEN abs({_lag('"at"')}) > 1e-10 THEN (a."at" - {_lag('"at"')}) / abs({_lag('"at"')}) END""", "delta": f"a.xrd - {_lag('xrd', 2)}", "lag": _lag("xrd"),
    "ma": _trail("avg(b.xrd)", 3), "vol": _trail("stddev_samp(b.ib)", 5), "trend": _trail("CASE WHEN count(b.xrd) >= 3 THEN regr_slope(b.xrd, CAST(b.year - 2000 AS DOUBLE)) END", 5),
    "accel": f"(a.ib - {_lag('ib')}) - ({_lag('ib')} - {_lag('ib', 2)})", "ts_min": _trail("min(b.xrd)", 3), "ts_max": _trail("max(b.xrd)", 3), "ts_sum": _trail("sum(b.xrd)", 3),
    "ts_count": f"CAST({_trail('count(b.xrd)', 3)} AS DOUBLE)",
    "ts_rank": "CASE WHEN a.xrd IS NOT NULL THEN " + _trail("CASE WHEN count(b.xrd) >= 2 THEN (count(*) FILTER (b.xrd < a.xrd) + (count(*) FILTER (b.xrd = a.xrd) + 1) / 2.0) / count(b.xrd) END", 5) + " END",
    "abs": "abs(a.ib)", "sign": "CASE WHEN a.ib > 0 THEN 1.0 WHEN a.ib < 0 THEN -1.0 WHEN a.ib = 0 THEN 0.0 END", "log": "CASE WHEN a.ib > 0 THEN ln(a.ib) END",
    "inv": "CASE WHEN abs(a.che) > 1e-10 THEN 1.0 / a.che END", "neg": "0 - a.ib", "zscore": _z("xrd", _FY), "rank": _pct("che", _FY),
    "winsor": f"CASE WHEN a.ib IS NOT NULL THEN greatest(least(a.ib, {_stat('quantile_cont(b.ib, 0.95)', _FY)}), {_stat('quantile_cont(b.ib, 0.05)', _FY)}) END",
    "indicator": "CASE WHEN a.ib > 1000 THEN 1.0 WHEN a.ib <= 1000 THEN 0.0 END", "ind_adj": f"a.xrd - {_stat('median(b.xrd)', _IND)}", "ind_zscore": _z("ib", _IND),
    "ind_rank": f"CASE WHEN a.sic2 IS NOT NULL THEN {_pct('che', _IND)} END",
}

_PM = """fx AS (SELECT *, CASE WHEN abs("at") > 1e-10 THEN (revt - cogs) / "at" END AS gp, CASE WHEN abs("at") > 1e-10 THEN ib / "at" END AS roa, CASE WHEN abs("at") > 1e-10 THEN dltt / "at" END AS lev FROM fx_firm_year)"""
_ROUND = "SELECT a.permno, a.year, a.form_year, round({}, 8) + 0.0 AS value FROM fx_firm_year a"


def _select(column) -> F.Column:
    return (F.round(column, 8) + 0.0).alias("value")


NESTED_ORACLES = {
    "nested_profit_trend": f"WITH {_PM} SELECT permno, year, form_year, round(CASE WHEN count(gp) OVER w >= 3 THEN regr_slope(gp, CAST(year - 2000 AS DOUBLE)) OVER w END, 8) + 0.0 AS value FROM fx WINDOW w AS (PARTITION BY permno ORDER BY year RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "nested_rank_of_growth": """WITH m AS (SELECT permno, year, form_year, avg(xrd) OVER (PARTITION BY permno ORDER BY year RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS ma FROM fx_firm_year),
g AS (SELECT m.*, CASE WHEN abs(p.ma) > 1e-10 THEN (m.ma - p.ma) / abs(p.ma) END AS g FROM m LEFT JOIN m p ON p.permno = m.permno AND p.year = m.year - 1)
SELECT permno, year, form_year, round(CASE WHEN g IS NOT NULL THEN (SELECT (count(*) FILTER (b.g < a.g) + (count(*) FILTER (b.g = a.g) + 1) / 2.0) / count(b.g) FROM g b WHERE b.form_year = a.form_year) END, 8) + 0.0 AS value FROM g a""",
    "nested_industry": f"""WITH {_PM}, d AS (SELECT fx.permno, fx.year, fx.form_year, fx.sic2, fx.roa - p.roa AS d FROM fx LEFT JOIN fx p ON p.permno = fx.permno AND p.year = fx.year - 1)
SELECT permno, year, form_year, round(CASE WHEN sic2 IS NOT NULL AND stddev_samp(d) OVER w > 1e-10 THEN (d - avg(d) OVER w) / stddev_samp(d) OVER w END, 8) + 0.0 AS value FROM d WINDOW w AS (PARTITION BY year, sic2)""",
    "nested_lags": f"SELECT a.permno, a.year, a.form_year, CASE WHEN EXISTS (SELECT 1 FROM fx_firm_year b WHERE b.permno = a.permno AND b.year = a.year - 1) THEN {_lag('ib', 2)} - {_lag('ib', 2)} END + 0.0 AS value FROM fx_firm_year a",
    "nested_winsor": f"""WITH {_PM}, z AS (SELECT permno, year, form_year, CASE WHEN stddev_samp(lev) OVER w > 1e-10 THEN (lev - avg(lev) OVER w) / stddev_samp(lev) OVER w END AS z FROM fx WINDOW w AS (PARTITION BY form_year)),
q AS (SELECT form_year, quantile_cont(z, 0.1) AS lo, quantile_cont(z, 0.9) AS hi FROM z GROUP BY form_year)
SELECT permno, year, form_year, round(CASE WHEN z IS NOT NULL THEN greatest(least(z, hi), lo) END, 8) + 0.0 AS value FROM z JOIN q USING (form_year)""",
}


def _dsl(text: str, **options):
    def run(spark, sf_dir):
        return evaluate(view(spark, sf_dir, "fx_firm_year"), {"value": text}, **options).select("permno", "year", "form_year", _select(F.col("value")))

    return run


def ff_timing_panel(spark, sf_dir):
    """Winsorised gross profitability of each stock-month, by the July rule."""
    signal = evaluate(view(spark, sf_dir, "fx_firm_year"), {"signal": "RATIO(SUB(revt, cogs), at)"}, winsorize_pct=1.0)
    months = to_months(view(spark, sf_dir, "fx_stock_month"), signal, ["signal"])
    return months.select("month_end", "permno", (F.round("signal", 8) + 0.0).alias("signal"))


def dsl_batch(spark, sf_dir):
    """Every operator's expression in one plan, unpivoted."""
    every = {n: e for n, e in EXPRESSIONS.items() if not n.startswith("nested")}
    wide = evaluate(view(spark, sf_dir, "fx_firm_year"), every)
    return wide.unpivot(["permno", "year"], [*every], "signal", "value").groupBy("signal").agg(F.count("value").alias("n"), (F.round(F.avg("value"), 6) + 0.0).alias("mean"))


def dsl_describe(spark, sf_dir):
    return describe(view(spark, sf_dir, "fx_firm_year"), "RATIO(xrd, at)").select(*[F.round(c, 8).alias(c) for c in ("coverage", "mean", "median", "std", "min", "max")])


def queries():
    out = {f"dsl_{n}": _dsl(e) for n, e in EXPRESSIONS.items()}
    out |= {"dsl_infix": _dsl(INFIX, infix=True), "dsl_winsor_execute": _dsl("RATIO(SUB(revt, cogs), at)", winsorize_pct=1.0)}
    return out | {f.__name__: f for f in (ff_timing_panel, dsl_batch, dsl_describe)}


def oracle_sql():
    out = {f"dsl_{n}": _ROUND.format(e) for n, e in ORACLES.items()} | {f"dsl_{n}": q for n, q in NESTED_ORACLES.items()}
    out["dsl_infix"] = _ROUND.format('a.revt - CASE WHEN abs(a."at") > 1e-10 THEN a.cogs / a."at" END')
    wins = f"{_PM}, q AS (SELECT form_year, quantile_cont(gp, 0.01) AS lo, quantile_cont(gp, 0.99) AS hi FROM fx GROUP BY form_year), w AS (SELECT permno, year, form_year, CASE WHEN gp IS NOT NULL THEN greatest(least(gp, hi), lo) END AS v FROM fx JOIN q USING (form_year))"
    out["dsl_winsor_execute"] = f"WITH {wins} SELECT permno, year, form_year, round(v, 8) + 0.0 AS value FROM w"
    out["ff_timing_panel"] = f"WITH {wins} SELECT m.month_end, m.permno, round(w.v, 8) + 0.0 AS signal FROM fx_stock_month m LEFT JOIN w ON w.permno = m.permno AND w.form_year = m.form_year"
    out["dsl_batch"] = " UNION ALL ".join(f"SELECT '{n}' AS signal, count(v) AS n, round(avg(v), 6) + 0.0 AS mean FROM (SELECT {e} AS v FROM fx_firm_year a)" for n, e in ORACLES.items())
    x = 'CASE WHEN abs("at") > 1e-10 THEN xrd / "at" END'
    out["dsl_describe"] = f"SELECT round(count(x) / count(*), 8) AS coverage, round(avg(x), 8) AS mean, round(median(x), 8) AS median, round(stddev_samp(x), 8) AS std, round(min(x), 8) AS min, round(max(x), 8) AS max FROM (SELECT {x} AS x FROM fx_firm_year)"
    return {n: with_views(q) for n, q in out.items()}
