"""Queries of the assay layer and of run analytics, each with its oracle."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import functions as F

from tessella import sql_linear as L
from tessella.fixtures import view, with_views
from tessella.operators import assay as A
from tessella.operators import evaluator, runs
from tessella.operators import panel as P
from tessella.operators import regression as R
from tessella.plans.catalog import VARIABLES
from tessella.queries_panel import _FMB, _PCT, FIRST, SG, TWO, _factors, _r, nw_sql, signals

Q, O = {}, {}


def query(sql: str | None):
    """Registers a query with its oracle."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql)
        return f

    return keep


# P-values are taken as data where an engine has no normal distribution: exp(-|t|) of recorded signals.
_P = "WITH ev AS (SELECT * FROM fx_evaluated WHERE error IS NULL AND fmb_tstat IS NOT NULL), p AS (SELECT run, signal_no AS pos, round(exp(-abs(fmb_tstat)), 12) AS p FROM ev), r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY run) AS m FROM p WINDOW w AS (PARTITION BY run ORDER BY p, pos)), h AS (SELECT *, (SELECT sum(1.0 / i) FROM generate_series(1, m) g(i)) AS c FROM r)"


def _adjusted(spark, sf_dir):
    ev = view(spark, sf_dir, "fx_evaluated").where("error IS NULL AND fmb_tstat IS NOT NULL")
    return A.adjusted(ev.select("run", F.col("signal_no").alias("pos"), F.round(F.exp(-F.abs("fmb_tstat")), 12).alias("p_value")), keys=("run",))


@query(f"{_P} SELECT run, pos, round(least(p * m, 1.0), 8) AS bonf_adj_p, p * m <= 0.05 AS bonf_reject FROM r")
def bonferroni(spark, sf_dir):
    return _adjusted(spark, sf_dir).select("run", "pos", F.round("bonf_adj_p", 8).alias("bonf_adj_p"), "bonf_reject")


@query(f"{_P} SELECT run, pos, rank, round(least((SELECT max((q.m - q.rank + 1) * q.p) FROM r q WHERE q.run = r.run AND q.rank <= r.rank), 1.0), 8) AS holm_adj_p FROM r")
def holm(spark, sf_dir):
    return _adjusted(spark, sf_dir).select("run", "pos", F.col("rank").cast("long").alias("rank"), F.round("holm_adj_p", 8).alias("holm_adj_p"))


@query(f"""{_P} SELECT run, pos, round(rank / (m * c) * 0.05, 10) AS bhy_critical, rank <= ifnull((SELECT max(q.rank) FROM h q WHERE q.run = h.run AND q.p <= q.rank / (q.m * q.c) * 0.05), 0) AS bhy_reject,
round(least((SELECT min(q.m * q.c / q.rank * q.p) FROM h q WHERE q.run = h.run AND q.rank >= h.rank), 1.0), 8) AS bhy_adj_p FROM h""")
def bhy(spark, sf_dir):
    return _adjusted(spark, sf_dir).select("run", "pos", F.round("bhy_critical", 10).alias("bhy_critical"), "bhy_reject", F.round("bhy_adj_p", 8).alias("bhy_adj_p"))


_BY = ", ".join(f"round(exp(-t * t / 2) * {(1 - p) / p!r} / (1 + exp(-t * t / 2) * {(1 - p) / p!r}), 8) AS bayes_p_{round(p * 100):03d}" for p in A.PRIORS)


@query(f"SELECT signal_no, {_BY}, round(CASE WHEN p <= 0 THEN 0.0 WHEN p >= 1 THEN 1.0 ELSE -{math.e!r} * p * ln(p) END, 8) AS sd_mbf FROM (SELECT signal_no, fmb_tstat AS t, round(exp(-abs(fmb_tstat)), 12) AS p FROM fx_evaluated WHERE fmb_tstat IS NOT NULL)")
def bayes(spark, sf_dir):
    ev = view(spark, sf_dir, "fx_evaluated").where("fmb_tstat IS NOT NULL").select("signal_no", F.col("fmb_tstat").alias("t_stat"))
    out = A.bayesian_report(ev).withColumn("sd_mbf", A.sd_bayes_factor(F.round(F.exp(-F.abs("t_stat")), 12)))
    return out.select("signal_no", *[F.round(c, 8).alias(c) for c in ("bayes_p_005", "bayes_p_020", "bayes_p_050", "sd_mbf")])


@query(f"SELECT signal_no, round({L.two_sided_p('fmb_tstat')}, 8) + 0.0 AS p_value FROM fx_evaluated WHERE fmb_tstat IS NOT NULL")
def p_values(spark, sf_dir):
    ev = view(spark, sf_dir, "fx_evaluated").where("fmb_tstat IS NOT NULL")
    return ev.select("signal_no", (F.round(A.two_sided_p("fmb_tstat"), 8) + 0.0).alias("p_value"))


@query(f"""{_P}, n AS (SELECT any_value(m) AS m, count(*) FILTER (p * m <= 0.05) AS n_reject_bonf, any_value(c) AS c FROM h WHERE run = 'run0'),
ho AS (SELECT count(*) AS n_reject_holm FROM h x WHERE run = 'run0' AND (SELECT max((q.m - q.rank + 1) * q.p) FROM h q WHERE q.run = 'run0' AND q.rank <= x.rank) <= 0.05), bh AS (SELECT ifnull(max(rank), 0) AS n_reject_bhy FROM h WHERE run = 'run0' AND p <= rank / (m * c) * 0.05)
SELECT m, n_reject_bonf, n_reject_holm, n_reject_bhy, round(0.05 / m, 10) AS bonf_p, CASE WHEN n_reject_bhy > 0 THEN round(0.05 * n_reject_bhy / (m * c), 10) END AS bhy_p FROM n, ho, bh""")
def testing_summary(spark, sf_dir):
    """Hurdles in t, told by the p-values that belong to them."""
    told = A.testing_summary(_adjusted(spark, sf_dir).where("run = 'run0'"))
    rows = spark.createDataFrame([{k: float(v) if k.endswith("_t") else v for k, v in told.items()}])
    p = lambda c: F.when(~F.isnan(c), F.round(A.two_sided_p(c), 10))
    return rows.select("m", "n_reject_bonf", "n_reject_holm", "n_reject_bhy", p("bonf_t").alias("bonf_p"), p("bhy_t").alias("bhy_p"))


@query(" UNION ALL ".join(f"SELECT CAST({p!r} AS DOUBLE) AS prior, round(sqrt(-2 * ln(0.05 / 0.95 / ((1 - {p!r}) / {p!r}))), 8) AS required_t" for p in A.PRIORS))
def required_t(spark, sf_dir):
    """By bisection; the closed form is the oracle's."""
    return spark.createDataFrame([(p, A.required_t(p)) for p in A.PRIORS], "prior double, required_t double").withColumn("required_t", F.round("required_t", 8))


#: Periods that the test tables' months reach.
PERIODS = {"full": (None, None), "early": ("1995-01", "1998-06"), "late": ("1998-07", None), "short": ("2001-01", "2001-12"), "ex_recession": "ex_recession"}
_TAG = "SELECT {c}, 'full' AS label FROM {t} UNION ALL SELECT {c}, 'early' FROM {t} WHERE month_idx BETWEEN 1995 * 12 + 1 AND 1998 * 12 + 6 UNION ALL SELECT {c}, 'late' FROM {t} WHERE month_idx >= 1998 * 12 + 7 UNION ALL SELECT {c}, 'short' FROM {t} WHERE month_idx BETWEEN 2001 * 12 + 1 AND 2001 * 12 + 12 UNION ALL SELECT {c}, 'ex_recession' FROM {t} WHERE NOT month_idx BETWEEN 2001 * 12 + 3 AND 2001 * 12 + 11"


def _betas(spark, sf_dir):
    panel = signals(spark, sf_dir)
    return panel, R.univariate_betas(panel)


@query(f"""{_FMB}, tg AS ({_TAG.format(c='month_idx, beta', t='bt')}), {nw_sql('tg', 'label')}, mo AS (SELECT DISTINCT month_idx FROM sg), mt AS ({_TAG.format(c='month_idx', t='mo')}), mc AS (SELECT label, count(*) AS n_months FROM mt GROUP BY label)
SELECT label, n_months, CASE WHEN n_months >= 24 THEN round(tstat, 6) + 0.0 END AS tstat, CASE WHEN n_months >= 24 AND tstat IS NOT NULL THEN 'ok' ELSE 'not_estimable' END AS status FROM mc LEFT JOIN nw USING (label)""")
def subsample_ts(spark, sf_dir):
    panel, betas = _betas(spark, sf_dir)
    return A.subsamples(panel, betas, PERIODS).select("label", "n_months", _r("tstat", 6), "status")


@query(f"""{_FMB}, sp AS (SELECT min(month_idx) AS a, max(month_idx) AS b FROM sg), st AS (SELECT CAST((s - a) / 6 AS INT) AS win, CAST(s AS INT) AS start FROM sp, generate_series((SELECT min(month_idx) FROM sg), (SELECT max(month_idx) FROM sg) - 23, 6) g(s)),
wn AS (SELECT st.win, bt.month_idx, bt.beta FROM st JOIN bt ON bt.month_idx > st.start AND bt.month_idx < st.start + 24), {nw_sql('wn', 'win')}
SELECT st.win, st.start + 12 AS centre, round(tstat, 6) + 0.0 AS tstat FROM st LEFT JOIN nw USING (win)""")
def decay_windows(spark, sf_dir):
    panel, betas = _betas(spark, sf_dir)
    return A.decay_windows(panel, betas, 24, 6).select(F.col("win").cast("int").alias("win"), F.col("centre").cast("int").alias("centre"), _r("tstat", 6))


_DW = f"""{_FMB}, sp AS (SELECT min(month_idx) AS a, max(month_idx) AS b FROM sg), st AS (SELECT CAST((s - a) / 6 AS INT) AS win, CAST(s AS INT) AS start FROM sp, generate_series((SELECT min(month_idx) FROM sg), (SELECT max(month_idx) FROM sg) - 23, 6) g(s)),
wn AS (SELECT st.win, bt.month_idx, bt.beta FROM st JOIN bt ON bt.month_idx > st.start AND bt.month_idx < st.start + 24), {nw_sql('wn', 'win')}"""
_DT = f"dt AS (SELECT 1 AS one, row_number() OVER (ORDER BY win) AS month_idx, abs(tstat) AS y, CAST(win AS DOUBLE) AS x FROM nw WHERE tstat IS NOT NULL), {L.regression('tr', 'dt', 'one', ['x'], 3)}"


@query(f"{_DW}, {_DT} SELECT round(b1, 8) + 0.0 AS slope, round(t1, 5) + 0.0 AS tstat, CASE WHEN t1 > 1.96 THEN 'strengthening' WHEN t1 < -1.96 THEN 'decaying' ELSE 'stable' END AS classification FROM tr WHERE n >= 12 UNION ALL SELECT NULL, NULL, 'insufficient_data' FROM tr WHERE n < 12")
def decay_trend(spark, sf_dir):
    panel, betas = _betas(spark, sf_dir)
    told = A.decay_trend(A.decay_windows(panel, betas, 24, 6), 24, 6)
    rows = spark.createDataFrame([(told["slope"], told["tstat"], told["classification"])], "slope double, tstat double, classification string")
    return rows.select(*[F.when(~F.isnan(c), F.round(c, d) + 0.0).alias(c) for c, d in (("slope", 8), ("tstat", 5))], "classification")


THREE = {**TWO, "turn": "RATIO(che, at)"}


def _ranked(spark, sf_dir, names=THREE):
    panel = signals(spark, sf_dir, **names)
    for n in names:
        panel = P.cross_rank(panel, n)
    return panel


_C = f"""{SG}, th AS (SELECT month_idx, permno, signal, lev, round(CASE WHEN abs(f."at") > 1e-10 THEN f.che / f."at" END, 8) AS turn FROM sg LEFT JOIN fx_firm_year f USING (permno, form_year)),
un AS (SELECT month_idx, permno, 'signal' AS name, signal AS v FROM th UNION ALL SELECT month_idx, permno, 'lev', lev FROM th UNION ALL SELECT month_idx, permno, 'turn', turn FROM th),
rk AS (SELECT month_idx, permno, name, (rank() OVER (PARTITION BY name, month_idx ORDER BY v) + (count(*) OVER (PARTITION BY name, month_idx, v) - 1) / 2.0) / count(*) OVER (PARTITION BY name, month_idx) - 0.5 AS v FROM un WHERE v IS NOT NULL),
mo AS (SELECT month_idx FROM (SELECT month_idx, row_number() OVER (ORDER BY month_idx) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT month_idx FROM sg)) WHERE n <= 60 OR i % 12 = 0)"""


@query(f"""{_C}, c AS (SELECT x.name AS a, y.name AS b, x.month_idx, count(*) AS n, corr(x.v, y.v) AS r FROM rk x JOIN rk y USING (month_idx, permno) JOIN mo USING (month_idx) WHERE (x.name, y.name) IN (('signal', 'lev'), ('signal', 'turn'), ('lev', 'turn')) GROUP BY ALL)
SELECT a, b, count(*) FILTER (n >= 31) AS n_months, CASE WHEN count(*) FILTER (n >= 31) >= 3 THEN round(avg(r) FILTER (n >= 31), 8) + 0.0 END AS corr FROM c GROUP BY a, b""")
def corr_matrix(spark, sf_dir):
    return A.correlation_matrix(_ranked(spark, sf_dir), [*THREE]).select("a", "b", "n_months", _r("corr"))


@query(f"""{_C}, m6 AS (SELECT month_idx FROM (SELECT month_idx, row_number() OVER (ORDER BY month_idx) - 1 AS i FROM (SELECT DISTINCT month_idx FROM sg)) WHERE i % 6 = 0),
c AS (SELECT y.name AS control, x.month_idx, count(*) AS n, corr(x.v, y.v) AS r FROM rk x JOIN rk y USING (month_idx, permno) JOIN m6 USING (month_idx) WHERE x.name = 'signal' AND y.name <> 'signal' GROUP BY ALL HAVING count(*) >= 30)
SELECT control, count(*) AS n_months, round(avg(r), 8) + 0.0 AS corr FROM c GROUP BY control""")
def spanning_corr(spark, sf_dir):
    return A.spanning_correlations(signals(spark, sf_dir, **THREE), "signal", ["lev", "turn"], every=6).select("control", "n_months", _r("corr"))


_NAMES = ["signal", "lev", "turn"]
_SETS = {"123": _NAMES, "12": ["signal", "lev"], "13": ["signal", "turn"], "23": ["lev", "turn"], "1": ["signal"], "2": ["lev"], "3": ["turn"]}
_WIDE = f"{_C}, wd AS (SELECT month_idx, permno, {', '.join(f"max(v) FILTER (name = '{n}') AS {n}" for n in _NAMES)} FROM rk GROUP BY month_idx, permno)"
_RACE = f"xr AS (SELECT a.month_idx, a.ret AS y, b.signal, b.lev, b.turn FROM sg a JOIN wd b ON b.permno = a.permno AND b.month_idx = a.month_idx - 1 WHERE a.ret IS NOT NULL)"


def _without(alive: str, name: str) -> str:
    return f"replace({alive}, CASE {name} WHEN 'signal' THEN '1' WHEN 'lev' THEN '2' ELSE '3' END, '')"


def _race_sql() -> str:
    """Backward elimination over the t's of all subsets; the fixture's signals are no near-duplicates."""
    steps = ["z0 AS (SELECT '123' AS alive, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS VARCHAR) AS why)"]
    for i in range(3):
        steps.append(f"w{i} AS (SELECT tt.* FROM tt JOIN z{i} ON tt.subset = z{i}.alive ORDER BY tstat, CASE name WHEN 'signal' THEN 1 WHEN 'lev' THEN 2 ELSE 3 END LIMIT 1)")
        steps.append(f"z{i + 1} AS (SELECT CASE WHEN w.tstat <= 0.5 THEN {_without('z.alive', 'w.name')} ELSE z.alive END AS alive, CASE WHEN w.tstat <= 0.5 THEN w.name END AS gone, CASE WHEN w.tstat <= 0 THEN 'conditional_sign_mismatch' WHEN w.tstat <= 0.5 THEN 'conditional_t_below_threshold' END AS why FROM z{i} z LEFT JOIN w{i} w ON TRUE)")
    gone = " UNION ALL ".join(f"SELECT gone, why FROM z{i} WHERE gone IS NOT NULL" for i in (1, 2, 3))
    return f"{', '.join(steps)}, gn AS ({gone})"


@query(f"""{_WIDE}, {_RACE}, {L.fama_macbeth('fs', 'xr', _SETS)}, fk AS (SELECT subset || ':' || name AS key, month_idx, beta FROM fs), {nw_sql('fk', 'key')}, tt AS (SELECT split_part(key, ':', 1) AS subset, split_part(key, ':', 2) AS name, tstat FROM nw), {_race_sql()}
SELECT name AS signal, round(tstat, 5) + 0.0 AS conditional_t, gn.gone IS NULL AS survives, gn.why AS dropped FROM tt LEFT JOIN gn ON gn.gone = tt.name WHERE subset = '123'""")
def horse_race(spark, sf_dir):
    got = A.horse_race(_ranked(spark, sf_dir), dict.fromkeys(THREE, "positive"), threshold=0.5)
    rows = [(n, t if math.isfinite(t) else None, n in got.survivors, got.dropped.get(n)) for n, t in got.conditional_t.items()]
    return spark.createDataFrame(rows, "signal string, conditional_t double, survives boolean, dropped string").withColumn("conditional_t", F.round("conditional_t", 5) + 0.0)


_RAW = f"""{_C}, wd AS (SELECT month_idx, permno, {', '.join(f"max(v) FILTER (name = '{n}') AS {n}" for n in _NAMES)} FROM un GROUP BY month_idx, permno)"""


@query(f"""{_RAW}, {_RACE}, {L.fama_macbeth('fs', 'xr', {"123": _NAMES, "1": ["signal"]})}, fk AS (SELECT subset AS key, month_idx, beta FROM fs WHERE name = 'signal'), {nw_sql('fk', 'key')},
m6 AS (SELECT month_idx FROM (SELECT month_idx, row_number() OVER (ORDER BY month_idx) - 1 AS i FROM (SELECT DISTINCT month_idx FROM sg)) WHERE i % 6 = 0),
cm AS (SELECT y.name AS control, x.month_idx, corr(x.v, y.v) AS r FROM rk x JOIN rk y USING (month_idx, permno) JOIN m6 USING (month_idx) WHERE x.name = 'signal' AND y.name <> 'signal' GROUP BY ALL HAVING count(*) >= 30),
sh AS (SELECT y.name AS control FROM rk y JOIN m6 USING (month_idx) WHERE y.name <> 'signal' GROUP BY 1 HAVING count(DISTINCT month_idx) >= 6 AND count(DISTINCT permno) >= 50),
cr AS (SELECT control, avg(r) AS r FROM cm SEMI JOIN sh USING (control) GROUP BY control), ok AS (SELECT count(*) > 0 AS ok FROM cr), vm AS (SELECT count(*) AS n FROM (SELECT month_idx FROM (SELECT a.month_idx FROM wd a JOIN sg b ON b.permno = a.permno AND b.month_idx = a.month_idx + 1 WHERE b.ret IS NOT NULL AND a.signal IS NOT NULL AND a.lev IS NOT NULL AND a.turn IS NOT NULL) GROUP BY month_idx HAVING count(*) >= 5))
SELECT CASE WHEN any_value(ok) THEN 'ok' ELSE 'not_estimable' END AS status, CASE WHEN NOT any_value(ok) THEN 'no_overlapping_controls' END AS reason, ifnull((SELECT string_agg(control, ',' ORDER BY abs(r) DESC, control) FROM cr), '') AS controls,
round(max(tstat) FILTER (key = '1' AND ok), 5) + 0.0 AS t_univariate, round(max(tstat) FILTER (key = '123' AND ok), 5) + 0.0 AS t_conditional, CASE WHEN any_value(ok) THEN (SELECT n FROM vm) ELSE 0 END AS valid_months, ifnull(max(tstat) FILTER (key = '123' AND ok) > 1.96, false) AS survives_196 FROM nw, ok""")
def spanning(spark, sf_dir):
    s = A.spanning_test(signals(spark, sf_dir, **THREE), "signal", ["lev", "turn"], every=6)
    rows = [(s.status, s.reason, ",".join(s.controls), s.t_univariate, s.t_conditional, s.valid_months, s.survives_196)]
    return spark.createDataFrame(rows, "status string, reason string, controls string, t_univariate double, t_conditional double, valid_months long, survives_196 boolean").withColumns({c: F.when(~F.isnan(c), F.round(c, 5) + 0.0) for c in ("t_univariate", "t_conditional")})


@query(f"""{_RAW}, g AS (SELECT month_idx, count(*) AS n, var_pop(signal) AS vs, var_pop(lev) AS vl, var_pop(turn) AS vt FROM wd WHERE signal IS NOT NULL AND lev IS NOT NULL AND turn IS NOT NULL AND month_idx < (SELECT max(month_idx) FROM sg) GROUP BY month_idx)
SELECT count(*) FILTER (n >= 5) AS coverage, count(*) FILTER (n >= 5 AND vs > 0 AND vl > 0 AND vt > 0) AS nonzero_variance FROM g""")
def design_diagnostics(spark, sf_dir):
    d = A.design_diagnostics(signals(spark, sf_dir, **THREE), ["signal", "lev", "turn"])
    return spark.createDataFrame([(d["coverage"], d["nonzero_variance"])], "coverage long, nonzero_variance long")


@query(None)
def double_bootstrap(spark, sf_dir):
    panel = signals(spark, sf_dir, **THREE).unpivot(["month_idx", "permno", "ret"], [*THREE], "signal_id", "signal")
    _, matrix = A.beta_matrix(R.univariate_betas(panel, keys=("signal_id",)))
    return A.double_bootstrap(spark, matrix, 1 / 3, n_rank=16, n_eval=20)


@contextmanager
def _evaluator(spark, sf_dir):
    """An evaluator whose stock-months are kept while the block runs; its factors are theirs."""
    with evaluator.held(view(spark, sf_dir, "fx_stock_month").repartition("permno")) as (months,):
        yield evaluator.Evaluator(view(spark, sf_dir, "fx_firm_year"), months, _factors(spark, sf_dir, months), ["Mkt-RF", "SMB"], first_month=FIRST)


def _evaluated_sql(raw: str) -> str:
    """CTEs from a raw signal over fx_firm_year to the evaluator's figures: ev (coverage, ls_alpha, ls_talpha, ls_sharpe, q1..q5, fmb_tstat)."""
    return f"""WITH rw AS (SELECT permno, form_year, {raw} AS x FROM fx_firm_year f), qb AS (SELECT form_year, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM rw GROUP BY form_year),
sg AS (SELECT m.*, CASE WHEN x IS NOT NULL THEN greatest(least(x, hi), lo) END AS signal FROM fx_stock_month m LEFT JOIN rw USING (permno, form_year) LEFT JOIN qb USING (form_year)),
b AS (SELECT greatest(min(month_idx) FILTER (ret IS NOT NULL), min(month_idx) FILTER (me IS NOT NULL), {FIRST}) AS lo, least(max(month_idx) FILTER (ret IS NOT NULL), max(month_idx) FILTER (me IS NOT NULL)) AS hi FROM sg),
ok AS (SELECT permno FROM sg GROUP BY permno HAVING count(ret) > 0 AND count(me) > 0),
sm AS (SELECT sg.*, siccd >= 6000 AND siccd < 7000 AS fin FROM sg, b WHERE month_idx BETWEEN lo AND hi AND permno IN (SELECT permno FROM ok)),
rk AS (SELECT *, {_PCT.format(x="signal")} - 0.5 AS r, count(signal) OVER (PARTITION BY month_idx) > 0 AS anysig FROM sm), c AS (SELECT month_idx, quantile_cont(me, 0.1) FILTER (nyse) AS cutoff FROM sm GROUP BY month_idx),
pr AS (SELECT rk.* EXCLUDE (signal), CASE WHEN anysig AND NOT fin AND me IS NOT NULL AND me > cutoff THEN ifnull(r, 0) END AS signal FROM rk JOIN c USING (month_idx)),
v AS (SELECT month_idx, count(signal) AS valid, count(signal) FILTER (nyse) AS base, quantile_cont(signal, [0.2, 0.4, 0.6, 0.8]) FILTER (nyse) AS pts FROM pr GROUP BY month_idx), bp AS (SELECT month_idx, pts FROM v WHERE valid >= 5 AND base >= 3),
pf AS (SELECT pr.*, CASE WHEN signal IS NOT NULL AND pts IS NOT NULL THEN 1 + (signal >= pts[1])::INT + (signal >= pts[2])::INT + (signal >= pts[3])::INT + (signal >= pts[4])::INT END AS ptf FROM pr LEFT JOIN bp USING (month_idx)),
vw AS (SELECT a.month_idx, b.ptf, sum(b.me * a.ret) / sum(b.me) AS ret FROM pf a JOIN pf b ON b.permno = a.permno AND b.month_idx = a.month_idx - 1 WHERE a.ret IS NOT NULL AND b.ptf IS NOT NULL AND b.me IS NOT NULL GROUP BY a.month_idx, b.ptf),
ls AS (SELECT month_idx, max(ret) FILTER (ptf = 5) - max(ret) FILTER (ptf = 1) AS y FROM vw GROUP BY month_idx), yf AS (SELECT 'LS' AS ptf, month_idx, y, mktrf, smb FROM ls JOIN fx_factor_month USING (month_idx)), {L.regression('fr', 'yf', 'ptf', ['mktrf', 'smb'], 6)},
x AS (SELECT a.month_idx, a.ret, b.signal AS x FROM pr a JOIN pr b ON b.permno = a.permno AND b.month_idx = a.month_idx - 1 WHERE a.ret IS NOT NULL AND b.signal IS NOT NULL), bt AS (SELECT month_idx, regr_slope(ret, x) AS beta FROM x GROUP BY month_idx HAVING count(*) >= 3 AND var_pop(x) > 0), {nw_sql('bt')},
ev AS (SELECT (SELECT count(signal) / ((max(month_idx) - min(month_idx) + 1) * count(DISTINCT permno)) FROM sm) AS coverage, b0 * 12 AS ls_alpha, t0 AS ls_talpha, (SELECT avg(y) * 12 / (stddev_samp(y) * sqrt(12)) FROM yf) AS ls_sharpe, (SELECT tstat FROM nw) AS fmb_tstat, (SELECT avg(ret) * 1200 FROM vw WHERE ptf = 1) AS q1, (SELECT avg(ret) * 1200 FROM vw WHERE ptf = 5) AS q5 FROM fr)"""


_EXPRESSIONS = {"RATIO(SUB(revt, cogs), at)": 'CASE WHEN abs("at") > 1e-10 THEN (revt - cogs) / "at" END', "RATIO(xrd, at)": 'CASE WHEN abs("at") > 1e-10 THEN xrd / "at" END'}
_FIGURES = "round(coverage, 8) AS coverage, round(ls_alpha, 6) + 0.0 AS ls_alpha, round(ls_talpha, 3) + 0.0 AS ls_talpha, round(ls_sharpe, 4) + 0.0 AS ls_sharpe, round(q1, 5) + 0.0 AS q1, round(q5, 5) + 0.0 AS q5, round(fmb_tstat, 4) + 0.0 AS fmb_tstat"


def _figures(spark, results):
    rows = [(r.expression, r.coverage, r.ls_alpha, r.ls_talpha, r.ls_sharpe, *((r.quintiles[0], r.quintiles[4]) if r.quintiles else (None, None)), r.fmb_tstat, r.error) for r in results]
    df = spark.createDataFrame(rows, "expression string, coverage double, ls_alpha double, ls_talpha double, ls_sharpe double, q1 double, q5 double, fmb_tstat double, error string")
    digits = {"coverage": 8, "ls_alpha": 6, "ls_talpha": 3, "ls_sharpe": 4, "q1": 5, "q5": 5, "fmb_tstat": 4}
    return df.select("expression", *[_r(c, d) for c, d in digits.items()], "error")


@query(f"{_evaluated_sql(_EXPRESSIONS['RATIO(SUB(revt, cogs), at)'])} SELECT 'RATIO(SUB(revt, cogs), at)' AS expression, {_FIGURES}, CAST(NULL AS VARCHAR) AS error FROM ev")
def evaluate_signal(spark, sf_dir):
    with _evaluator(spark, sf_dir) as ev:
        return _figures(spark, [ev.evaluate("RATIO(SUB(revt, cogs), at)")])


@query(f"{_evaluated_sql(_EXPRESSIONS['RATIO(xrd, at)'])} SELECT 'RATIO(xrd, at)' AS expression, {_FIGURES}, false AS failed FROM ev UNION ALL SELECT 'RATIO(xrd)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true UNION ALL SELECT 'NOSUCH(at)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, true")
def evaluate_batch(spark, sf_dir):
    """A generation as one batch: signals that can't be compiled are results of their own, and don't hold up the others."""
    with _evaluator(spark, sf_dir) as ev:
        out = _figures(spark, ev.evaluate_all(["RATIO(xrd, at)", "RATIO(xrd)", "NOSUCH(at)"]))
    return out.withColumn("failed", F.col("error").isNotNull()).drop("error")


# Run analytics.
_OUT = "CASE WHEN error IS NOT NULL THEN 'error' WHEN fmb_tstat IS NULL THEN 'invalid' WHEN abs(fmb_tstat) <= 1.96 THEN 'weak' WHEN (fmb_tstat > 0) = (expected_sign = 'positive') THEN 'correct' ELSE 'wrong_sign' END"
_EV = f"WITH e AS (SELECT *, {_OUT} AS o, CASE WHEN expected_sign = 'negative' THEN -fmb_tstat ELSE fmb_tstat END AS ts FROM fx_evaluated)"


def _ev(spark, sf_dir):
    return view(spark, sf_dir, "fx_evaluated")


@query(f"{_EV} SELECT run, count(*) AS evaluated, count(*) FILTER (o = 'error') AS errors, count(*) FILTER (o = 'invalid') AS invalid, count(*) FILTER (o = 'wrong_sign') AS wrong_sign, count(*) FILTER (o = 'weak') AS weak, count(*) FILTER (o = 'correct') AS correct, round(count(*) FILTER (o = 'correct') / count(*), 8) AS hit_rate FROM e GROUP BY ROLLUP (run)")
def funnel(spark, sf_dir):
    out = runs.funnel(_ev(spark, sf_dir))
    return out.withColumn("hit_rate", F.round("hit_rate", 8))


@query(f"{_EV} SELECT run, generation, count(*) AS n, round(count(*) FILTER (ts > 1.96) / count(*), 8) AS rate, max(ts) AS best FROM e WHERE o NOT IN ('error', 'invalid') GROUP BY run, generation")
def generation_dynamics(spark, sf_dir):
    return runs.generations(_ev(spark, sf_dir)).withColumn("rate", F.round("rate", 8))


@query(f"{_EV} SELECT run, count(*) FILTER (o = 'correct') AS first_pass, count(*) FILTER (o = 'correct' AND ts > 2.5) AS strong, count(*) FILTER (o = 'correct' AND ts > 2.5 AND generation >= 3) AS late, count(*) FILTER (o = 'correct' AND ts > 2.5 AND generation >= 3 AND mechanism = 'purchase') AS purchase FROM e GROUP BY run")
def gates(spark, sf_dir):
    t = F.when(F.col("expected_sign") == "negative", -F.col("fmb_tstat")).otherwise(F.col("fmb_tstat"))
    return runs.cumulative_gates(_ev(spark, sf_dir), {"first_pass": runs.outcome() == "correct", "strong": t > 2.5, "late": F.col("generation") >= 3, "purchase": F.col("mechanism") == "purchase"})


_J = "s AS (SELECT DISTINCT pair AS t, run AS g, CAST(abs(fmb_tstat) * 4 AS INT) AS x FROM fx_evaluated WHERE fmb_tstat IS NOT NULL)"


@query(f"""WITH {_J}, n AS (SELECT t, g, count(*) AS n FROM s GROUP BY t, g), p AS (SELECT a.t, a.g AS a, b.g AS b, a.n AS na, b.n AS nb, (SELECT count(*) FROM s x JOIN s y ON x.t = y.t AND x.x = y.x WHERE x.t = a.t AND x.g = a.g AND y.g = b.g) AS c FROM n a JOIN n b ON a.t = b.t AND a.g < b.g)
SELECT a, b, CAST(sum(c) AS BIGINT) AS overlap, round(avg(c / (na + nb - c)), 8) AS jaccard FROM p GROUP BY a, b""")
def jaccard(spark, sf_dir):
    items = _ev(spark, sf_dir).where("fmb_tstat IS NOT NULL").withColumn("x", F.round(F.abs("fmb_tstat") * 4).cast("int"))
    return runs.jaccard(items, "run", "x", "pair").withColumn("jaccard", F.round("jaccard", 8))


@query(f"WITH {_J}, r AS (SELECT x, count(DISTINCT g) AS n_groups FROM s GROUP BY x) SELECT n_groups, count(*) AS n_items FROM r GROUP BY n_groups")
def recurrence(spark, sf_dir):
    items = _ev(spark, sf_dir).where("fmb_tstat IS NOT NULL").withColumn("x", F.round(F.abs("fmb_tstat") * 4).cast("int"))
    return runs.recurrence(items, "run", "x")


@query("WITH c AS (SELECT run, mechanism, count(*) AS c FROM fx_evaluated WHERE mechanism <> 'view' GROUP BY run, mechanism) SELECT run, count(*) AS n_categories, round(sum(c * c) / (sum(c) * sum(c)), 8) AS hhi FROM c GROUP BY run")
def hhi(spark, sf_dir):
    return runs.concentration(_ev(spark, sf_dir), "run", "mechanism", ("view",)).withColumn("hhi", F.round("hhi", 8))


@query(f"""{_EV}, r AS (SELECT pair, avg(CAST(o = 'correct' AS INT)) FILTER (run = 'run0') AS a, avg(CAST(o = 'correct' AS INT)) FILTER (run = 'run1') AS b FROM e GROUP BY pair),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM r WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS n, round(corr(ra, rb), 8) + 0.0 AS spearman FROM k""")
def spearman_tasks(spark, sf_dir):
    return runs.task_spearman(_ev(spark, sf_dir), "run0", "run1").select("n", _r("spearman"))


@query(f"{_EV} SELECT run, signal_no, ts AS t_signed FROM e WHERE o NOT IN ('error', 'invalid') QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts DESC, signal_no) <= 3")
def top_survivors(spark, sf_dir):
    return runs.top_per_run(runs.signed_t(_ev(spark, sf_dir)), [F.desc("t_signed"), F.asc("signal_no")]).select("run", "signal_no", "t_signed")


@query(f"{_EV} SELECT CASE o WHEN 'correct' THEN 'supporting' WHEN 'weak' THEN 'opposing_weak' WHEN 'wrong_sign' THEN 'opposing_wrong_sign' ELSE 'realization_failure' END AS evidence, count(*) AS n FROM e GROUP BY 1")
def evidence_outcomes(spark, sf_dir):
    return _ev(spark, sf_dir).groupBy(runs.evidence_outcome().alias("evidence")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda x: x IN (%s)))) AS v FROM conversations) SELECT conv_id, turn, array_to_string(v, ',') AS variables FROM t""" % ", ".join(f"'{v}'" for v in sorted(VARIABLES)))
def token_varsets(spark, sf_dir):
    df = runs.variables_used(view(spark, sf_dir, "conversations"), "text", sorted(VARIABLES))
    return df.select("conv_id", "turn", F.array_join("variables", ",").alias("variables"))


@query("""WITH a AS (SELECT signal_no, 0 AS part FROM fx_evaluated WHERE run = 'run0'), b AS (SELECT signal_no, 1 AS part FROM fx_evaluated WHERE generation < 5), u AS (SELECT *, signal_no % 1000 AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT k, signal_no FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY part, signal_no) = 1""")
def union_first_wins(spark, sf_dir):
    ev = _ev(spark, sf_dir).select("signal_no", "run", "generation").withColumn("k", F.col("signal_no") % 1000)
    return runs.ordered_union(ev.where("run = 'run0'"), ev.where("generation < 5"), F.col("k"), "signal_no").select("k", "signal_no")


@query("SELECT signal_no, 'new' AS v FROM fx_evaluated WHERE generation = 1 UNION ALL SELECT signal_no, 'old' FROM fx_evaluated WHERE run = 'run1' AND generation <> 1")
def resume_merge(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    return runs.merged(ev.where("run = 'run1'").select("signal_no", F.lit("old").alias("v")), ev.where("generation = 1").select("signal_no", F.lit("new").alias("v")), "signal_no")


@query(f"""{SG}, b AS (SELECT month_idx, me FROM sg WHERE nyse AND me IS NOT NULL),
c AS (SELECT s.month_idx, s.permno, s.me, (SELECT count(*) FROM b WHERE b.month_idx = s.month_idx) AS n, (SELECT count(*) FROM b WHERE b.month_idx = s.month_idx AND b.me <= s.me) AS k, (SELECT max(me) FROM b WHERE b.month_idx = s.month_idx AND b.me <= s.me) AS lo, (SELECT min(me) FROM b WHERE b.month_idx = s.month_idx AND b.me > s.me) AS hi FROM fx_stock_month s)
SELECT month_idx, permno, round(CASE WHEN me IS NULL OR n = 0 THEN NULL WHEN lo IS NULL THEN 0 WHEN me = lo THEN k / (n + 1) * 100 WHEN hi IS NULL THEN 100 ELSE (k + (me - lo) / (hi - lo)) / (n + 1) * 100 END, 6) AS percentile FROM c""")
def inverse_percentile(spark, sf_dir):
    m = view(spark, sf_dir, "fx_stock_month")
    return P.inverse_percentile(m.where("nyse"), m.select("month_idx", "permno", "me"), "me").select("month_idx", "permno", F.round("percentile", 6).alias("percentile"))


@query(f"{_EV}, t AS (SELECT unnest(string_split(pair || '_' || mechanism, '_')) AS theme, o FROM e) SELECT theme, count(*) AS evaluated, count(*) FILTER (o = 'correct') AS correct, round(count(*) FILTER (o = 'correct') / count(*), 8) AS rate FROM t GROUP BY theme")
def theme_marginals(spark, sf_dir):
    ev = _ev(spark, sf_dir).withColumn("pair", F.concat_ws("_", "pair", "mechanism"))
    return runs.marginals(ev).withColumn("rate", F.round("rate", 8))


@query("SELECT mechanism, count(*) AS n, count(*) FILTER (expected_sign = 'negative') AS flagged, round(count(*) FILTER (expected_sign = 'negative') / count(*), 8) AS flag_share, round(count(*) / (SELECT count(*) FROM fx_evaluated), 8) AS share FROM fx_evaluated GROUP BY mechanism")
def critique_taxonomy(spark, sf_dir):
    notes = _ev(spark, sf_dir).withColumn("verdict", F.when(F.col("expected_sign") == "negative", "flag").otherwise("accept"))
    return runs.critique_taxonomy(notes, "mechanism").withColumns({c: F.round(c, 8) for c in ("flag_share", "share")})


@query("SELECT mechanism AS role, count(*) AS calls, CAST(sum(signal_no) AS BIGINT) AS prompt_tokens, CAST(sum(generation) AS BIGINT) AS completion_tokens FROM fx_evaluated GROUP BY ROLLUP (mechanism)")
def call_accounting(spark, sf_dir):
    calls = _ev(spark, sf_dir).select(F.col("mechanism").alias("role"), F.col("signal_no").alias("prompt_tokens"), F.col("generation").alias("completion_tokens"))
    return runs.call_accounting(calls)


@query("SELECT role AS run, count(*) AS n, count(DISTINCT regexp_replace(lower(text), '\\s+', '', 'g')) AS n_unique, count(*) - count(DISTINCT regexp_replace(lower(text), '\\s+', '', 'g')) AS n_duplicate, round(count(DISTINCT regexp_replace(lower(text), '\\s+', '', 'g')) / count(*), 8) AS rate FROM conversations WHERE trim(text) <> '' GROUP BY role")
def expression_uniqueness(spark, sf_dir):
    c = view(spark, sf_dir, "conversations").select(F.col("role").alias("run"), F.col("text").alias("expression"))
    return runs.uniqueness(c).withColumn("rate", F.round("rate", 8))


_SEL = "s AS (SELECT signal_no, expected_sign, fmb_tstat AS t, CASE WHEN signal_no % 40 = 0 THEN 'near_duplicate' END AS reason, fmb_tstat > 2.4 AND expected_sign = 'positive' AS ok FROM fx_evaluated)"


@query(f"""WITH {_SEL} SELECT signal_no, ifnull(ok, false) AS survives, CASE WHEN NOT ifnull(ok, false) THEN CASE WHEN reason IS NOT NULL THEN reason WHEN t IS NULL THEN 'conditional_t_not_estimable'
WHEN (expected_sign = 'negative' AND t >= 0) OR (expected_sign = 'positive' AND t <= 0) THEN 'conditional_sign_mismatch' ELSE 'conditional_t_below_threshold' END END AS reason FROM s""")
def selection_reasons(spark, sf_dir):
    ev = _ev(spark, sf_dir)
    ids = ev.where("fmb_tstat > 2.4 AND expected_sign = 'positive'").select("signal_no")
    reasons = ev.where("signal_no % 40 = 0").select("signal_no", F.lit("near_duplicate").alias("reason"))
    return runs.selection(ev.select("signal_no", "expected_sign"), ids, ev.select("signal_no", F.col("fmb_tstat").alias("conditional_t")), reasons, "signal_no").select("signal_no", "survives", "reason")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(O)
