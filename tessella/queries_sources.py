"""Queries of sources, stores, artifacts and the search loop: tables are written, read back and compared."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import functions as F

from tessella import sql_linear as L
from tessella.fixtures import view, with_views
from tessella.functions import scalar
from tessella.operators import assay as A
from tessella.operators import discovery, evaluator, runs
from tessella.operators import panel as P
from tessella.operators import regression as R
from tessella.plans import themes
from tessella.queries_assay import _EV, THREE, _ev
from tessella.queries_panel import _DELIST, _MSF, _NAMES, _Y, SG, TWO, _factors, _r, _with_ls, nw_sql, signals
from tessella.sources import accounting, artifacts, betas, factors, predictors, securities, store

Q, O = {}, {}


def query(sql: str | None):
    """Registers a query with its oracle."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = with_views(sql)
        return f

    return keep


# Stores and scans.
@query("SELECT month_idx, permno, me, 1 AS builds, false AS before, true AS after FROM fx_stock_month")
def panel_store(spark, sf_dir):
    old, built = spark.conf.get(store.FOLDER, None), []
    store.set_folder(spark, store.scratch(spark, "panels"))
    try:
        before = store.exists(spark, "me")
        for _ in range(2):
            df = store.load_or_build(spark, "me", lambda: built.append(1) or view(spark, sf_dir, "fx_stock_month").select("month_idx", "permno", "me"))
        after = store.exists(spark, "me")
    finally:
        spark.conf.unset(store.FOLDER) if old is None else spark.conf.set(store.FOLDER, old)
    return df.select("*", F.lit(len(built)).alias("builds"), F.lit(before).alias("before"), F.lit(after).alias("after"))


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def jdbc_scan(spark, sf_dir):
    """By the embedded database that Spark ships, packed where every executor reads it."""
    url = store.embedded(view(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "S")
    with store.Connection(spark, url, user="APP", password="APP") as c:
        return c.query('SELECT "s_suppkey", "s_acctbal" FROM S WHERE "s_acctbal" > 1000')


_ANN = """SELECT permno AS gvkey, make_date(year, 12, 31) AS datadate, year AS fyear, 12 AS fyr, CASE WHEN permno % 7 = 0 THEN 'FS' ELSE 'INDL' END AS indfmt, CASE WHEN permno % 13 = 0 THEN 'SUMM' ELSE 'STD' END AS datafmt,
'D' AS popsrc, CASE WHEN permno % 10 = 0 THEN 'P' ELSE 'C' END AS consol, {at}, revt, ib, 'x' AS other, CAST(sic AS DOUBLE) AS sich FROM {t}"""


@query(f"""WITH r AS ({_ANN.format(at='"at"', t="fx_firm_year")}) SELECT gvkey, datadate, fyear, "at", revt, ib, sich AS sic FROM r WHERE indfmt = 'INDL' AND datafmt = 'STD' AND popsrc = 'D' AND consol = 'C' AND datadate BETWEEN DATE '1994-01-01' AND DATE '1997-12-31'""")
def annual_scan(spark, sf_dir):
    raw = spark.sql(_ANN.format(at="`at`", t="{t}"), t=view(spark, sf_dir, "fx_firm_year"))
    return accounting.annual(raw, "1994-01-01", "1997-12-31").select("gvkey", "datadate", "fyear", "at", "revt", "ib", "sic")


_QTR = """SELECT permno AS gvkey, month_end AS datadate, year(month_end) AS fyearq, CAST(month(month_end) / 3 AS INT) AS fqtr, 'INDL' AS indfmt, 'STD' AS datafmt, 'D' AS popsrc, CASE WHEN permno % 10 = 0 THEN 'P' ELSE 'C' END AS consol,
me AS atq, ret AS ibq, 'x' AS other FROM {t} WHERE month(month_end) % 3 = 0"""


@query(f"WITH r AS ({_QTR.format(t='fx_stock_month')}) SELECT gvkey, datadate, fyearq, fqtr, atq, ibq FROM r WHERE consol = 'C' AND datadate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def quarterly_scan(spark, sf_dir):
    raw = spark.sql(_QTR.format(t="{t}"), t=view(spark, sf_dir, "fx_stock_month"))
    return accounting.quarterly(raw, "1995-01-01", "1996-12-31")


_STM = """SELECT permno AS gvkey, make_date(year, 12, 31) AS datadate, CASE WHEN permno % 3 = 0 THEN NULL ELSE CAST(sic AS DOUBLE) END AS sic,
CASE WHEN permno % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN permno % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE ib END AS ib FROM {t}"""


@query(f"""WITH s AS ({_STM.format(t="fx_firm_year")}),
j AS (SELECT l.permno, year(datadate) AS year, s.* FROM s JOIN fx_link l ON s.gvkey = l.gvkey AND l.linktype IN ('LC', 'LU') AND l.linkprim IN ('P', 'C') AND datadate >= linkdt AND datadate <= ifnull(linkenddt, DATE '2099-12-31')),
k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY permno, year ORDER BY datadate DESC, gvkey DESC) = 1), je AS (SELECT permno, year(month_end) AS form_year, siccd FROM fx_stock_month WHERE month(month_end) = 6)
SELECT k.permno, year, year + 1 AS form_year, CASE WHEN isfinite(ib) THEN ib END AS ib, substr(lpad(CAST(CAST(coalesce(sic, siccd) AS BIGINT) AS VARCHAR), 4, '0'), 1, 2) AS sic2 FROM k LEFT JOIN je ON je.permno = k.permno AND je.form_year = k.year + 1""")
def firm_years_with_june_codes(spark, sf_dir):
    """Items cleaned of NaN and infinities; the industry from the statement, else from the June stock code."""
    st = spark.sql(_STM.format(t="{t}"), t=view(spark, sf_dir, "fx_firm_year"))
    june = accounting.june_sic(view(spark, sf_dir, "fx_stock_month"))
    return accounting.firm_years(st, accounting.link_table(view(spark, sf_dir, "fx_link")), june).select("permno", "year", "form_year", "ib", "sic2")


_YM = "CAST(floor((month_idx - 1) / 12) * 100 + (month_idx - 1) % 12 + 1 AS INT)"


@query("SELECT month_idx, month_end, round(mktrf, 8) + 0.0 AS mkt, round(smb, 8) + 0.0 AS smb, round(hml, 8) + 0.0 AS mom, CAST(round(rf, 8) AS DOUBLE) AS rf FROM fx_factor_month WHERE month_idx % 5 <> 0")
def factor_files(spark, sf_dir):
    """Two tables in percent, as files, joined by month."""
    f, folder = view(spark, sf_dir, "fx_factor_month"), store.scratch(spark, "factors")
    pct = lambda c: (F.col(c) * 100)
    month = F.expr(_YM).alias("yyyymm")
    f.select(month, pct("mktrf").alias("Mkt-RF"), *[pct(c).alias(n) for c, n in (("smb", "SMB"), ("hml", "HML"), ("smb", "RMW"), ("hml", "CMA"), ("rf", "RF"))]).write.option("header", True).csv(f"{folder}/five")
    f.where("month_idx % 5 <> 0").select(month, pct("hml").alias("Mom")).write.option("header", True).csv(f"{folder}/momentum")
    five, momentum = (spark.read.option("header", True).csv(f"{folder}/{n}").withColumn("yyyymm", F.col("yyyymm").cast("int")) for n in ("five", "momentum"))
    return factors.five_and_momentum(five, momentum).select("month_idx", "month_end", _r("Mkt-RF").alias("mkt"), _r("SMB").alias("smb"), _r("Mom").alias("mom"), F.round("RF", 8).alias("rf"))


@query("SELECT month_idx, month_end, round(mktrf, 8) + 0.0 AS r_mkt, round(smb, 8) + 0.0 AS r_me, round(hml, 8) + 0.0 AS r_roe FROM fx_factor_month")
def q_factor_file(spark, sf_dir):
    folder = store.scratch(spark, "q")
    f = view(spark, sf_dir, "fx_factor_month").select(F.year("month_end").alias("year"), F.month("month_end").alias("month"), *[(F.col(c) * 100).alias(n) for c, n in (("rf", "R_F"), ("mktrf", "R_MKT"), ("smb", "R_ME"), ("hml", "R_IA"), ("hml", "R_ROE"), ("smb", "R_EG"))])
    f.write.option("header", True).csv(folder)
    return factors.q_factors(spark, folder).select("month_idx", "month_end", _r("R_MKT").alias("r_mkt"), _r("R_ME").alias("r_me"), _r("R_ROE").alias("r_roe"))


@query(f"""{SG}, u AS (SELECT 'signal' AS name, signal AS value FROM sg WHERE signal IS NOT NULL AND permno % 4 = 1 UNION ALL SELECT 'lev', lev FROM sg WHERE lev IS NOT NULL AND permno % 4 = 1)
SELECT name, count(*) AS n, round(sum(value), 6) AS total, 'signal,lev' AS listed FROM u GROUP BY name""")
def zipped_predictors(spark, sf_dir):
    """A zipped CSV of predictors, packed on the driver, unpacked and read by the source."""
    wide = signals(spark, sf_dir, **TWO).where("permno % 4 = 1").select("permno", F.expr(_YM).alias(" yyyymm"), F.col("signal").alias("signal "), "lev").toPandas()
    folder = store.scratch(spark, "zip").removeprefix("file://")
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(f"{folder}/p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("about.txt", "not a table")
        z.writestr("inside/p.csv", wide.to_csv(index=False))
    df = predictors.read_wide(spark, f"file://{folder}/p.zip")
    names = predictors.signal_names(df)
    return predictors.to_panels(df, names).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).withColumn("listed", F.lit(",".join(names)))


@query("SELECT n_name AS \"Acronym\", r_name AS \"Cat\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def signal_documentation(spark, sf_dir):
    path = store.scratch(spark, "doc")
    n, r = view(spark, sf_dir, "nation"), view(spark, sf_dir, "region")
    n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("Acronym"), F.col("r_name").alias("Cat")).write.option("header", True).csv(path)
    return predictors.signal_doc(spark, path)


_TWICE = "SELECT permno, date, ret, me, siccd, exchcd FROM {r} UNION ALL SELECT permno, {less} AS date, ret + 1 AS ret, NULL AS me, siccd, 2 AS exchcd FROM {r} WHERE permno % 2 = 0"


@query(f"""WITH m AS ({_MSF.format(l="lineitem")}), n AS ({_NAMES.format(s="supplier")}), d AS ({_DELIST.format(s="supplier")}),
j AS (SELECT m.permno, m.date, exchcd, siccd, round(CASE WHEN dlret IS NOT NULL OR dlstcd BETWEEN 200 AND 399 THEN (1 + ret) * (1 + coalesce(dlret, CASE WHEN dlstcd BETWEEN 200 AND 399 THEN -0.3 ELSE 0 END)) - 1 ELSE ret END, 8) AS ret, round(abs(prc) * shrout, 2) AS me
  FROM m JOIN n ON m.permno = n.permno AND m.date BETWEEN n.namedt AND n.nameendt LEFT JOIN d ON d.permno = m.permno AND date_trunc('month', d.dlstdt) = date_trunc('month', m.date) WHERE n.shrcd IN (10, 11) AND m.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
t AS ({_TWICE.format(r="j", less="CAST(date - INTERVAL 1 DAY AS DATE)")})
SELECT permno, CAST(year(date) * 12 + month(date) AS INT) AS month_idx, last_day(min(date)) AS month_end, round(arg_min(ret, date), 8) + 0.0 AS ret, round(arg_min_null(me, date), 2) AS me, ifnull(arg_min(exchcd, date) = 1, false) AS nyse,
CAST(CASE WHEN month(min(date)) >= 7 THEN year(min(date)) ELSE year(min(date)) - 1 END AS INT) AS form_year FROM t GROUP BY permno, year(date), month(date)""")
def stock_panel_bundle(spark, sf_dir):
    """Monthly rows to one panel: of a stock's rows in a month the first by date counts."""
    s = view(spark, sf_dir, "supplier")
    rows = securities.stock_months(spark.sql(_MSF, l=view(spark, sf_dir, "lineitem")), spark.sql(_NAMES, s=s), spark.sql(_DELIST, s=s), "1996-01-01", "2000-12-31")
    rows = rows.select("permno", "date", F.round("ret", 8).alias("ret"), F.round("me", 2).alias("me"), "siccd", "exchcd")
    twice = spark.sql(_TWICE.format(r="{r}", less="date_sub(date, 1)"), r=rows)
    return securities.to_panel(twice).select("permno", "month_idx", "month_end", _r("ret"), F.round("me", 2).alias("me"), "nyse", "form_year")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey % 10000 AS c FROM orders)
SELECT o_orderkey, last_day(d) AS month_end, CAST(year(d) * 12 + month(d) AS INT) AS month_idx, CAST(CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS INT) AS form_year,
substr(lpad(CAST(c AS VARCHAR), 4, '0'), 1, 2) AS sic2, c % 4 = 1 AS nyse, c BETWEEN 6000 AND 6999 AS financial FROM o""")
def calendar_and_codes(spark, sf_dir):
    o = view(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 10000).alias("c"))
    yyyymm = F.year("d") * 100 + F.month("d")
    return o.select("o_orderkey", scalar.month_end(yyyymm).alias("month_end"), scalar.month_index(F.col("d")).alias("month_idx"), scalar.formation_year(F.col("d")).alias("form_year"), scalar.sic2(F.col("c").cast("double")).alias("sic2"), scalar.is_nyse(F.col("c") % 4).alias("nyse"), scalar.is_financial(F.col("c")).alias("financial"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 4 NOT IN (1, 2, 3) THEN o_totalprice END AS x FROM orders")
def finite_or_none(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    odd = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("o_totalprice"))
    return view(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), scalar.clean(odd).alias("x"))


_UNIQUE = "SELECT count(*) = count(DISTINCT (month_idx, permno)) FROM fx_stock_month"


@query(f"SELECT ({_UNIQUE}) AS unique_ok, false AS repeated_ok, true AS contiguous_ok, false AS gap_ok FROM (SELECT 1)")
def panel_assertions(spark, sf_dir):
    m = view(spark, sf_dir, "fx_stock_month")

    def holds(check, *args) -> bool:
        try:
            check(*args)
        except ValueError:
            return False
        return True

    got = (holds(P.require_unique, m, ["month_idx", "permno"]), holds(P.require_unique, m.unionByName(m), ["month_idx", "permno"]), holds(P.require_contiguous, P.calendar(m)), holds(P.require_contiguous, P.calendar(m).where("month_idx % 7 <> 0")))
    return spark.createDataFrame([got], "unique_ok boolean, repeated_ok boolean, contiguous_ok boolean, gap_ok boolean")


# Betas.
_UN = f"{SG}, th AS (SELECT month_idx, permno, ret, signal, lev, round(CASE WHEN abs(f.\"at\") > 1e-10 THEN f.che / f.\"at\" END, 8) AS turn FROM sg LEFT JOIN fx_firm_year f USING (permno, form_year)), un AS (SELECT month_idx, permno, ret, 'signal' AS name, signal AS v FROM th UNION ALL SELECT month_idx, permno, ret, 'lev', lev FROM th UNION ALL SELECT month_idx, permno, ret, 'turn', turn FROM th)"
_BETAS = _UN + ", xb AS (SELECT a.name, a.month_idx, a.ret, b.v AS x FROM un a JOIN un b ON b.name = a.name AND b.permno = a.permno AND b.month_idx = a.month_idx - 1 WHERE a.ret IS NOT NULL AND b.v IS NOT NULL), bn AS (SELECT name, month_idx, regr_slope(ret, x) AS beta FROM xb GROUP BY name, month_idx HAVING count(*) >= {least} AND var_pop(x) > 0)"


def _long_betas(spark, sf_dir, **options):
    long = signals(spark, sf_dir, **THREE).unpivot(["month_idx", "permno", "ret"], [*THREE], "signal_id", "signal")
    return R.univariate_betas(long, keys=("signal_id",), **options)


@query(f"{_BETAS.format(least=3)} SELECT name AS signal_id, CAST(count(*) AS BIGINT) AS months, round(sum(beta), 6) + 0.0 AS total, 2 AS builds FROM bn GROUP BY name")
def beta_store(spark, sf_dir):
    """Stored betas are read while their specification holds, and made anew when it changes."""
    folder, built = store.scratch(spark, "betas"), []
    make = lambda: built.append(1) or _long_betas(spark, sf_dir)
    for spec in ({"lags": 6}, {"lags": 6}, {"lags": 3}, {"lags": 3}):
        df = betas.load_or_build(spark, folder, spec, make)
    return df.groupBy("signal_id").agg(F.count("*").alias("months"), _total("beta")).withColumn("builds", F.lit(len(built)))


def _total(c: str):
    return (F.round(F.sum(c), 6) + 0.0).alias("total")


@query(f"{_BETAS.format(least=2)} SELECT name AS signal_id, CAST(count(*) AS BIGINT) AS months, round(sum(beta), 5) + 0.0 AS total FROM bn GROUP BY name")
def betas_of_two_stocks(spark, sf_dir):
    """The bootstrap's guard: a month needs two pairs only."""
    return _long_betas(spark, sf_dir, min_obs=2).groupBy("signal_id").agg(F.count("*").alias("months"), (F.round(F.sum("beta"), 5) + 0.0).alias("total"))


@query(f"{_BETAS.format(least=3)}, {nw_sql('bn', 'name')}, pl AS (SELECT name, avg(beta) / (stddev_samp(beta) / sqrt(count(beta))) AS plain FROM bn GROUP BY name) SELECT name AS signal_id, round(plain, 5) + 0.0 AS plain, round(tstat, 5) + 0.0 AS newey_west FROM pl JOIN nw USING (name)")
def column_t_stats(spark, sf_dir):
    names, matrix = A.beta_matrix(_long_betas(spark, sf_dir))
    rows = [(n, float(a), float(b)) for n, a, b in zip(names, A.column_t(matrix), A.column_t(matrix, 6), strict=True)]
    return spark.createDataFrame(rows, "signal_id string, plain double, newey_west double").select("signal_id", _r("plain", 5), _r("newey_west", 5))


_WLS = "xw AS (SELECT a.month_idx, a.ret AS y, b.signal AS u, b.me AS w FROM sg a JOIN sg b ON b.permno = a.permno AND b.month_idx = a.month_idx - 1 WHERE a.ret IS NOT NULL AND b.signal IS NOT NULL AND b.me > 0), ws AS (SELECT month_idx, count(*) AS n, sum(w) AS s, sum(w * u) AS su, sum(w * y) AS sy, sum(w * u * u) AS suu, sum(w * u * y) AS suy FROM xw GROUP BY month_idx), wb AS (SELECT month_idx, (suy - su * sy / s) / (suu - su * su / s) AS beta FROM ws WHERE n >= 3 AND suu - su * su / s > 1e-12)"


@query(f"""{_Y}, y1 AS (SELECT * FROM yf WHERE ptf = 'LS'), {L.regression('m1', 'y1', 'ptf', ['mktrf'], 6)}, {L.regression('m2', 'y1', 'ptf', ['mktrf', 'smb'], 6)}, {_WLS}, {nw_sql('wb')}
SELECT 'CAPM' AS model, round(b0 * 12, 6) + 0.0 AS alpha, round(t0, 4) + 0.0 AS talpha, CAST(NULL AS DOUBLE) AS fmb_tstat, 'ok' AS status, t0 > 1.96 AS survives_196 FROM m1 UNION ALL SELECT 'TWO', round(b0 * 12, 6) + 0.0, round(t0, 4) + 0.0, NULL, 'ok', t0 > 1.96 FROM m2
UNION ALL SELECT 'WLS_FMB', NULL, NULL, round(tstat, 4) + 0.0, 'ok', tstat > 1.96 FROM nw""")
def multi_model_alpha(spark, sf_dir):
    """Long-short alphas by factor model, and the signal's Fama-MacBeth t weighted by market equity."""
    with evaluator.held(signals(spark, sf_dir).repartition("permno")) as (panel,):
        table = _factors(spark, sf_dir, panel)
        rows = evaluator.multi_model(_with_ls(spark, sf_dir, panel), {"CAPM": (table, ["Mkt-RF"], "RF"), "TWO": (table, ["Mkt-RF", "SMB"], "RF")}, panel=panel)
    df = spark.createDataFrame([{k: r[k] for k in ("model", "alpha", "talpha", "fmb_tstat", "status", "survives_196")} for r in rows], "model string, alpha double, talpha double, fmb_tstat double, status string, survives_196 boolean")
    return df.select("model", _r("alpha", 6), _r("talpha", 4), _r("fmb_tstat", 4), "status", "survives_196")


# Run analytics.
@query(f"{_EV}, r AS (SELECT pair, run, avg(CAST(o = 'correct' AS INT)) AS rate FROM e GROUP BY pair, run) SELECT pair, round(median(rate), 8) AS median, round(min(rate), 8) AS least, round(max(rate), 8) AS greatest FROM r GROUP BY pair")
def across_runs(spark, sf_dir):
    rates = _ev(spark, sf_dir).groupBy("pair", "run").agg(F.avg((runs.outcome() == "correct").cast("double")).alias("rate"))
    return runs.across_runs(rates, "rate").select("pair", *[F.round(c, 8).alias(c) for c in ("median", "least", "greatest")])


@query(f"{_EV} SELECT run, count(*) AS n_evaluated, count(*) FILTER (o = 'correct') AS n_successes, round(count(*) FILTER (o = 'correct') / count(*), 8) AS success_rate, count(DISTINCT lower(mechanism || pair)) AS n_unique, count(*) - count(DISTINCT lower(mechanism || pair)) AS n_duplicate, round(count(DISTINCT lower(mechanism || pair)) / count(*), 8) AS uniqueness, CAST(sum(signal_no) AS BIGINT) AS tokens FROM e GROUP BY run")
def benchmark_metrics(spark, sf_dir):
    ev = _ev(spark, sf_dir).withColumn("expression", F.concat(F.lit(" "), F.upper("mechanism"), F.lit("  "), "pair"))
    usage = ev.groupBy("run").agg(F.sum("signal_no").alias("tokens"))
    return runs.benchmark_metrics(ev, usage).withColumns({c: F.round(c, 8) for c in ("success_rate", "uniqueness")})


@query(f"""{_EV}, g AS (SELECT run, generation, count(*) FILTER (ts > 1.96) / count(*) AS rate, max(ts) AS best FROM e WHERE o NOT IN ('error', 'invalid') GROUP BY run, generation),
s AS (SELECT run, count(*) AS n, arg_max(rate, generation) AS rate, arg_max(best, generation) AS best, arg_min(best, generation) AS first FROM g GROUP BY run), p AS (SELECT run, rate AS prate, best AS pbest FROM g QUALIFY row_number() OVER (PARTITION BY run ORDER BY generation DESC) = 2),
w AS (SELECT run, CASE WHEN n < 2 THEN 'too_few_generations' WHEN rate < 0.2 THEN 'hit_rate_collapse' WHEN first > 0 AND best < 0.5 * first THEN 'diminishing_returns' WHEN best < pbest AND rate < prate THEN 'no_improvement' ELSE 'productive' END AS reason FROM s LEFT JOIN p USING (run))
SELECT run, reason NOT IN ('too_few_generations', 'productive') AS converged, reason FROM w""")
def convergence(spark, sf_dir):
    return runs.converged(runs.generations(_ev(spark, sf_dir)))


@query(f"{_EV} SELECT signal_no, ts FROM e WHERE o NOT IN ('error', 'invalid') ORDER BY ts DESC, signal_no LIMIT 25")
def bounded_report(spark, sf_dir):
    """A report of the first 25: the limit is the feature."""
    return runs.report(runs.signed_t(_ev(spark, sf_dir)).select("signal_no", F.col("t_signed").alias("ts")), [F.desc("ts"), F.asc("signal_no")], 25)


@query("SELECT signal_no FROM fx_evaluated ORDER BY signal_no LIMIT 40")
def signal_cap(spark, sf_dir):
    """A cap that the caller asks for: the limit is the feature."""
    return runs.capped(_ev(spark, sf_dir).select("signal_no"), 40, "signal_no")


@query("""WITH i AS (SELECT signal_no, pair, mechanism FROM fx_evaluated), s AS (SELECT signal_no FROM fx_evaluated WHERE fmb_tstat > 1.5) SELECT signal_no, mechanism AS expression, 'row of another' AS refused FROM i SEMI JOIN s USING (signal_no)""")
def survivors(spark, sf_dir):
    """Survivors' rows of the inputs; one whose expression the archive holds otherwise is refused."""
    ev = _ev(spark, sf_dir).select("signal_no", F.col("mechanism").alias("expression"))
    ids = _ev(spark, sf_dir).where("fmb_tstat > 1.5").select("signal_no")
    try:
        runs.survivors(ev, ids, ev.withColumn("expression", F.concat("expression", F.lit("!"))), "signal_no")
        told = "nothing"
    except ValueError as e:
        told = "row of another" if "isn't in the archive" in str(e) else str(e)
    return runs.survivors(ev, ids, ev, "signal_no").withColumn("refused", F.lit(told))


@query("""WITH c AS (SELECT DISTINCT signal_no FROM fx_evaluated WHERE signal_no % 3 = 0 UNION SELECT signal_no + 10000000 FROM fx_evaluated WHERE signal_no % 500 = 0), k AS (SELECT signal_no FROM fx_evaluated)
SELECT 'missing' AS side, signal_no FROM k ANTI JOIN c USING (signal_no) UNION ALL SELECT 'unknown', signal_no FROM c ANTI JOIN k USING (signal_no)""")
def cited_evidence(spark, sf_dir):
    known = _ev(spark, sf_dir).select("signal_no")
    cited = known.where("signal_no % 3 = 0").unionByName(known.where("signal_no % 500 = 0").select((F.col("signal_no") + 10000000).alias("signal_no")))
    missing, unknown = runs.missing_and_unknown(cited, known, "signal_no")
    return missing.select(F.lit("missing").alias("side"), "signal_no").unionByName(unknown.select(F.lit("unknown").alias("side"), "signal_no"))


@query("SELECT DISTINCT run, pair, mechanism, substr(sha1('[\"' || run || '\",\"' || pair || '\",\"ratio( ' || lower(mechanism) || ', at )\"]'), 1, 12) AS signal_id FROM fx_evaluated")
def signal_ids(spark, sf_dir):
    """Names by source, name and expression, whatever the expression's case and blanks."""
    names = _ev(spark, sf_dir).select("run", "pair", "mechanism").distinct().collect()  # runs x pairs x kinds of event
    rows = [(r.run, r.pair, r.mechanism, discovery.signal_id(r.run, r.pair, f" RATIO ({r.mechanism.upper()} ,AT )")) for r in names]
    return spark.createDataFrame(rows, "run string, pair string, mechanism string, signal_id string")


@query("SELECT n_name, trim(regexp_replace(regexp_replace(regexp_replace('net' || n_name || 'Growth_rate-x', '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_-]+', ' ', 'g')) AS printed FROM nation")
def printed_names(spark, sf_dir):
    return view(spark, sf_dir, "nation").select("n_name", themes.printed_name(F.concat(F.lit("net"), "n_name", F.lit("Growth_rate-x"))).alias("printed"))


_THEMES = ", ".join(f"({i}, '{s}', '{p}')" for i, (s, p) in enumerate((("profit", "Profitability"), ("value", "Valuation"), ("invest", "Investment"), ("accrual", "Accruals"), ("quality", "Quality"), ("finance", "Financing"), ("intangible", "Intangibles"), ("distress", "Distress"))))


@query(f"WITH t(i, s, p) AS (VALUES {_THEMES}) SELECT a.s || '_' || b.s AS pair, a.p || ' x ' || b.p AS printed FROM t a JOIN t b ON a.i < b.i")
def theme_pairs(spark, sf_dir):
    return spark.createDataFrame([(p, themes.printed_pair(p)) for p in themes.PAIRS], "pair string, printed string")


# Artifacts.
@query(f"{_EV} SELECT pair, count(*) AS evaluated, count(*) FILTER (o = 'correct') AS correct, (SELECT count(*) FROM e c WHERE c.pair = e.pair AND c.signal_no % 3 = 0) AS considered FROM e GROUP BY pair")
def archive_files(spark, sf_dir):
    """Archives written as one JSON document each, read back and taken apart."""
    folder = store.scratch(spark, "archives")
    fields = [F.col("signal_no").cast("string").alias("name"), "expected_sign", F.col("generation").cast("long").alias("generation"), "fmb_tstat", "error"]
    docs = _ev(spark, sf_dir).groupBy("pair").agg(F.collect_list(F.struct(*fields)).alias("evaluated"), F.collect_list(F.when(F.col("signal_no") % 3 == 0, F.struct(F.col("signal_no").cast("string").alias("name")))).alias("considered"))
    docs.write.option("maxRecordsPerFile", 1).json(folder)
    read = artifacts.read_json(spark, folder, artifacts.ARCHIVE)
    ev = artifacts.exploded(read, "evaluated").groupBy("pair").agg(F.count("*").alias("evaluated"), F.count_if(runs.outcome() == "correct").alias("correct"))
    return ev.join(artifacts.exploded(read, "considered").groupBy("pair").agg(F.count("*").alias("considered")), "pair")


@query("SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 4 NOT IN (1, 2, 3) THEN o_totalprice END AS x FROM orders")
def strict_json_lines(spark, sf_dir):
    """NaN and infinities are written as null."""
    path, k = store.scratch(spark, "lines"), F.col("o_orderkey") % 4
    odd = F.when(k == 1, float("nan")).when(k == 2, float("inf")).when(k == 3, float("-inf")).otherwise(F.col("o_totalprice"))
    artifacts.write_strict(view(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), odd.alias("x")), path)
    from pyspark.sql import types as T

    return artifacts.read_lines(spark, path, T.StructType().add("k", "long").add("x", "double"))


@query(f"{_EV} SELECT run, count(DISTINCT pair) AS experiments, count(*) AS evaluated_tests, count(*) FILTER (o = 'error') AS evaluation_errors, count(*) FILTER (o = 'correct') AS significant_correct_sign FROM e GROUP BY ROLLUP (run)".replace("count(DISTINCT pair) AS experiments", "count(DISTINCT run || pair) AS experiments"))
def search_universe(spark, sf_dir):
    """Documents of totals, one an experiment, added up by run and over all."""
    folder = store.scratch(spark, "universe")
    o = runs.outcome()
    totals = _ev(spark, sf_dir).groupBy("run", "pair").agg(F.struct(F.lit(1).cast("long").alias("experiments"), F.count("*").alias("evaluated_tests"), F.count_if(o == "error").alias("evaluation_errors"), F.count_if(o == "correct").alias("significant_correct_sign")).alias("totals"))
    totals.select("run", F.lit("1").alias("schema_version"), "totals").write.option("maxRecordsPerFile", 1).partitionBy("run").json(folder)
    read = artifacts.read_json(spark, folder, artifacts.UNIVERSE)
    out = artifacts.universe_totals(read, F.regexp_extract("source", r"run=([^/]+)/", 1))
    return out.select("run", "experiments", "evaluated_tests", "evaluation_errors", "significant_correct_sign")


# The search loop, over recorded texts.
def _block(name: str, expression: str, sign: str = "positive", kind: str = "ratio") -> str:
    return f"--- SIGNAL ---\nNAME: {name}\nEXPRESSION: {expression}\nHYPOTHESIS: h\nEXPECTED_SIGN: {sign}\nREASONING: r\nINTERACTION_TYPE: {kind}\n"


_TEXTS = [
    _block("one", "RATIO(oibdp, capx)") + _block("again", "ratio( oibdp , capx )") + _block("bad", "RATIO(oibdp)") + _block("sign", "RATIO(ni, emp)", "sideways"),
    _block("two", "RATIO(xsga, emp)", kind="novel") + _block("kind", "RATIO(xsga, emp)", kind="odd") + "--- SIGNAL ---\nNAME: nameless\n" + _block("same", "RATIO(oibdp, capx)") + _block("one theme", "RATIO(xsga, xint)"),
    _block("late", "RATIO(ib, emp)"),
]


def _searched(spark):
    """Folder of a recorded search of two generations."""
    made = lambda ps, g: [discovery.Evaluated(**vars(p), generation=g, fmb_tstat=2.5 - g) for p in ps]
    folder = store.scratch(spark, "search")
    recorder = discovery.Recorder(folder.removeprefix("file://"), "profit_invest")
    discovery.run_search(discovery.Task("profit_invest"), discovery.QueueProposer(_TEXTS), made, discovery.FixedGenerations(2), discovery.Budget(max_out=10**6), recorder)
    return folder


@query("""SELECT * FROM (VALUES (0, 'accepted', 'info', 1), (0, 'duplicate_expression', 'warning', 1), (0, 'invalid_expression', 'error', 1), (0, 'invalid_expected_sign', 'error', 1),
(1, 'accepted', 'info', 1), (1, 'invalid_interaction_type', 'error', 1), (1, 'duplicate_expression', 'warning', 1), (1, 'missing_required_theme', 'error', 1)) t(generation, code, severity, n)""")
def search_diagnostics(spark, sf_dir):
    """What the validator says of recorded proposals, by generation, read back from the run's lines."""
    lines = artifacts.read_lines(spark, f"{_searched(spark)}/validation_diagnostics.jsonl")
    return lines.groupBy("generation", "code", "severity").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES ('one', 'RATIO(oibdp, capx)', 0, 2.5::DOUBLE, 'correct', 6, 2, 8), ('two', 'RATIO(xsga, emp)', 1, 1.5::DOUBLE, 'weak', 6, 2, 8)) t(name, expression, generation, fmb_tstat, outcome, considered, events, files)""")
def search_archive(spark, sf_dir):
    """Evaluated proposals of the archive; how many were considered, recorded as events, and kept as files a generation."""
    folder = _searched(spark)
    read = artifacts.read_json(spark, f"{folder}/archive.json", artifacts.ARCHIVE)
    considered = artifacts.exploded(read, "considered").count()
    events = spark.read.json(f"{folder}/progress.jsonl").where("event = 'generation_completed'").count()
    files = len(os.listdir(f"{folder.removeprefix('file://')}/generations/gen_000"))
    ev = artifacts.exploded(read, "evaluated").select("name", "expression", "generation", "fmb_tstat", runs.outcome().alias("outcome"))
    return ev.select("*", F.lit(considered).alias("considered"), F.lit(events).alias("events"), F.lit(files).alias("files"))


@query("""SELECT * FROM (VALUES ('m1', 'a,b', 'c', '', 3), ('m2', '', 'd', 'e', 2)) t(mechanism_id, supporting, opposing, failures, cited)""")
def lesson_book(spark, sf_dir):
    """Mechanisms with their evidence by outcome, each id cited once."""
    told = {"a": "supporting", "b": "supporting", "c": "opposing_weak", "d": "opposing_wrong_sign", "e": "realization_failure"}
    book = discovery.lesson_book(told, [{"mechanism_id": "m1", "evidence_ids": ["a", "c", "b"], "status": "supported"}, {"mechanism_id": "m2", "evidence_ids": ["e", "d"]}])
    rows = [(m["mechanism_id"], *(",".join(sorted(m[k])) for k in ("supporting", "opposing", "failures")), len(m["evidence_ids"])) for m in book]
    return spark.createDataFrame(rows, "mechanism_id string, supporting string, opposing string, failures string, cited long")


def queries():
    return dict(Q)


def oracle_sql():
    return dict(O)
