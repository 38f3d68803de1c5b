"""Kernels and small panels against direct computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import linear, scalar
from tessella.operators import assay, panel, portfolio, regression


def test_distributions():
    assert linear.normal_cdf(1.959963984540054) == pytest.approx(0.975) and linear.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert linear.two_sided_p(40) == 0.0
    # Table values of the F distribution: upper 5 % points.
    for df1, df2, point in ((1, 10, 4.9646), (5, 20, 2.7109), (10, 60, 1.9926)):
        assert 1 - linear.f_cdf(point, df1, df2) == pytest.approx(0.05, abs=2e-4)
    # With two numerator degrees of freedom the tail has a closed form.
    for df2, f in ((7, 0.3), (40, 3.0), (700, 1.5), (700, 12.0)):
        assert 1 - linear.f_cdf(f, 2, df2) == pytest.approx((1 + 2 * f / df2) ** (-df2 / 2), rel=1e-9)
    assert linear.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_least_squares():
    r = np.random.default_rng(1)
    x = np.column_stack([np.ones(50), r.normal(size=(50, 2))])
    y = x @ [1.0, 2.0, -1.0] + r.normal(size=50)
    y[3] = np.nan
    fit = linear.least_squares(y, x)
    want = np.linalg.lstsq(np.delete(x, 3, 0), np.delete(y, 3), rcond=None)[0]
    assert fit.beta == pytest.approx(want) and fit.nobs == 49 and math.isnan(fit.resid[3])
    w = r.uniform(0.5, 2, 50)
    root = np.sqrt(np.delete(w, 3))
    want = np.linalg.lstsq(np.delete(x, 3, 0) * root[:, None], np.delete(y, 3) * root, rcond=None)[0]
    assert linear.least_squares(y, x, w).beta == pytest.approx(want)
    assert np.isnan(linear.least_squares(y, np.column_stack([x, x[:, 1]])).beta).all()
    assert math.isnan(linear.least_squares(np.ones(50), x).rsq)


def test_hac():
    s = np.array([1.0, 2.0, np.nan, 0.5, 1.5, 2.5, -1.0])
    ok = np.isfinite(s)
    d = np.where(ok, s - s[ok].mean(), 0)
    v = sum(d * d) + 2 * sum((1 - k / 3) * sum(d[k:] * d[:-k]) for k in (1, 2))
    assert linear.hac_mean_t(s, 2)[1] == pytest.approx(s[ok].mean() / (math.sqrt(v) / ok.sum()))
    x, e = np.ones((6, 1)), s[ok] - s[ok].mean()
    assert linear.hac_errors(x, e, np.flatnonzero(ok), 2)[0] == pytest.approx(math.sqrt(v) / 6)


def test_tangency_and_grs():
    r = np.random.default_rng(2)
    w, sharpe = linear.tangency(r.normal(-0.01, 0.05, (120, 3)))
    assert abs(w.sum()) == pytest.approx(1) and sharpe > 0
    assert np.isnan(linear.tangency(np.ones((3, 3)))[0]).all()
    f, e = r.normal(size=(100, 2)), r.normal(size=(100, 4))
    assert 0 <= linear.grs(np.zeros(4), e, f)["p_value"] <= 1 and linear.grs(np.zeros(4), e, f)["f_stat"] == 0
    assert linear.grs(np.full(4, 9.0), e, f)["p_value"] < 1e-6


@pytest.fixture(scope="module")
def stocks(spark):
    r = np.random.default_rng(3)
    rows = [(m, p, float(r.normal()), float(r.uniform(1, 9)), bool(p % 2), float(r.normal()), float(r.normal())) for m in range(24000, 24040) for p in range(25) if r.random() > 0.1]
    return spark.createDataFrame(rows, "month_idx int, permno long, ret double, me double, nyse boolean, a double, b double").cache()


def test_fama_macbeth_against_numpy(stocks):
    pdf = stocks.toPandas().set_index(["month_idx", "permno"])
    betas = {}
    for m in range(24001, 24040):
        both = pdf.xs(m).join(pdf.xs(m - 1)[["a", "b", "me"]], rsuffix="_l", how="inner")
        x = np.column_stack([np.ones(len(both)), both[["a_l", "b_l"]]])
        betas[m] = linear.least_squares(both["ret"], x, both["me_l"]).beta
    series = np.array([betas[m] for m in sorted(betas)])
    got = {r.name: r for r in regression.fama_macbeth(stocks, ["a", "b"], weight="me").collect()}
    for i, name in enumerate(("const", "a", "b")):
        mean, t = linear.hac_mean_t(series[:, i], 6)
        assert got[name]["mean"] == pytest.approx(mean) and got[name].tstat == pytest.approx(t)


@pytest.fixture(scope="module")
def holed(spark, stocks):
    """The stocks with values missing here and there, unlike in each column."""
    return stocks.withColumns({c: F.when(F.abs(F.hash("month_idx", "permno", F.lit(c))) % 7 > 0, F.col(c)) for c in ("a", "b")}).withColumn("c", F.when(F.col("permno") % 3 > 0, F.col("a") * 0.5 + F.col("me") / 9))


def test_subsets_from_moments(holed):
    names, subsets = ["a", "b", "c"], [["a", "b", "c"], ["b"], ["c", "a"]]
    pdf = holed.toPandas().set_index(["month_idx", "permno"])
    got = {(r.subset, r.name, r.month_idx): r.beta for r in regression.subset_betas(regression.pattern_moments(holed, names), names, subsets).collect()}
    for i, chosen in enumerate(subsets):
        for m in range(24001, 24040):
            both = pdf.xs(m)[["ret"]].join(pdf.xs(m - 1)[chosen], how="inner").dropna()
            want = np.linalg.lstsq(np.column_stack([np.ones(len(both)), both[chosen]]), both["ret"], rcond=None)[0]
            assert [got[i, n, m] for n in ["const", *chosen]] == pytest.approx(want.tolist())


def test_pair_moments_in_blocks(holed):
    pdf = holed.toPandas()
    for rows in (4, 1 << 15):
        got = {(r.month_idx, r.a, r.b): r for r in assay.pair_moments(holed, ["a", "b", "c"], rows).collect()}
        assert len(got) == 40 * 3
        for (m, i, j), r in got.items():
            both = pdf[pdf.month_idx == m][["a", "b", "c"]].iloc[:, [i, j]].dropna().to_numpy()
            assert r.n == len(both) and (r.sa, r.sb, r.saa, r.sbb, r.sab) == pytest.approx((*both.sum(axis=0), *(both**2).sum(axis=0), both.prod(axis=1).sum()))


def test_pooled_ranks(spark):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=3000), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = {k.x: k["rank"] for k in panel.pooled_ranks(df, "x", ranges=16).collect()}
    assert got == {v: np.count_nonzero(x < v) + (np.count_nonzero(x == v) + 1) / 2 for v in set(x.tolist())}
    assert panel.pooled_ranks(df.limit(0), "x").count() == 0


def test_no_frame_reaches_to_the_end(spark):
    """A frame from each row to the end of its group costs the group's square."""
    df = spark.createDataFrame([(1, 0.5, 2.0)], "pos int, p_value double, x double")
    for plan in (assay.adjusted(df), panel.inverse_percentile(df, df, "x", key="pos")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in text and "currentrow$(), unboundedfollowing$()" not in text and "sequence(" not in text


def test_beta_matrix_is_bounded(spark, monkeypatch):
    betas = spark.createDataFrame([(s, m, 1.0) for s in "ab" for m in range(20)], "signal_id string, month_idx int, beta double")
    assert assay.beta_matrix(betas)[1].shape == (20, 2)
    monkeypatch.setattr(assay, "MATRIX_BYTES", 200)
    with pytest.raises(ValueError, match="beyond"):
        assay.beta_matrix(betas)
    with pytest.raises(ValueError, match="beyond"):
        assay.double_bootstrap(spark, np.ones((20, 2)), 0.5)


def test_p_values(spark):
    df = spark.createDataFrame([(0.5,), (-2.0,), (None,), (math.nan,), (math.inf,), (40.0,)], "t double")
    assert [r.p for r in df.select(assay.two_sided_p("t").alias("p")).collect()] == [linear.two_sided_p(0.5), linear.two_sided_p(2.0), None, None, None, 0.0]


def test_partitions_change_nothing(stocks):
    def run(df):
        rets = portfolio.portfolio_returns(portfolio.univariate_sort(df, "a", 5, "nyse"))
        return {(r.month_idx, r.ptf): (None if r.ret is None else round(r.ret, 12), r.n) for r in rets.collect()}

    assert run(stocks.coalesce(1)) == run(stocks.repartition(7))


def test_sorting_edges(spark, stocks):
    b = portfolio.breakpoints(spark.createDataFrame([(1, i, float(2**i)) for i in range(5)], "month_idx int, permno long, x double"), "x").first().points
    assert b == pytest.approx([1.8, 3.2, 5.6, 9.6])
    at = spark.createDataFrame([(1.8, b), (None, b), (0.0, b), (99.0, b)], "x double, points array<double>").select(portfolio.bucket(F.col("x"), F.col("points")).alias("k"))
    assert [r.k for r in at.collect()] == [2, None, 1, 5]
    missing = portfolio.portfolio_returns(portfolio.univariate_sort(stocks, "a", 5).withColumn("ptf", F.when(F.col("ptf") < 5, F.col("ptf"))))
    assert portfolio.long_short(missing).where("ls IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="outside"):
        portfolio.require_labels(spark.createDataFrame([(6,)], "ptf int"), "ptf", 5)


def test_row_functions(spark):
    df = spark.createDataFrame([(0.05, None, 300), (0.05, -0.5, 100), (None, None, 250), (0.1, None, None)], "ret double, dlret double, dlstcd int")
    got = [r.x for r in df.select(scalar.delisting_return(F.col("ret"), F.col("dlret"), F.col("dlstcd")).alias("x")).collect()]
    assert got == pytest.approx([-0.265, 1.05 * 0.5 - 1, -0.3, 0.1])
    codes = spark.createDataFrame([(100.0,), (6021.0,), (None,), (12345.0,)], "s double").select(scalar.sic2(F.col("s")).alias("x"))
    assert [r.x for r in codes.collect()] == ["01", "60", None, "12"]


def test_recessions_and_calendar(spark):
    m = spark.createDataFrame([(2009 * 12 + 6,), (2009 * 12 + 7,)], "month_idx int").select(assay.in_recession(F.col("month_idx")).alias("x"))
    assert [r.x for r in m.collect()] == [True, False]
    p = spark.createDataFrame([(1963 * 12 + 7,), (2024 * 12 + 12,)], "month_idx int")
    months = panel.calendar(p)
    assert months.count() == 738
    assert str(months.select(panel.month_end_of(F.col("month_idx")).alias("d")).agg(F.max("d")).first()[0]) == "2024-12-31"
    with pytest.raises(ValueError, match="contiguous"):
        panel.require_contiguous(p)
    with pytest.raises(ValueError, match="unique"):
        panel.require_unique(p.union(p), ["month_idx"])


def test_multiple_testing(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.01, 0.03, 0.2])], "pos int, p_value double")
    out = {r.pos: r for r in assay.adjusted(df).collect()}
    assert [out[i].holm_adj_p for i in range(4)] == pytest.approx([0.004, 0.03, 0.06, 0.2])
    assert [out[i].bhy_reject for i in range(4)] == [True, True, False, False]
    assert [out[i].bhy_critical for i in range(4)] == pytest.approx([0.006, 0.012, 0.018, 0.024])
    told = assay.testing_summary(assay.adjusted(df))
    assert told["n_reject_bhy"] == 2 and told["bhy_t"] == pytest.approx(linear.normal_ppf(1 - 0.012 / 2))
    assert assay.required_t(0.2, 0.05) == pytest.approx(math.sqrt(-2 * math.log(0.05 / 0.95 / 4)))


def test_bootstrap(spark):
    r = np.random.default_rng(5)
    x = r.normal(0.2, 1, (60, 6))
    a = {t.t: t for t in assay.double_bootstrap(spark, x, 0.5, 8, 5).collect()}
    sums = sum(assay.one_ranking(x, s, 0.5, 5, np.array(assay.GRID), "signed", "signed", 0) for s in range(8)) / 40
    assert a[1.0].type1 == pytest.approx(sums[4][0]) and a[5.0].oratio == pytest.approx(sums[6][-1])
    assert assay.hurdle(assay.double_bootstrap(spark, x, 0.5, 8, 5), 2.0) == 1.0


def test_selection():
    kept, gone = assay.deduplicated(["a", "b", "c"], {("a", "b"): 0.99, ("a", "c"): 0.2, ("b", "c"): -0.97}, {"a": 1.0, "b": 1.0, "c": 5.0})
    assert kept == ["a", "c"] and gone == {"b": "near_duplicate"}
    assert assay.converged([0.5, 0.1], [3, 3])[1] == "hit_rate_collapse" and assay.converged([0.5, 0.4], [4, 3])[1] == "no_improvement" and not assay.converged([0.5], [3])[0]
