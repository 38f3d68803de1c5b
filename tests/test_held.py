"""What several jobs read is worked out once."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def counted(spark, df):
    """df, and an accumulator of the rows that are worked out."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), n


def test_multi_model_reads_returns_and_factors_once(spark):
    import numpy as np

    from tessella.operators import evaluator

    rng = np.random.RandomState(3)
    returns, seen = counted(spark, spark.createDataFrame([(m, p, float(x)) for m in range(40) for p, x in zip(("1", "2", "LS"), rng.normal(size=3), strict=True)], "month_idx int, ptf string, ret double"))
    table, read = counted(spark, spark.createDataFrame([(m, float(x), 0.0) for m, x in enumerate(rng.normal(size=40))], "month_idx int, mkt double, RF double"))
    rows = evaluator.multi_model(returns, {"A": (table, ["mkt"], "RF"), "B": (table, ["mkt"], None)})
    assert [r["status"] for r in rows] == ["ok", "ok"]
    assert (seen.value, read.value) == (120, 40)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_factors_leave_held_stock_months_held(spark):
    from tessella.operators import evaluator
    from tessella.queries_panel import _factors, signals

    with evaluator.held(signals(spark, SF).repartition("permno")) as (panel,):
        told = sorted(map(tuple, _factors(spark, SF, panel).collect()))
        assert panel.storageLevel.useMemory
    # Means of few stocks may lie halfway between two roundings to 8 digits.
    assert told == [pytest.approx(t, abs=1.1e-8) for t in sorted(map(tuple, _factors(spark, SF).collect()))]
    assert not panel.storageLevel.useMemory


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_a_batch_reads_firm_years_once(spark):
    from tessella.fixtures import view
    from tessella.operators import evaluator
    from tessella.queries_panel import FIRST, _factors

    firms, seen = counted(spark, view(spark, SF, "fx_firm_year"))
    ev = evaluator.Evaluator(firms, view(spark, SF, "fx_stock_month"), _factors(spark, SF), ["Mkt-RF", "SMB"], first_month=FIRST)
    one, other = ev.evaluate_all(["RATIO(xrd, at)", "ADD(RANK(ib), REVT)"])
    assert one.error is None and other.error is None and one.coverage < other.coverage
    assert seen.value == view(spark, SF, "fx_firm_year").count()
