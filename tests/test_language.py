"""The expression language: parsing, checking, and hand-computed values."""

import pytest
from pyspark.sql import functions as F

from tessella.plans.catalog import OPERATORS, VARIABLES
from tessella.plans.compiler import Compiler, available_variables, evaluate
from tessella.plans.expression import ExpressionError, check, dedupe_key, identity_form, parse, split_arguments
from tessella.plans.themes import PAIRS, THEMES, exclusive_items


def test_catalogs():
    assert len(VARIABLES) == 66 and len(OPERATORS) == 32 and len(THEMES) == 8 and len(PAIRS) == 28
    assert all(set(v) <= VARIABLES for v in THEMES.values())
    assert "at" not in exclusive_items("accruals", ["quality"]) and "txp" in exclusive_items("accruals", ["quality"])


@pytest.mark.parametrize("text", ["RATIO(SUB(revt, cogs), at)", "growth(at)", "GROWTH(at, 2)", "WINSOR(ib, 2.5)", "INDICATOR(ib, -1e-5)", "ADD(1e-5, at)", "TREND(at,3)", "COALESCE(xrd, 0)"])
def test_accepted(text):
    assert check(text).ok


@pytest.mark.parametrize(
    ("text", "why"),
    [("GROWTH(at,1,2)", "expects 1-2"), ("VOL(at,1)", ">= 2"), ("WINSOR(at,50)", "(0, 50)"), ("FOO(at)", "unknown operator"), ("RATIO(at)", "expects 2"), ("xyz", "unknown variable"), ("at_lag1", "unknown variable"), ("", "empty"), ("RATIO(at, lt", "unbalanced"), ("RATIO(at)), (lt)", "unbalanced"), ("at / lt", "could not parse"), ("(at)", "could not parse"), ("MA(at, 2.5)", "must be an integer"), ("ABS()", "no arguments"), ("MA(at, k)", "must be an integer"), ("ABS(at)+ABS(lt)", "could not parse")],
)
def test_rejected(text, why):
    told = check(text)
    assert not told.ok and why in told.message


def test_trees():
    assert parse("ma(AT)").key == parse("MA(at, 3)").key != parse("MA(at, 2)").key
    assert check("SUB(RATIO(ib, at), LOG(sale))").variables == {"ib", "at", "sale"}
    assert parse("at/lt/ib", infix=True).key == parse("RATIO(at, RATIO(lt, ib))").key
    assert parse("at-lt-ib", infix=True).key == parse("SUB(SUB(at, lt), ib)").key
    assert parse("at+lt*ib", infix=True).key == parse("ADD(at, MUL(lt, ib))").key
    assert parse("-at", infix=True).key == parse("NEG(at)").key
    with pytest.raises(ExpressionError):
        parse("at+", infix=True)
    assert split_arguments("F(a, b), 2") == ["F(a, b)", "2"]


def test_forms():
    assert dedupe_key(" RATIO( at,\n lt ) ") == "ratio(at,lt)"
    assert identity_form("RATIO(SUB(revt ,cogs),  at)") == "ratio( sub( revt, cogs ), at )"


def table(spark, rows):
    """rows: (permno, year, x); other items follow from it."""
    df = spark.createDataFrame(rows, "permno long, year int, ib double")
    return df.select("permno", "year", (F.col("year") + 1).alias("form_year"), F.when(F.col("permno") < 90, F.lit("01")).alias("sic2"), "ib", F.lit(2.0).alias("at"))


def values(df, text, **options):
    return {(r.permno, r.year): r.v for r in evaluate(df, {"v": text}, **options).collect()}


def test_calendar_operators(spark):
    df = table(spark, [(1, 2000, 1.0), (1, 2001, 2.0), (1, 2003, 4.0), (1, 2004, 8.0), (1, 2005, 16.0), (1, 2006, None), (2, 2000, 5.0), (2, 2001, 5.0)])
    lag = values(df, "LAG(ib)")
    assert [lag[1, y] for y in (2000, 2001, 2003, 2004)] == [None, 1.0, None, 4.0]
    assert values(df, "TREND(ib, 5)")[1, 2006] == pytest.approx(6.0)
    assert values(df, "TS_RANK(ib, 3)")[2, 2001] == 0.75 and values(df, "TS_RANK(ib, 3)")[2, 2000] is None
    assert values(df, "TS_COUNT(ib, 2)")[1, 2006] == 1.0
    assert values(df, "GROWTH(ib)")[1, 2004] == 1.0 and values(df, "ACCEL(ib)")[1, 2005] == pytest.approx(4.0)
    assert values(df, "VOL(ib, 2)")[1, 2003] is None


def test_row_operators(spark):
    df = table(spark, [(1, 2000, 1e-10), (2, 2000, -1e-9), (3, 2000, 0.0), (4, 2000, None)])
    inv = values(df, "RATIO(1, ib)")
    assert [inv[i, 2000] for i in (1, 2, 3, 4)] == [None, pytest.approx(-1e9), None, None]
    assert values(df, "MIN(ib, at)")[4, 2000] is None and values(df, "MAX(ib, 1)")[4, 2000] is None
    assert values(df, "LOG(ib)")[3, 2000] is None and values(df, "INDICATOR(ib, 0)")[3, 2000] == 0.0


def test_cross_sections(spark):
    df = table(spark, [(1, 2000, 1.0), (2, 2000, 2.0), (3, 2000, 2.0), (4, 2000, None), (5, 2000, 5.0), (95, 2000, 9.0)])
    rank = values(df.where("permno < 90"), "RANK(ib)")
    assert [rank[i, 2000] for i in (1, 2, 3, 4, 5)] == [0.25, 0.625, 0.625, None, 1.0]
    assert values(df, "IND_ADJ(ib)")[95, 2000] is None and values(df, "IND_RANK(ib)")[95, 2000] is None
    assert set(values(df, "ZSCORE(at)").values()) == {None}
    assert values(df, "ib", winsorize_pct=25.0)[95, 2000] == 5.0


def test_shared_parts_are_compiled_once(spark):
    df = table(spark, [(1, 2000, 1.0)])
    c = Compiler(df.columns)
    for text in ("LAG(ib)", "ADD(LAG(ib), LAG(ib, 1))", "RATIO(LAG(ib), at)"):
        c.add(parse(text))
    assert sum(map(len, c.windows.values())) == 1
    plan = evaluate(df, {"a": "LAG(ib)", "b": "MA(ib)", "c": "TREND(ib)", "d": "TS_SUM(ib)"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert available_variables(df) == ["at", "ib"]


def test_nesting_does_not_multiply_scans(spark):
    """Each level of cross-sections is one more window, not one more reading of all below."""
    df = spark.createDataFrame([(1, 2000, 2001, "10", 1.0, 2.0)], "permno long, year int, form_year int, sic2 string, a double, b double")
    text = "RATIO(a, b)"
    for depth in range(4):
        plan = evaluate(df, {"x": text}, winsorize_pct=1.0)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2, (depth, plan)
        text = f"ZSCORE(WINSOR({text}, 5))"
