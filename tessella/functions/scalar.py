"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

# Fixed value: denominators and deviations no larger than this count as zero.
TINY = 1e-10


def clean(x: Column) -> Column:
    """NULL for NaN and infinities: NULL is the only missing value."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == math.inf), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > TINY, a / b)


def both(a: Column, b: Column, value: Column) -> Column:
    """value where neither a nor b is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), value)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x held to [low, high]; a missing bound doesn't bind, a missing x stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def average_rank(x: Column, group: WindowSpec) -> Column:
    """1-based rank of x in its group, ties sharing their mean; NULL where x is. One partitioning, one sort.

    The smallest rank of a tie is rank(), its largest the number of values up to x.
    """
    order = group.orderBy(x.asc_nulls_last())
    upto = F.count(x).over(order.rangeBetween(Window.unboundedPreceding, 0))
    return F.when(x.isNotNull(), (F.rank().over(order) + upto) / 2.0)


def percentile_rank(x: Column, group: WindowSpec) -> Column:
    """Average-tie rank as a share of the group's values: in (0, 1]."""
    return average_rank(x, group) / F.count(x).over(group)


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def month_end(yyyymm: Column) -> Column:
    return F.last_day(F.to_date(yyyymm.cast("string"), "yyyyMM"))


def formation_year(date: Column) -> Column:
    """Year whose June portfolios are held in the month of date: accounting data are used from July on."""
    return F.when(F.month(date) >= 7, F.year(date)).otherwise(F.year(date) - 1)


def sic2(sic: Column) -> Column:
    """First two of a SIC code's four digits; longer codes keep their first two."""
    text = F.bround(sic).cast("long").cast("string")
    return F.substring(F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text), 1, 2)


def market_equity(price: Column, shares: Column) -> Column:
    return F.abs(price) * shares


def delisting_return(ret: Column, dlret: Column, dlstcd: Column) -> Column:
    """Return with the delisting month's loss: the delisting return where known, -30 % for forced exits."""
    forced = F.coalesce(dlstcd.between(200, 399), F.lit(False))
    fill = F.coalesce(dlret, F.when(forced, -0.30).otherwise(0.0))
    return F.when(dlret.isNotNull() | forced, (1 + F.coalesce(ret, F.lit(0.0))) * (1 + fill) - 1).otherwise(ret)


def is_financial(sic: Column) -> Column:
    return F.coalesce((sic >= 6000) & (sic < 7000), F.lit(False))


def is_nyse(exchange: Column) -> Column:
    return F.coalesce(exchange == 1, F.lit(False))


def book_equity(seq, ceq, pstk, at, lt, txditc, txdi, itcb, pstkrv, pstkl) -> dict[str, Column]:
    """Stockholders' equity, deferred taxes, preferred stock and book equity (NULL unless positive)."""
    zero = F.lit(0.0)
    se = F.coalesce(seq, ceq + F.coalesce(pstk, zero), at - lt)
    dt = F.coalesce(txditc, F.coalesce(txdi, zero) + F.coalesce(itcb, zero))
    ps = F.coalesce(pstkrv, pstkl, pstk, zero)
    be = se + dt - ps
    return {"se": se, "dt": dt, "ps": ps, "be": F.when(be > 0, be)}
