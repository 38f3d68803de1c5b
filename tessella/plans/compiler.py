"""From expressions to one DataFrame plan.

Row operators stay inline. Calendar operators become windows over (firm; year) with RANGE frames, so
a lag is the value exactly that many years back and a gap gives NULL. Cross-sectional means, deviations,
medians and quantiles are grouped aggregates (partial sums first) joined back on their few keys; ranks
are windows. Equal subexpressions, within and across expressions, are computed once. Nodes are staged by
depth, so that all windows of a stage share a partitioning and all aggregates of a key one pass.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import TINY, both, clip, percentile_rank, ratio
from tessella.plans.expression import Call, Item, Number, parse

#: Keys of the firm-year table.
FIRM, YEAR, COHORT, INDUSTRY = "permno", "year", "form_year", "sic2"


class Compiler:
    def __init__(self, columns: list[str]):
        self.columns = {c.lower(): c for c in columns}
        self.memo: dict[str, tuple[Column, int]] = {}
        self.windows: dict[int, dict[str, Column]] = defaultdict(dict)
        self.sums: dict[int, dict[tuple[str, ...], dict[str, Column]]] = defaultdict(lambda: defaultdict(dict))
        self.made = 0

    def add(self, node) -> tuple[Column, int]:
        """The node's column, and the stage after which it can be read."""
        if node.key not in self.memo:
            self.memo[node.key] = self._compiled(node)
        return self.memo[node.key]

    def _name(self) -> str:
        self.made += 1
        return f"__x{self.made}"

    def _window(self, value: Column, level: int) -> tuple[Column, int]:
        name = self._name()
        self.windows[level + 1][name] = value
        return F.col(name), level + 1

    def _sum(self, keys: tuple[str, ...], level: int, *values: Column) -> list[Column]:
        names = [self._name() for _ in values]
        self.sums[level + 1][keys].update(zip(names, values, strict=True))
        return [F.col(n) for n in names]

    def _compiled(self, node) -> tuple[Column, int]:
        if isinstance(node, Number):
            return F.lit(float(node.value)), 0
        if isinstance(node, Item):
            if node.name not in self.columns:
                raise KeyError(f"the firm-year table has no column {node.name}")
            return F.col(f"`{self.columns[node.name]}`").cast("double"), 0
        args = [self.add(a) for a in node.args]
        level = max(l for _, l in args)
        return getattr(self, f"_{node.op.name.lower()}")(node, level, *(c for c, _ in args))

    # Row operators.
    def _ratio(self, node, level, a, b):
        return ratio(a, b), level

    def _add(self, node, level, a, b):
        return a + b, level

    def _sub(self, node, level, a, b):
        return a - b, level

    def _mul(self, node, level, a, b):
        return a * b, level

    def _min(self, node, level, a, b):
        return both(a, b, F.least(a, b)), level

    def _max(self, node, level, a, b):
        return both(a, b, F.greatest(a, b)), level

    def _coalesce(self, node, level, a, b):
        return F.coalesce(a, b), level

    def _abs(self, node, level, x):
        return F.abs(x), level

    def _sign(self, node, level, x):
        return F.signum(x), level

    def _log(self, node, level, x):
        return F.when(x > 0, F.ln(x)), level

    def _inv(self, node, level, x):
        return ratio(F.lit(1.0), x), level

    def _neg(self, node, level, x):
        return -x, level

    def _indicator(self, node, level, x):
        return F.when(x.isNotNull(), (x > node.param).cast("double")), level

    # Calendar operators.
    @staticmethod
    def _years(first: int, last: int):
        return Window.partitionBy(FIRM).orderBy(YEAR).rangeBetween(first, last)

    def _back(self, x: Column, years: int) -> Column:
        return F.first(x).over(self._years(-years, -years))

    def _trailing(self, node):
        return self._years(1 - int(node.param), 0)

    def _lag(self, node, level, x):
        return self._window(self._back(x, int(node.param)), level)

    def _delta(self, node, level, x):
        back, level = self._window(self._back(x, int(node.param)), level)
        return x - back, level

    def _growth(self, node, level, x):
        back, level = self._window(self._back(x, int(node.param)), level)
        return ratio(x - back, F.abs(back)), level

    def _accel(self, node, level, x):
        (one, _), (two, up) = self._window(self._back(x, 1), level), self._window(self._back(x, 2), level)
        return (x - one) - (one - two), up

    def _ma(self, node, level, x):
        return self._window(F.avg(x).over(self._trailing(node)), level)

    def _vol(self, node, level, x):
        return self._window(F.stddev_samp(x).over(self._trailing(node)), level)

    def _trend(self, node, level, x):
        w = self._trailing(node)
        # Years are taken from a base, which keeps the slope's sums small.
        return self._window(F.when(F.count(x).over(w) >= 3, F.regr_slope(x, (F.col(YEAR) - 2000).cast("double")).over(w)), level)

    def _ts_min(self, node, level, x):
        return self._window(F.min(x).over(self._trailing(node)), level)

    def _ts_max(self, node, level, x):
        return self._window(F.max(x).over(self._trailing(node)), level)

    def _ts_sum(self, node, level, x):
        return self._window(F.sum(x).over(self._trailing(node)), level)

    def _ts_count(self, node, level, x):
        return self._window(F.count(x).over(self._trailing(node)).cast("double"), level)

    def _ts_rank(self, node, level, x):
        seen, level = self._window(F.collect_list(x).over(self._trailing(node)), level)
        n = F.size(seen)
        less, same = F.size(F.filter(seen, lambda v: v < x)), F.size(F.filter(seen, lambda v: v == x))
        return F.when(x.isNotNull() & (n >= 2), (less + (same + 1) / 2.0) / n), level

    # Cross-sectional operators.
    def _zscored(self, keys, level, x):
        mean, sd = self._sum(keys, level, F.avg(x), F.stddev_samp(x))
        return F.when(sd > TINY, (x - mean) / sd), level + 1

    def _zscore(self, node, level, x):
        return self._zscored((COHORT,), level, x)

    def _ind_zscore(self, node, level, x):
        return self._zscored((YEAR, INDUSTRY), level, x)

    def _ind_adj(self, node, level, x):
        (middle,) = self._sum((YEAR, INDUSTRY), level, F.median(x))
        return x - middle, level + 1

    def _winsor(self, node, level, x):
        return self.winsorised(x, level, node.param)

    def winsorised(self, x: Column, level: int, p: float):
        (bounds,) = self._sum((COHORT,), level, F.percentile(x, F.array(F.lit(p / 100), F.lit(1 - p / 100))))
        return clip(x, bounds[0], bounds[1]), level + 1

    def _rank(self, node, level, x):
        return self._window(percentile_rank(x, Window.partitionBy(COHORT)), level)

    def _ind_rank(self, node, level, x):
        ranked = percentile_rank(x, Window.partitionBy(YEAR, INDUSTRY))
        return self._window(F.when(F.col(INDUSTRY).isNotNull(), ranked), level)

    def _sumrank(self, node, level, a, b):
        w = Window.partitionBy(COHORT)
        (ra, _), (rb, up) = self._window(percentile_rank(a, w), level), self._window(percentile_rank(b, w), level)
        return ra + rb - 1, up

    def staged(self, df: DataFrame) -> DataFrame:
        """df with every column that the compiled nodes read. Sums of the first level are grouped and joined back; those
        of later ones are windows, since a join would plan all that lies below once more for each level."""
        for level in range(1, max([0, *self.windows, *self.sums]) + 1):
            before = df
            for keys, values in self.sums[level].items():
                if level > 1:
                    w, known = Window.partitionBy(*keys), F.lit(True)
                    for k in keys:
                        known = known & F.col(k).isNotNull()
                    df = df.withColumns({n: F.when(known, v.over(w)) for n, v in values.items()})
                    continue
                stats = before.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
                df = df.join(stats, [*keys], "left")
            if self.windows[level]:
                df = df.withColumns(self.windows[level])
        return df


def evaluate(firm_year: DataFrame, expressions: dict[str, str], winsorize_pct: float | None = None, infix: bool = False) -> DataFrame:
    """Keys of firm_year and a column for each expression, in one plan.

    firm_year has permno, year, form_year, sic2 (NULL for firms without industry) and items as columns.
    winsorize_pct clips each result to its cohort's pct and 100 - pct percentiles.
    """
    compiler, out = Compiler(firm_year.columns), {}
    for name, text in expressions.items():
        column, level = compiler.add(parse(text, {c.lower() for c in firm_year.columns}, infix))
        if winsorize_pct:
            column, level = compiler.winsorised(column, level, winsorize_pct)
        out[name] = column
    return compiler.staged(firm_year).select(FIRM, YEAR, COHORT, *[c.alias(n) for n, c in out.items()])


def describe(firm_year: DataFrame, text: str) -> DataFrame:
    """One row: coverage, mean, median, deviation, least and greatest of an expression."""
    x = F.col("value")
    return evaluate(firm_year, {"value": text}).agg((F.count(x) / F.count("*")).alias("coverage"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def available_variables(firm_year: DataFrame) -> list[str]:
    keys = {"permno", "gvkey", "datadate", "fyear", "fyr", "year", "form_year", "sic2", "sic"}
    return sorted(c for c in firm_year.columns if c.lower() not in keys)
