"""From an expression to its statistics: the whole chain as one operator."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import discovery
from tessella.operators import panel as P
from tessella.operators import portfolio as S
from tessella.operators import regression as R
from tessella.plans.compiler import evaluate
from tessella.plans.expression import Call, ExpressionError, Item, Number, parse

LEAST_COVERAGE = 0.01


@contextmanager
def held(*frames: DataFrame) -> Iterator[list[DataFrame]]:
    """frames, kept while the block runs: what several jobs read is worked out once."""
    kept = [f.persist() for f in frames]
    try:
        yield kept
    finally:
        for f in kept:
            f.unpersist()


def items(node: Call | Item | Number) -> set[str]:
    """Names of the items that a parsed expression reads."""
    return {node.name} if isinstance(node, Item) else set().union(*map(items, getattr(node, "args", ())))


@dataclass
class SignalResult:
    expression: str
    coverage: float | None = None
    ls_alpha: float | None = None
    ls_talpha: float | None = None
    ls_sharpe: float | None = None
    quintiles: list[float] = field(default_factory=list)
    fmb_beta: float | None = None
    fmb_tstat: float | None = None
    error: str | None = None


@dataclass
class Evaluator:
    """firm_year, stock_month (month_idx, permno, form_year, ret, me, nyse, siccd) and a factor table."""

    firm_year: DataFrame
    stock_month: DataFrame
    factors: DataFrame
    factor_names: list[str]
    rf: str = "RF"
    n_ptf: int = 5
    financials: bool = False
    microcaps: bool = False
    first_month: int = P.FIRST_MONTH

    def prepared(self, expression: str) -> tuple[DataFrame, DataFrame]:
        """The stock-month sample with the raw signal, and with the prepared one."""
        signal = evaluate(self.firm_year, {"signal": expression}, winsorize_pct=1.0)
        # The sample is chosen by returns and market equity, so signals come to its months only.
        sample = P.to_months(P.monthly_sample(self.stock_month, self.first_month), signal, ["signal"])
        return sample, P.prepare_signal(sample, "signal", self.financials, self.microcaps)

    def evaluate(self, expression: str) -> SignalResult:
        """Value-weighted quintiles on NYSE breakpoints, long-short alpha (annual), Fama-MacBeth t. An error is a result."""
        out = SignalResult(expression)
        try:
            sample, panel = self.prepared(expression)
            out.coverage = P.coverage(sample, "signal").first()[0] or 0.0
            if out.coverage < LEAST_COVERAGE:
                raise ValueError(f"coverage {out.coverage:.4f} is below {LEAST_COVERAGE}")
            panel = panel.repartition("permno").persist()
            try:
                rets = S.portfolio_returns(S.univariate_sort(panel, "signal", self.n_ptf, "nyse"), n_ptf=self.n_ptf).persist()
                ls = S.long_short(rets, self.n_ptf).select("month_idx", F.lit("LS").alias("ptf"), F.col("ls").alias("ret"))
                reg = R.factor_regressions(ls, self.factors, self.factor_names, self.rf).first()
                if reg is not None and reg.alpha is not None:
                    out.ls_alpha, out.ls_talpha, out.ls_sharpe = reg.alpha * 12, reg.talpha, reg.sharpe
                out.quintiles = [r.m for r in rets.groupBy("ptf").agg((F.avg("ret") * 1200).alias("m")).orderBy("ptf").collect()]
                t = R.newey_west(R.univariate_betas(panel, "signal")).first()
                out.fmb_beta, out.fmb_tstat = (t["mean"], t["tstat"]) if t else (None, None)
                rets.unpersist()
            finally:
                panel.unpersist()
        except (ExpressionError, KeyError, ValueError) as e:
            out.error = str(e)
        return out

    def evaluate_all(self, expressions: list[str]) -> list[SignalResult]:
        """A result for each expression, in order, from one compiled batch: firm-years are evaluated together, and the
        stock-months of all signals are one table with a key, so that the number of jobs doesn't grow with the batch."""
        out = [SignalResult(e) for e in expressions]
        good: dict[str, int] = {}
        for i, (e, r) in enumerate(zip(expressions, out, strict=True)):
            try:
                parse(e, {c.lower() for c in self.firm_year.columns})
                good[f"s{i:05d}"] = i
            except ExpressionError as x:
                r.error = str(x)
        if not good:
            return out
        used = set().union(*(items(parse(expressions[i], {c.lower() for c in self.firm_year.columns})) for i in good.values())) | {"permno", "year", "form_year", "sic2"}
        # Firm-years and stock-months are read for bounds, for the stocks that count and for the panel: once they are worked out.
        with held(self.firm_year.select(*[c for c in self.firm_year.columns if c.lower() in used])) as (firms,):
            wide = evaluate(firms, {k: expressions[i] for k, i in good.items()}, winsorize_pct=1.0)
            sample = P.to_months(P.monthly_sample(self.stock_month, self.first_month), wide, [*good]).persist()
            self._compared(sample, good, out)
        return out

    def _compared(self, sample: DataFrame, good: dict[str, int], out: list[SignalResult]) -> None:
        try:
            share = sample.agg(*[(F.count(k) / ((F.max("month_idx") - F.min("month_idx") + 1) * F.countDistinct("permno"))).alias(k) for k in good]).first()
            for k in [*good]:
                out[good[k]].coverage = share[k] or 0.0
                if out[good[k]].coverage < LEAST_COVERAGE:
                    out[good[k]].error = f"coverage {out[good[k]].coverage:.4f} is below {LEAST_COVERAGE}"
                    del good[k]
            if good:
                self._figures(sample, good, out)
        finally:
            sample.unpersist()

    def _figures(self, sample: DataFrame, good: dict[str, int], out: list[SignalResult]) -> None:
        panel = sample
        for k in good:
            panel = P.prepare_signal(panel, k, self.financials, self.microcaps)
        keys = ["signal_id"]
        # Dealt out as the lags of returns and of regressions both want it.
        long = panel.unpivot(["month_idx", "permno", "ret", "me", "nyse"], [*good], "signal_id", "signal").repartition(*keys, "permno").persist()
        try:
            betas = R.univariate_betas(long, "signal", keys=tuple(keys))
            for r in R.newey_west(betas, keys=tuple(keys)).collect():
                out[good[r.signal_id]].fmb_beta, out[good[r.signal_id]].fmb_tstat = r["mean"], r["tstat"]
            rets = S.portfolio_returns(S.univariate_sort(long, "signal", self.n_ptf, "nyse", keys=tuple(keys)), n_ptf=self.n_ptf, keys=tuple(keys)).persist()
            ls = S.long_short(rets, self.n_ptf, keys=tuple(keys)).select("month_idx", F.concat(F.lit("LS:"), "signal_id").alias("ptf"), F.col("ls").alias("ret"))
            for r in R.factor_regressions(ls, self.factors, self.factor_names, None).collect():
                if r.alpha is not None and r.alpha == r.alpha:
                    one = out[good[r.ptf[3:]]]
                    one.ls_alpha, one.ls_talpha, one.ls_sharpe = r.alpha * 12, r.talpha, r.sharpe
            for r in rets.groupBy("signal_id", "ptf").agg((F.avg("ret") * 1200).alias("m")).orderBy("signal_id", "ptf").collect():
                out[good[r.signal_id]].quintiles.append(r.m)
            rets.unpersist()
        finally:
            long.unpersist()

    def proposals(self, proposals: list[discovery.Proposal], generation: int) -> list[discovery.Evaluated]:
        """Evaluated proposals of a generation, in their order: one batch."""
        out = []
        for p, r in zip(proposals, self.evaluate_all([p.expression for p in proposals]), strict=True):
            out.append(discovery.Evaluated(**vars(p), generation=generation, fmb_tstat=r.fmb_tstat, ls_alpha=r.ls_alpha, ls_talpha=r.ls_talpha, ls_sharpe=r.ls_sharpe, coverage=r.coverage, error=r.error))
        return out


def multi_model(returns: DataFrame, tables: dict[str, tuple[DataFrame, list[str], str | None]], expected_sign: str = "positive", panel: DataFrame | None = None, signal: str = "signal") -> list[dict]:
    """A row for each factor model: LS alpha (annual), its t, Sharpe, GRS p, and whether it survives in the expected
    direction. With panel, a last row WLS_FMB: the signal's Fama-MacBeth t with market equity of the month before as weight."""
    out = []
    # Returns and factors are a few rows a month.
    with held(returns, *{id(t): t for t, _, _ in tables.values()}.values()) as (returns, *_):
        for name, (table, factors, rf) in tables.items():
            ls = R.factor_regressions(returns.where("ptf = 'LS'"), table, factors, rf).first()
            grs = R.grs_test(returns, table, factors, rf).first()
            ok = ls is not None and ls.talpha is not None and ls.talpha == ls.talpha
            t = (-ls.talpha if expected_sign == "negative" else ls.talpha) if ok else None
            out.append({"model": name, "alpha": ls.alpha * 12 if ok else None, "talpha": ls.talpha if ok else None, "sharpe": ls.sharpe if ok else None, "grs_p": grs.p_value if grs else None, "fmb_tstat": None, "status": "ok" if ok else "not_estimable", "reason": None if ok else "non_finite_alpha_t", "direction_consistent": bool(ok and t > 0), "survives_196": bool(ok and t > 1.96)})
    if panel is not None:
        t = {r.name: r.tstat for r in R.fama_macbeth(panel, [signal], weight="me").collect()}.get(signal)
        ok = t is not None and t == t
        up = None if not ok else -t if expected_sign == "negative" else t
        out.append({"model": "WLS_FMB", "alpha": None, "talpha": None, "sharpe": None, "grs_p": None, "fmb_tstat": t if ok else None, "status": "ok" if ok else "not_estimable", "reason": None if ok else "non_finite_wls_fmb_t", "direction_consistent": bool(ok and up > 0), "survives_196": bool(ok and up > 1.96)})
    return out


def incomplete(done: list[dict], wanted: list[str], models: list[str]) -> list[str]:
    """Signals (by signal_id) of a run to be resumed that lack a complete row: one with every model, none in error."""
    whole = {r["signal_id"] for r in done if r.get("status") != "error" and {m["model"] for m in r.get("results", ())} >= set(models)}
    return [s for s in wanted if s not in whole]
