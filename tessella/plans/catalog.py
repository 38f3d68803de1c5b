"""What the expression language knows: variables and operators."""

from __future__ import annotations

from dataclasses import dataclass

# The accounting items, by statement, in their order.
BALANCE_SHEET = (
    "at", "ceq", "seq", "lt", "act", "lct", "che", "invt", "rect", "ppent", "ppegt", "intan", "gdwl", "dltt", "dlc", "ap", "ao", "lo", "aco", "xacc", "re", "mib",
    "pstkrv", "pstkl", "pstk", "txditc", "txdi", "itcb", "txp",
)
INCOME = ("revt", "sale", "cogs", "xsga", "xrd", "xint", "xad", "dp", "ib", "ni", "pi", "txt", "oibdp", "oiadp", "ebitda", "spi")
CASH_FLOW = ("oancf", "capx", "dpc", "recch", "invch", "apalch", "txach", "aoloch", "wcap", "fopt", "prstkc", "sstk", "dltis", "dltr", "dvc", "dvt", "aqc")
OTHER = ("emp", "csho", "ajex", "prcc_f")

VARIABLES = frozenset(BALANCE_SHEET + INCOME + CASH_FLOW + OTHER)


def variables_of(statement: str) -> tuple[str, ...]:
    """Items of BS (which holds the other items too), IS or CF."""
    return {"BS": BALANCE_SHEET + OTHER, "IS": INCOME, "CF": CASH_FLOW}[statement]


@dataclass(frozen=True)
class Operator:
    """arity series arguments, then optional parameters; `least` bounds an integer parameter from below."""

    name: str
    category: str
    arity: int
    params: tuple[str, ...] = ()
    default: float | None = None
    least: int | None = None


def _ops() -> dict[str, Operator]:
    ops = [
        *(Operator(n, "core", 2) for n in ("RATIO",)),
        *(Operator(n, "core", 1, ("lag",), 1, 1) for n in ("GROWTH", "DELTA")),
        Operator("IND_ADJ", "core", 1),
        Operator("LAG", "temporal", 1, ("d",), 1, 1),
        Operator("MA", "temporal", 1, ("k",), 3, 1),
        Operator("VOL", "temporal", 1, ("k",), 5, 2),
        Operator("TREND", "temporal", 1, ("k",), 5, 3),
        Operator("ACCEL", "temporal", 1),
        *(Operator(n, "temporal", 1, ("k",), 5, 1) for n in ("TS_MIN", "TS_MAX", "TS_SUM", "TS_COUNT")),
        Operator("TS_RANK", "temporal", 1, ("k",), 5, 2),
        *(Operator(n, "composition", 2) for n in ("ADD", "SUB", "MUL", "SUMRANK", "COALESCE")),
        Operator("INDICATOR", "composition", 1, ("threshold",), 0.0),
        *(Operator(n, "math", 1) for n in ("ABS", "SIGN", "LOG", "INV", "NEG")),
        *(Operator(n, "math", 2) for n in ("MIN", "MAX")),
        *(Operator(n, "cross_section", 1) for n in ("ZSCORE", "RANK", "IND_ZSCORE", "IND_RANK")),
        Operator("WINSOR", "cross_section", 1, ("p",), 1.0),
    ]
    return {o.name: o for o in ops}


OPERATORS = _ops()


def operators_of(category: str) -> list[Operator]:
    return [o for o in OPERATORS.values() if o.category == category]
