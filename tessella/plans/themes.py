"""Themes of accounting items, and the 28 pairs of them that a search runs over."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The items of each theme, and the short names that pairs are labelled by.
THEMES = {
    "profitability": ("revt", "cogs", "xsga", "xint", "xrd", "ib", "ni", "oibdp", "oiadp", "oancf", "ebitda", "pi", "at", "ceq", "sale", "dp"),
    "valuation": ("ceq", "ib", "ni", "sale", "revt", "oancf", "ebitda", "dvc", "at", "dltt", "dlc", "che", "prcc_f", "csho"),
    "investment": ("at", "capx", "ppent", "ppegt", "invt", "emp", "aqc", "sstk", "dltt", "dlc", "che", "intan", "gdwl"),
    "accruals": ("ib", "oancf", "at", "act", "lct", "che", "dlc", "txp", "dp", "recch", "invch", "apalch", "txach", "aoloch", "dpc", "wcap"),
    "quality": ("ib", "oancf", "at", "ceq", "ni", "sale", "revt", "cogs", "dltt", "dlc", "lt", "act", "lct", "dp", "re"),
    "financing": ("prstkc", "sstk", "dltis", "dltr", "dvc", "dvt", "csho", "dltt", "dlc", "at", "ceq", "lt"),
    "intangibles": ("xrd", "xad", "intan", "gdwl", "sale", "at", "ceq", "revt", "cogs"),
    "distress": ("at", "lt", "ceq", "dltt", "dlc", "act", "lct", "ib", "ni", "sale", "re", "pi", "txt", "che", "oancf", "wcap"),
}
SHORT = {"profitability": "profit", "valuation": "value", "investment": "invest", "accruals": "accrual", "quality": "quality", "financing": "finance", "intangibles": "intangible", "distress": "distress"}

PAIRS = {f"{SHORT[a]}_{SHORT[b]}": (a, b) for a, b in combinations(THEMES, 2)}


# Names of themes in print.
PRINTED = {"profit": "Profitability", "value": "Valuation", "invest": "Investment", "accrual": "Accruals", "quality": "Quality", "finance": "Financing", "intangible": "Intangibles", "distress": "Distress"}


def printed_pair(pair: str) -> str:
    a, b = pair.split("_", 1)
    return f"{PRINTED[a]} x {PRINTED[b]}"


def printed_name(name: Column) -> Column:
    """A signal's name in words: underscores and hyphens become blanks, and humps are parted."""
    name = F.translate(name, "_-", "  ")
    for pattern in ("(?<=[a-z])(?=[A-Z])", "(?<=[A-Z])(?=[A-Z][a-z])", r"\s+"):
        name = F.regexp_replace(name, pattern, " ")
    return F.trim(name)


def exclusive_items(theme: str, others: list[str]) -> set[str]:
    """Items of a theme that none of the others has."""
    return set(THEMES.get(theme, ())) - {i for o in others for i in THEMES.get(o, ())}
