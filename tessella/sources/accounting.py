"""Accounting sources: annual and quarterly items, links to stocks, firm-years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalar
from tessella.plans.catalog import VARIABLES

# Item lists and the filters of standardised domestic consolidated statements.
ANNUAL_KEYS = ("gvkey", "datadate", "fyear", "fyr")
QUARTERLY = (
    "gvkey", "datadate", "fyearq", "fqtr", "rdq", "atq", "ceqq", "ibq", "saleq", "revtq", "cogsq", "xsgaq", "actq", "lctq", "cheq", "rectq", "invtq", "apq",
    "dlttq", "dlcq", "ppentq", "txtq", "niq", "oibdpq", "cshoq", "prccq",
)
STANDARD = {"indfmt": "INDL", "datafmt": "STD", "popsrc": "D", "consol": "C"}
LINK_TYPES, LINK_PRIMARY, OPEN_END = ("LU", "LC"), ("P", "C"), "2099-12-31"


def annual_columns() -> list[str]:
    return [*ANNUAL_KEYS, *sorted(VARIABLES), "sich"]


def scan_statements(raw: DataFrame, columns: list[str] | tuple[str, ...], start: str, end: str) -> DataFrame:
    """Standard statements dated start to end: filters and projection reach the scan. sic is the statement's code."""
    df = raw.where(F.col("datadate").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    for name, value in STANDARD.items():
        df = df.where(F.col(name) == value)
    df = df.select(*[c for c in columns if c in df.columns])
    return df.withColumn("sic", F.col("sich")) if "sich" in df.columns else df


def annual(raw: DataFrame, start: str = "1960-01-01", end: str = "2099-12-31") -> DataFrame:
    return scan_statements(raw, annual_columns(), start, end)


def quarterly(raw: DataFrame, start: str = "1960-01-01", end: str = "2099-12-31") -> DataFrame:
    return scan_statements(raw, QUARTERLY, start, end)


def missing_columns(df: DataFrame, wanted: set[str] | frozenset[str] = VARIABLES) -> list[str]:
    return sorted(set(wanted) - {c.lower() for c in df.columns})


def with_book_equity(df: DataFrame) -> DataFrame:
    items = ("seq", "ceq", "pstk", "at", "lt", "txditc", "txdi", "itcb", "pstkrv", "pstkl")
    return df.withColumns(scalar.book_equity(*[F.col(f"`{c}`") for c in items]))


def link_table(raw: DataFrame) -> DataFrame:
    """Links of the usable types; an open end is far in the future."""
    df = raw.where(F.col("linktype").isin(*LINK_TYPES) & F.col("linkprim").isin(*LINK_PRIMARY))
    return df.select("gvkey", "permno", "linkdt", F.coalesce("linkenddt", F.lit(OPEN_END).cast("date")).alias("linkenddt"))


def link_firm_years(statements: DataFrame, links: DataFrame) -> DataFrame:
    """Statements of each stock by calendar year: linked where the date lies in the link's interval (an equi-join
    on gvkey with the interval as its residual); of several in a year, the last by date, then gvkey."""
    inside = (F.col("datadate") >= F.col("linkdt")) & (F.col("datadate") <= F.col("linkenddt"))
    df = statements.join(links, "gvkey").where(inside).drop("linkdt", "linkenddt").withColumn("year", F.year("datadate"))
    last = Window.partitionBy("permno", "year").orderBy(F.desc("datadate"), F.desc("gvkey"))
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n").withColumn("form_year", F.col("year") + 1)


def firm_years(statements: DataFrame, links: DataFrame, june_sic: DataFrame | None = None) -> DataFrame:
    """The firm-year table of the expression language: items, NULL for NaN and infinities, and sic2 (the statement's
    code, else the June code (permno, form_year, siccd) of the formation year)."""
    df = link_firm_years(statements, links)
    items = [c for c in df.columns if c.lower() in VARIABLES]
    df = df.withColumns({c: scalar.clean(F.col(f"`{c}`")) for c in items})
    code = F.col("sic") if "sic" in df.columns else F.lit(None).cast("double")
    if june_sic is not None:
        df = df.join(june_sic.select("permno", "form_year", F.col("siccd").alias("__june")), ["permno", "form_year"], "left")
        return df.withColumn("sic2", scalar.sic2(F.coalesce(code.cast("double"), F.col("__june").cast("double")))).drop("__june")
    if "sic" not in df.columns:
        raise ValueError("industry operators need a statement SIC or June SIC codes")
    return df.withColumn("sic2", scalar.sic2(code.cast("double")))


def june_sic(stock_month: DataFrame) -> DataFrame:
    """(permno, form_year, siccd): each stock's code in June of the formation year."""
    return stock_month.where(F.month("month_end") == 6).select("permno", F.year("month_end").alias("form_year"), "siccd").dropDuplicates(["permno", "form_year"])
