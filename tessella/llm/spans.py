"""Regular-expression spans with code-point positions, from built-in functions alone.

`regexp_extract_all` gives the matches and `split` the pieces between them; both walk the text
with the same matcher, so the running sum of their lengths gives every start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces summed in one go; positions of longer lists are carried block by block, so that the
#: cost of n matches is n times this and not n squared.
BLOCK = 64

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """Text between the matches; null where there are none, so that most rows skip the second walk."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1))


def located(found: Column, between: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) for matches and the pieces between them."""
    none = F.array().cast(SPAN)
    steps = F.zip_with(
        F.transform(F.slice(between, 1, F.size(found)), F.length),
        found,
        lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("len"), m.alias("value")),
    )

    def grow(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + s["len"]).alias("end"), s["value"].alias("value"))
        return F.struct((start + s["len"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        part = F.aggregate(F.slice(steps, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), grow)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(blocks, zero, block)["out"])).otherwise(none)


def as_text(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def bound(f, value):
    """f(value, element) as a function of the element alone, as higher-order functions want it."""
    return lambda s: f(value, s)


def is_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind
