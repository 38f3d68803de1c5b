"""Personal data in texts: expressions propose, checksums confirm, context words adjust the score.

Only built-in functions run, so the scan stays in the JVM and needs no shuffle: one narrow pass
over the texts, whatever their number. Null texts count as empty. Repeated rows give repeated
results; an empty table gives an empty one. Columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import spans as S

# The base patterns. Quantifiers are possessive and starts are held to the start of a
# run (or the end of the last match), which changes no match and keeps every walk linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Account numbers have a length by country, so that words that follow can't be taken for their end.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()) + r")(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+().-])(?<![0-9+().-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"

BASE = ("email", "ip", "card", "phone")
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "phone_local": LOCAL}

_OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

#: Score a kind starts from, and what a word near it adds or takes.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "phone_local": 0.4}
FOR = {
    "email": "mail|contact|write",
    "ip": "address|server|host|client",
    "card": "card|visa|credit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account",
    "phone_local": "phone|tel|call|mobile|fax",
}
AGAINST = "version|serial|order|isbn|invoice"
NEAR, GAIN, LOSS = 32, 0.2, 0.2
#: Least score of the spans that the method adds; base spans stay whatever their score.
KEEP = 0.6


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, spaces removed, leaves 1 modulo 97 (its first four signs moved to the end)."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    v = s["value"]
    if kind == "ip":
        return v.rlike(IP_OK)
    if kind == "card":
        digits = F.regexp_replace(v, "[^0-9]", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(v, F.lit(" "), F.lit("")))
    return F.lit(True)


def _score(kind: str, text: Column, s: Column) -> Column:
    left = F.greatest(s["start"] - NEAR, F.lit(0))
    around = F.lower(F.concat_ws(" ", text.substr(left + 1, s["start"] - left), text.substr(s["end"] + 1, F.lit(NEAR))))
    score = F.lit(PRIOR[kind]) + F.when(around.rlike(FOR[kind]), GAIN).otherwise(0.0) - F.when(around.rlike(AGAINST), LOSS).otherwise(0.0)
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def _scored(kind: str, s: Column) -> Column:
    return s.withField("score", F.round(_score(kind, F.col("text"), s), 2))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, found): found holds (kind, start, end, value, score) by kind as listed, then start."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("digits", F.col("text").rlike("[0-9]{2}|[0-9][\x20.-][0-9]"))
    # A text that lacks what every match of a kind must hold is not walked for that kind.
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"m_{k}": F.when(needs.get(k, F.col("digits")), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in KINDS.items()})
    df = df.withColumns({f"p_{k}": S.pieces(F.col("text"), p, F.col(f"m_{k}")) for k, p in KINDS.items()})
    df = df.withColumns({f"s_{k}": S.located(F.col(f"m_{k}"), F.col(f"p_{k}"), k) for k in KINDS})
    df = df.withColumns({f"v_{k}": F.filter(f"s_{k}", S.bound(_valid, k)) for k in KINDS})
    out = []
    for k in KINDS:
        scored = F.transform(f"v_{k}", S.bound(_scored, k))
        out.append(scored if k in BASE else F.filter(scored, lambda s: s["score"] >= KEEP))
    return df.select("doc_id", "text", F.concat(*out).alias("found"))


def pii_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: base counts, hash of the base spans, all spans."""
    df = find_personal_data(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = {f"n_{k}": F.size(F.filter("found", S.bound(S.is_kind, k))).cast("long") for k in BASE}
    return df.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(F.concat_ws(",", S.as_text(base)), 256).alias("base_sha256"),
        F.concat_ws(",", S.as_text(F.col("found"))).alias("spans"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def mask_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every found span replaced by <kind>; overlapping spans become one of the first's kind."""
    from tessella.llm.secrets import replaced

    df = find_personal_data(docs, id_col, text_col)
    return df.select("doc_id", replaced(F.col("text"), F.col("found")).alias("text"))
