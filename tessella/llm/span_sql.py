"""Oracle SQL of the scans for personal data and secrets: the same kinds, told without looking behind or ahead.

A kind's expression takes in the signs that must stand before and after it, and a second one cuts out the match.
Positions are sums of the lengths of matches and of the pieces between them.
"""

from __future__ import annotations

from tessella.llm import pii, secrets

_NO_LETTER = "(?:^|[^A-Za-z0-9])"
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_BLANK = r"(?:[ \t\n\x0B\f\r]|\\[rn])*"
_ASSIGN = f"(?:{_WORDS})" + r"""["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""
_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,20}PRIVATE KEY-----|"
    rf"(?:{_BLANK}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_BLANK}[A-Za-z0-9+/]+={{1,2}})?)"
)
#: kind: (expression, part of a match that is the span, condition on its value v).
SECRETS = {
    "assign": (_ASSIGN, None, r"""length(regexp_extract(v, '^[^:=]*[:=] *["'']?(.*)$', 1, 's')) >= 8"""),
    "access": ("AKIA[A-Z0-9]+", None, "length(v) >= 16"),
    "hex": ("[0-9a-f]+", None, "length(v) >= 32"),
    "github": (f"{_NO_LETTER}gh[opsur]_[A-Za-z0-9]{{36,}}", "gh[opsur]_.*", "true"),
    "slack": (f"{_NO_LETTER}xox[abprs]-[0-9A-Za-z-]{{20,}}", "xox[abprs]-.*", "true"),
    "jwt": (r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "eyJ.*", "true"),
    "private_key": (_KEY, None, "true"),
}

_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({_DIGITS}, -i, 1) AS INT) WHEN CAST(substr({_DIGITS}, -i, 1) AS INT) > 4 THEN 2 * CAST(substr({_DIGITS}, -i, 1) AS INT) - 9 ELSE 2 * CAST(substr({_DIGITS}, -i, 1) AS INT) END)) % 10 = 0"
_PLAIN = "replace(v, ' ', '')"
_TURNED = f"(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4))"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1"
_IBAN = "(?:" + "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in pii.IBAN_COUNTRIES.items()) + ")"
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", None, "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+){3}", None, "list_bool_and(list_transform(string_split(v, '.'), lambda x: ifnull(TRY_CAST(x AS HUGEINT) <= 255, false)))"),
    "card": ("[0-9](?:[ -]?[0-9])+", None, f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", None, f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "iban": (f"{_NO_LETTER}{_IBAN}(?:[^A-Za-z0-9]|$)", "[A-Za-z0-9].*[A-Za-z0-9]", _MOD97),
    "phone_local": (rf"(?:^|^ |[^0-9+(). -]|[^0-9+().-] ){_LOCAL}(?:[^0-9-]|$)", "[0-9(].*[0-9]", "true"),
}


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def spans(kinds: dict[str, tuple[str, str | None, str]]) -> str:
    """CTEs d (r, doc_id, t) and s (r, k, kind, a, b): the spans of every document, k the kind's place."""
    parts = []
    for k, (kind, (pattern, core, ok)) in enumerate(kinds.items()):
        p = _text(pattern)
        before = f"length(regexp_extract(m, {_text('^(?s:.)*?' + '(?:' + core + ')')}, 0)) - length(regexp_extract(m, {_text(core)}, 0, 's'))" if core else "0"
        value = f"regexp_extract(m, {_text(core)}, 0, 's')" if core else "m"
        parts.append(f"""SELECT r, {k} AS k, '{kind}' AS kind, a, a + length(v) AS b FROM (SELECT r, began + {before} AS a, {value} AS v FROM (
SELECT r, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + ifnull(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT))) AS began
FROM (SELECT r, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM d) WHERE len(ms) > 0)) WHERE {ok}""")
    return "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


_JOINED = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {order}){only}, '')"


def secrets_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    base, every = _JOINED.format(order="a, k", only=" FILTER (k < 3)"), _JOINED.format(order="a, k", only="")
    return f"WITH {spans(SECRETS)} SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {every} AS spans FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"


def pii_sql() -> str:
    words = lambda table: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
    near = f"lower(substr(t, greatest(a - {pii.NEAR}, 0) + 1, a - greatest(a - {pii.NEAR}, 0)) || ' ' || substr(t, b + 1, {pii.NEAR}))"
    score = f"round(greatest(least({words({k: f'CAST({v} AS DOUBLE)' for k, v in pii.PRIOR.items()})} + CASE WHEN regexp_matches({near}, {words({k: _text(v) for k, v in pii.FOR.items()})}) THEN {pii.GAIN} ELSE 0 END - CASE WHEN regexp_matches({near}, {_text(pii.AGAINST)}) THEN {pii.LOSS} ELSE 0 END, 1), 0), 2)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)
    base, every = _JOINED.format(order="k, a", only=f" FILTER (k < {len(pii.BASE)})"), _JOINED.format(order="k, a", only="")
    return f"""WITH {spans(PII)}, c AS (SELECT s.*, CAST({score} AS DOUBLE) AS score FROM s JOIN d USING (r)), f AS (SELECT * FROM c WHERE k < {len(pii.BASE)} OR score >= {pii.KEEP})
SELECT doc_id, {counts}, sha256({base}) AS base_sha256, {every} AS spans, coalesce(max(score), 0.0) AS top_score FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""
