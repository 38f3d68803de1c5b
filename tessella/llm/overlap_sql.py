"""Oracle SQL of decontamination: every diagonal on which enough words agree, and the best stretch of each, tried in full."""

from __future__ import annotations

from tessella.llm import decontam as D


def overlap_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    placed = "SELECT {k}, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM {t}"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), i AS (SELECT row_number() OVER () AS q, item_id, {words} AS w FROM benchmark),
dw AS ({placed.format(k='r', t='d')}), iw AS ({placed.format(k='q', t='i')}),
met AS (SELECT r, q, dw.p - iw.p AS shift, list_sort(list(iw.p)) AS spots FROM dw JOIN iw USING (word) GROUP BY r, q, dw.p - iw.p),
g AS (SELECT r, q, doc_id, item_id, shift, spots, len(d.w) AS n, len(i.w) AS m FROM met JOIN d USING (r) JOIN i USING (q) WHERE len(spots) >= least({D.MIN_WORDS}, len(i.w)) AND NOT (len(i.w) >= {D.SPAN} AND len(d.w) < {D.SPAN}) AND (len(i.w) >= {D.MIN_ITEM} OR len(d.w) = len(i.w))),
s AS (SELECT *, unnest(range(1, len(spots) + 1)) AS a FROM g), t AS (SELECT *, unnest(range(a, len(spots) + 1)) AS b FROM s),
u AS (SELECT r, q, doc_id, item_id, shift, m, b - a + 1 AS agree, spots[b] - spots[a] + 1 AS size, spots[a] AS first, spots[b] AS last FROM t),
v AS (SELECT *, agree - {D.PENALTY} * (size - agree) AS score FROM u QUALIFY row_number() OVER (PARTITION BY r, q, shift ORDER BY agree - {D.PENALTY} * (size - agree) DESC, last, first DESC) = 1),
x AS (SELECT * FROM v WHERE CASE WHEN m >= {D.SPAN} THEN score > 0 AND agree >= {D.MIN_WORDS} AND agree >= {D.MIN_SHARE} * size ELSE agree = m END QUALIFY row_number() OVER (PARTITION BY r, q ORDER BY agree DESC, shift + first, shift) = 1)
SELECT doc_id, item_id, CAST(agree AS INT) AS n_agree, CAST(size AS INT) AS n_words, agree / size AS share, CAST(shift + first AS INT) AS doc_start, CAST(first AS INT) AS item_start FROM x"""
