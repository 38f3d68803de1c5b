"""The corpus queries: one per operator, over its whole table."""

from __future__ import annotations

from tessella.llm import bpe, decontam, langid, media, overlap_sql, pii, secrets, simhash, simhash_sql, span_sql, tokencount, urlfilter, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark, sf_dir):
    return media.media_round_trip(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.language_predictions(_table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op6_simhash(spark, sf_dir):
    return simhash.simhash_digest(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op8_secrets(spark, sf_dir):
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontam.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    import corpus_pipeline  # stands at the repository's top, and reads this package itself

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_media_chunks, op2_token_counts, op3_language_id, op4_pii, op5_warc, op6_simhash, op7_url_filter, op8_secrets, op9_bpe, op10_decontamination, pipeline)}


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id,
             payload_bytes < 100 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) = 1 AS is_first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT is_first THEN first_id END AS refers_to
FROM f
"""


def _op7_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    blocked = ", ".join(f"('{h}')" for h in urlfilter.BLOCKED)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}), blocked(h) AS (VALUES {blocked}),
r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fits AS (SELECT u.page_id, u.host, u.path, max(length(rules.h || rules.p)) AS n FROM u JOIN rules
         ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, rules.h || rules.p AS rule,
       CASE WHEN rules.v IS NOT NULL THEN rules.v
            WHEN EXISTS (SELECT 1 FROM blocked b WHERE u.host = b.h OR ends_with(u.host, '.' || b.h)) THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN fits USING (page_id, host, path)
LEFT JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p) AND length(rules.h || rules.p) = fits.n
"""


def oracle_sql():
    return {"op4_pii": span_sql.pii_sql(), "op5_warc": OP5_SQL, "op6_simhash": simhash_sql.simhash_sql(), "op7_url_filter": _op7_sql(), "op8_secrets": span_sql.secrets_sql(), "op10_decontamination": overlap_sql.overlap_sql()}
