"""WARC archives, URL filters, the queries' wiring and the pipeline, on awkward rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, storage, urlfilter, warc

PAGES = [
    (1, "https://Blog.Example.ORG/es/1?x#y", "<p>" + "a" * 200), (2, "http://m.example.com/fr/2", "<p>" + "a" * 200), (3, "http://x.example.com/de/", "short"), (4, "http://y.org/", "short"),
    (5, None, None), (6, "no scheme/org/", "é" * 60), (7, "a://example.org/en/1x", "é" * 60), (7, "a://example.org/en/2", "é" * 60), (None, "ftp://www.spam-farm.example.net", "b" * 150), (8, "s://spam-farm.example.net?q", "b" * 150),
    (9, "x://y://org/z", "c" * 99), (10, "x://org", "c" * 99), (11, "x://ORG/\nb", "d" * 100), (12, "x://fooorg/", ""), (13, "x://com/de", "e" * 300), (14, "x://a..com/de/#", "e" * 300),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("digest", "first", "known", "host", "path", "keys", "hits", "file", "offset")}).repartition(3)


def warc_truth():
    out, first = Counter(), {}
    for i, _, h in PAGES:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    for i, _, h in PAGES:
        p = (h or "").encode()
        to = first.get(p) if len(p) >= 100 and first.get(p, i) != i else None
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if to is not None else "response", to] += 1
    return out


def test_warc(pages):
    assert Counter(tuple(r) for r in warc.warc_round_trip(pages).collect()) == warc_truth()
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_pages_that_come_twice(spark):
    big = "z" * 200
    rows = [(2, "u", big), (1, "b", big), (1, "a", big), (1, "a", big), (1, "a", big), (5, "x", "w" * 300), (5, "x", "w" * 300), (None, "n", "v" * 150), (None, "n", "v" * 150), (9, "s", "short"), (9, "s", "short")]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(2, "revisit", 1): 1, (1, "revisit", 1): 3, (1, "response", None): 1, (5, "response", None): 1, (5, "revisit", 5): 1, (None, "response", None): 1, (None, "revisit", None): 1, (9, "response", None): 2}


def test_reading_is_dealt_out(spark):
    folder = storage.work_folder(spark, "w")
    import random

    text = lambda i: "".join(chr(random.Random(i).randrange(33, 127)) for _ in range(6000))
    index = warc.write_archives(spark.createDataFrame([(i, f"u{i}", text(i) * 40) for i in range(60)], "page_id long, url string, html string"), folder)
    assert index.agg({"length": "sum"}).first()[0] > 0
    assert warc.read_records(index.withColumn("length", F.col("length")), folder).count() == 60


def test_selected_records(spark, pages):
    folder = storage.work_folder(spark, "w")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index.where("page_id IN (1, 4)"), folder).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in got} == {(1, PAGES[0][1], PAGES[0][2]), (4, PAGES[3][1], "short")}


def judged(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    inside = lambda h: host == h or host.endswith("." + h)
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if inside(h) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict or ("block" if any(map(inside, urlfilter.BLOCKED)) else "allow")


@pytest.mark.parametrize("bits", [urlfilter.MAX_BITS, 64])
def test_urls(pages, bits):
    got = Counter(tuple(r) for r in urlfilter.judge_urls(pages, max_bits=bits).collect())
    assert got == Counter((i, *judged(u)) for i, u, _ in PAGES)
    assert urlfilter.judge_urls(pages.limit(0), max_bits=bits).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("hash(key) % 5 = 0")
    cascade = urlfilter.Part(listed, universe)
    assert len(cascade.levels) > 1
    got = cascade.with_filters(universe).where(cascade.listed(F.col("key"))).select("key")
    assert got.exceptAll(listed).count() == 0 and listed.exceptAll(got).count() == 0


@pytest.mark.parametrize("bits", [1 << 24, 6000, 700])
def test_cascades_in_parts_are_exact(spark, bits, monkeypatch):
    monkeypatch.setattr(urlfilter, "AT_ONCE", 2)
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("hash(key) % 5 = 0").unionByName(spark.sql("SELECT 'elsewhere' AS key"))
    cascade = urlfilter.Cascade(listed, universe, bits)
    assert cascade.n_parts == {1 << 24: 1, 6000: 1, 700: cascade.n_parts}[bits] and (bits > 700 or cascade.n_parts > 2)
    sets = spark.range(1000).select(F.expr("transform(sequence(0, 5), i -> concat('k', (id * 7 + i * 13) % 4000))").alias("keys"))
    got = [(tuple(r["keys"]), tuple(r["hits"])) for r in cascade.members(sets, "keys", "hits").collect()]
    want = {r["key"] for r in listed.collect()}
    assert len(got) == 1000 and all(hits == tuple(k for k in keys if k in want) for keys, hits in got)


def test_rules_as_tables(spark, pages):
    rules = spark.createDataFrame([*urlfilter.RULES, ("org", "/", "block"), (None, "/x", "block"), ("a#b", "/", "block")], "host string, path string, verdict string").coalesce(1)
    blocked = spark.createDataFrame([(b,) for b in [*urlfilter.BLOCKED, None]], "host string")
    got = Counter(tuple(r) for r in urlfilter.judge_urls(pages, rules, blocked).collect())
    assert got == Counter((i, *judged(u)) for i, u, _ in PAGES)
    assert {r.verdict for r in urlfilter.judge_urls(pages, (), (), "block").collect()} == {"block"}


def test_names():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == [*range(1, 11)]


def test_native_plans(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op4_pii", "op7_url_filter", "op8_secrets"):
        plan = queries.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as p
    from tessella.llm import langid

    items = spark.createDataFrame([(1, rows[20][1])], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame = docs
    for name, stage in p.STAGES[:-1]:
        frame = storage.cut(stage(spark, frame, str(tmp_path)), "t")
        assert frame.columns == [*p.COLUMNS], name
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert 100 not in texts and 104 not in texts  # no language
    assert 106 not in texts and 5 in texts  # a copy
    assert 20 not in texts  # a benchmark passage
    assert "hunter2" not in texts.get(112, "") and "<assign>" in texts[112]
    model = langid.fit(docs.where(langid.training_rows(docs)))
    rejected = {r.doc_id for r in langid.identify(docs.select(*p.COLUMNS), model).where("rejected").collect()}
    assert all(i in texts for i in range(60) if i not in rejected and i != 20)
    out = p.run(spark, str(tmp_path))
    assert out.count() == frame.count() and sum(len(r.token_ids) for r in out.collect()) == out.agg({"n_tokens": "sum"}).first()[0]
