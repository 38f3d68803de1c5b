"""Each operator against a brute-force version on the awkward documents, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash

from tessella.llm import bpe, decontam, langid, media, pii, secrets, simhash, tokencount


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Media.
def test_gear_hash_rolls():
    data, h, slow = bytes(range(256)) * 3, 0, []
    for b in data:
        h = ((h << 1) + int(media.gear_table()[b])) & 0xFFFFFFFF
        slow.append(h)
    assert media.gear_hashes(data).tolist() == slow


def test_cuts_cover_and_keep_bounds():
    import random

    for n in (1, 1024, 1025, 5000, 200_000):
        data = random.Random(n).randbytes(n)
        ends = media.cuts(data)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert sum(sizes) == n and max(sizes) <= media.MOST and all(s >= media.LEAST for s in sizes[:-1])
    assert media.cuts(bytes(200_000))[0] == media.MOST  # no cut in sight


def test_shared_stretch_gives_shared_chunks():
    import random

    body = random.Random(1).randbytes(60_000)
    one, two = media._pieces(body), media._pieces(b"shifted by this" + body)
    assert len(set(one) & set(two)) > len(one) // 2


def media_truth(text):
    raw = (text or "").encode()
    p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    w = media.wave(p)
    total, squares = sum(p), sum((x - 128) ** 2 for x in p)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(p, p[1:], strict=False))
    feature = f"n={len(p)};min={min(p)};max={max(p)};mean={total / len(p):.4f};rms={(squares / len(p)) ** 0.5:.4f};crossings={crossings}"
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(w), hashlib.sha256(w).hexdigest(), feature, chunk_count(w)


def chunk_count(w):
    """Chunks by the hash rolled over byte by byte."""
    h, last, n = 0, 0, 0
    gear = media.gear_table().tolist()
    for i, b in enumerate(w, 1):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        if i - last == media.MOST or (h >> (32 - media.CUT_BITS) == 0 and i - last >= media.LEAST and i < len(w)):
            last, n = i, n + 1
    return n + (last < len(w))


@pytest.mark.parametrize("bits", [64, None])
def test_media_round_trip(spark, docs, rows, bits):
    """Also with a filter so small that it is full and passes every file."""
    from tessella.llm import storage

    store = media.build_store(docs, storage.work_folder(spark, "m"), filter_bits=bits)
    got = multiset(media.read_back(store), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
    assert got == Counter((i, *media_truth(t)) for i, t, _ in rows)
    kept = store.selectExpr("explode(filter(sequence(0, size(names) - 1), i -> NOT array_contains(lacks, CAST(i AS INT)))) AS i", "names").selectExpr("names[i] AS n")
    repeats = kept.groupBy("n").count().where("count > 1").count()
    assert repeats <= 1  # only of the row that comes three times over


def test_media_payload_and_corruption(spark, docs):
    from pyspark.sql import functions as F

    from tessella.llm import storage

    store = media.build_store(docs.where("doc_id = 3"), storage.work_folder(spark, "m"))
    assert media.read_back(store, with_payload=True).first().payload.rstrip(b" ").decode() == docs.where("doc_id = 3").first().text
    broken = store.withColumn("media_sha256", F.lit(b"0" * 32))
    with pytest.raises(Exception, match="doesn't match"):
        media.read_back(broken).collect()


# Token counts.
def edited(text, edits):
    for s, e, ins in edits:
        s = min(s, len(text))
        e = min(max(e, s), len(text))
        text = text[:s] + ins + text[e:]
    return text


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_vocabulary())
    tk.encode_special_tokens = True
    n = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    plan = {(r.doc_id, r.text): [(e.start, e.end, e.insert) for e in r.edits] for r in tokencount.sample_edits(docs.select("doc_id", "text")).collect()}
    import regex

    out = tokencount.token_counts(docs)
    pre = lambda t: len(regex.findall(bpe.WORDS, t))
    got = multiset(out, "doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_pretokens_after", "edited_sha256")
    assert got == Counter((i, n(t or ""), pre(t or ""), 3, n(y), pre(y), sha(y)) for i, t, _ in rows for y in [edited(t or "", plan[i, t])])
    # Few pre-tokens are encoded again, however long the document (a run of one sign is a single pre-token).
    assert all(r.n_reencoded <= 30 for r in out.collect())


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "kept")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 7, "2"), (2, 1, 0, 0, "new"), (9, 1, 0, 0, "nobody")], "doc_id long, seq int, start int, end int, insert string")
    out = tokencount.edited_counts(tokencount.with_edits(tokencount.build_trees(docs), edits)).collect()
    assert {r.doc_id: r.text_after for r in out} == {1: "1 2 three", 2: "new", 3: "kept"}


def test_tree_is_local():
    enc = bpe.Encoder(__import__("json").load(open(bpe.default_vocabulary())))
    tree = tokencount.PretokenTree("word " * 20_000, lambda w: enc[w][1])
    assert tree.edit(50_000, 50_004, "other") <= 5
    assert tree.n_tokens == len(enc.encode(tree.text))


# Language identification.
def test_languages(spark, docs, rows):
    out = langid.language_predictions(docs).collect()
    assert len(out) == len(rows)
    told = {r.doc_id: r for r in out}
    for i, t, _ in rows:
        if i is not None:
            assert told[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(told[i].lang_pred == "und" and told[i].score == 0 and told[i].rejected for i in (100, 101, 102, 104))
    ok = [told[i].lang_pred == lang for i, _, lang in rows[5:60] if told[i].held_out]
    assert sum(ok) / len(ok) > 0.9
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in out)


def test_languages_by_force(spark, docs, rows):
    """The same choice by a plain reading of the method: sampled pieces, one dictionary a language, least total."""
    import math

    import zstandard
    from pyspark.sql import functions as F

    frame = docs.select("doc_id", "text", "lang").withColumns({"h": F.xxhash64("text"), "c": F.crc32(F.col("doc_id").cast("string"))}).collect()
    learned: dict = {}
    for r in frame:
        if r.lang is not None and r.c is not None and r.c % 4 != 2 and any(map(str.isalpha, r.text or "")):
            learned.setdefault(r.lang, {})[r.h] = r.text[: langid.PIECE]
    letters = lambda t: " ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in t.lower()).split()).encode()
    packers = {}
    for lang, pieces in sorted(learned.items()):
        d = b" ".join(letters(pieces[h]) for h in sorted(pieces)[: langid.SAMPLE_DOCS])[-langid.DICTIONARY :]
        packers[lang] = lambda b, d=d: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
    want = Counter()
    for r in frame:
        got = ("und", 0.0, True)
        if any(map(str.isalpha, r.text or "")):
            t = letters(r.text)
            totals = sorted((sum(pack(t[i : i + langid.BLOCK]) for i in range(0, max(1, len(t)), langid.BLOCK)), lang) for lang, pack in packers.items())
            lead = (totals[1][0] - totals[0][0]) / totals[0][0]
            got = (totals[0][1], round(1 - math.exp(-lead / langid.SCALE), 6), lead < langid.MARGIN)
        want[(r.doc_id, r.c is not None and r.c % 4 == 2 if r.doc_id is not None else None, *got)] += 1
    assert multiset(langid.language_predictions(docs), "doc_id", "held_out", "lang_pred", "score", "rejected") == want


def test_only_so_many_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 4)
    monkeypatch.setattr(langid, "SPARE", 8)
    df = spark.createDataFrame([(f"word{i} of {i % 20}", f"l{i % 20:02d}" if i < 400 else "l19") for i in range(900)], "text string, lang string")
    assert sorted(langid.fit(df)) == ["l00", "l01", "l19"]


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_predictions(df).collect()] == ["und"]


# Personal data.
def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def emails(t):
    """Leftmost matches, each @ taken once: the run before it, and labels after it, of which two at least."""
    out, free = [], 0
    for m in re.finditer("@", t):
        if m.start() < free:
            continue
        a = m.start()
        while a > free and re.match(r"[A-Za-z0-9._%+-]", t[a - 1]):
            a -= 1
        tail = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match(t, m.end())
        if a < m.start() and tail:
            out.append(("email", a, tail.end()))
            free = tail.end()
    return out


def base_pii(t):
    out = emails(t)
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


TRICKY = [
    "a@b.c%d@e.f.g x@y z@@q.r .@-.-", "1.2.3.4.5.6.7.8 0001.002.3.4 256.1.1.1 1.2.3", "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 0000000000000 5 5 5", "+12 345 (678).90-1 +1234567890123456 ++44 20 7946 0958 +1 2",
    "😀 a@b.co 😀 10.1.1.1", "x" * 3000 + "@" + "y." * 3000 + "z", "1" * 5000, "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "call 212-555-0199 now" + "; nothing" * 9 + " id 212-555-0199",
]


def test_personal_data(spark, docs, rows):
    got = {(r.doc_id, r.base_sha256): r for r in pii.pii_digest(docs).collect()}
    for i, t, _ in rows:
        assert (i, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base_pii(t or "")))) in got
    tricky = spark.createDataFrame([*enumerate(TRICKY)], "doc_id long, text string")
    for r in pii.pii_digest(tricky).collect():
        base = base_pii(TRICKY[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == sha(text), (r, text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in pii.BASE)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    spans = {r.doc_id: r.spans for r in pii.pii_digest(tricky).collect()}
    assert spans[7] == "iban:0:27" and spans[8] == "phone_local:5:17"


def test_emails_by_force():
    import random

    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab@@.- %") for _ in range(r.randrange(25)))
        assert emails(t) == [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)], t


def mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_account_numbers(spark):
    made = []
    for n, countries in pii.IBAN_COUNTRIES.items():
        for k, c in enumerate(countries.split()):
            body = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[(7 * i + k) % 36] for i in range(n - 4))
            made.append(next(x for x in (f"{c}{d:02d}{body}" for d in range(100)) if mod97(x)))
    grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in made]
    texts = [f"iban {x}{after}" for x in (*made, *grouped) for after in (" PLEASE", " BIC NWBKGB2L", " 12 and 7", ".", " Thank you")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        end = 5 + len((*made, *grouped)[i // 5])
        assert f"iban:5:{end}" in got[i].split(","), (t, got[i])
    wrong = [f"iban {x[:2]}{(int(x[2:4]) + 1) % 100:02d}{x[4:]} PLEASE" for x in made] + [f"iban X{x}" for x in made] + [f"iban {x}A" for x in made]
    assert not any("iban" in r.spans for r in pii.pii_digest(spark.createDataFrame([*enumerate(wrong)], "doc_id long, text string")).collect())


def test_personal_data_masked(spark):
    df = spark.createDataFrame([(1, "to a@b.co or +1 (212) 555-0199."), (2, None), (3, "clean")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.mask_personal_data(df).collect()} == {1: "to <email> or <phone>.", 2: "", 3: "clean"}


# Secrets.
def base_secrets(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(1)) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


LEAKY = ["PassWord: 'abcdefgh' TOKEN=short secret=long_enough== apikey=x api_key:AAAAAAAAA", "AKIAAKIAAKIA1234 AKIA1 xAKIA0000000000000", "f" * 31 + " " + "e" * 32 + "g" + "0" * 40, "token=" + "ab" * 20, "tokentoken = abcdefgh = ijklmnop", "ſecret=abcdefghi toKen=abcdefghi"]


def test_secrets(spark, docs, rows):
    got = multiset(secrets.secrets_digest(docs), "doc_id", "base_sha256")
    assert got == Counter((i, sha(base_secrets(t or ""))) for i, t, _ in rows)
    leaky = spark.createDataFrame([*enumerate(LEAKY)], "doc_id long, text string")
    for r in secrets.secrets_digest(leaky).collect():
        assert r.base_sha256 == sha(base_secrets(LEAKY[r.doc_id])), (r, base_secrets(LEAKY[r.doc_id]))


EXTRA = {  # the further kinds, read plainly
    "github": r"(?<![A-Za-z0-9])gh[opsur]_[A-Za-z0-9]{36,}",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{20,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}


def test_further_kinds_by_force(spark):
    import random

    r, parts = random.Random(8), ["ghp_", "ghx_", "gho_" + "a1" * 18, "xoxb-", "xoxb-" + "12-ab" * 5, "eyJ", "eyJ" + "x" * 12, ".", "_", "-", " ", "Z" * 36, "q9" * 11, "é", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(400)]
    want = {i: {f"{k}:{m.start()}:{m.end()}" for k, p in EXTRA.items() for m in re.finditer(p, t)} for i, t in enumerate(texts)}
    rows = secrets.secrets_digest(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sum(map(len, want.values())) > 100
    assert {x.doc_id: {s for s in x.spans.split(",") if s.split(":")[0] in EXTRA} for x in rows} == want


def test_an_update_without_news_moves_no_text(spark, tmp_path):
    """Texts that are scanned or left out don't pass an exchange: only those of blobs that several paths hold do."""
    texts = [(i, f"password=abcdefgh{i} " + "x" * 500) for i in range(300)] + [(1000 + i, "shared text token=abcdefgh1 " + "y" * 500) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    ledger = secrets.Ledger(spark)
    tracker = spark.sparkContext.statusTracker()

    def moved(group):
        spark.sparkContext.setJobGroup(group, group)
        secrets.find_secrets(docs, ledger=ledger).count()
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        total = 0
        for s in stages:
            data = store.stageData(s, False, spark.sparkContext._jvm.java.util.ArrayList(), False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0))
            total += sum(data.apply(k).shuffleWriteBytes() for k in range(data.size()))
        return total

    first, second = moved("first-update"), moved("second-update")
    assert ledger.rows().count() == 301
    # Ids and digests alone: 350 rows of some 100 bytes each time it is asked.
    assert second <= first and second < 350 * 500


def test_ledger_scans_only_what_is_new(spark, docs):
    ledger = secrets.Ledger(spark)
    one = multiset(secrets.find_secrets(docs, ledger=ledger), "doc_id", "blob")
    n = ledger.rows().count()
    assert multiset(secrets.find_secrets(docs, ledger=ledger), "doc_id", "blob") == one and ledger.rows().count() == n
    more = spark.createDataFrame([(900, "password=abcdefgh1"), (901, "password=abcdefgh1")], "doc_id long, text string")
    assert secrets.find_secrets(more, ledger=ledger).where("size(findings) = 1").count() == 2 and ledger.rows().count() == n + 1
    assert secrets.Ledger(spark, ledger.folder, rules="2").rows().count() == 0


def test_redaction(spark):
    text = 'a token="' + "ab" * 20 + '" z'
    df = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, None, 0), (3, "fine", 4)], "doc_id long, text string, n_chars long")
    assert multiset(secrets.redacted(df), "doc_id", "text", "n_chars") == Counter({(1, 'a <assign>" z', 5): 2, (2, None, 0): 1, (3, "fine", 4): 1})


def test_private_keys_go_with_their_bodies(spark):
    body = "\n".join(["MIIEpAIBAAKCAQEA" + "b8/+" * 12] * 20)
    head, last = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"x {head}\n{body}\nQUI=\n{last} y", f"x {head}\nProc-Type: 4,ENCRYPTED\n\n{body}\n{last}", f"x {head}\n{body}\nQUI=\nand more", f"x {head} and more", f'"{head}\\n' + body.replace("\n", "\\n") + '\\n", more', head + "A" * 300_000 + "-" * 300 + head * 2000]
    want = ["x <private_key> y", "x <private_key>", "x <private_key>\nand more", "x <private_key> and more", '"<private_key>\\n", more', "<private_key>" + "-" * 300 + "<private_key>" * 2000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in secrets.redacted(df).collect()} == dict(enumerate(want))


# SimHash.
def plain_fingerprint(t, n=3):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows):
    rows = [(i, t) for i, t, _ in rows]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = Counter((i, f"{fps[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows))
    assert multiset(simhash.simhash_digest(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    import itertools

    masks = simhash.covering_masks([*range(20)], radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(20), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("small", [2, 8, 32])
def test_links_in_dense_balls(spark, small):
    import random

    r = random.Random(small)
    points = {r.getrandbits(64)}
    while len(points) < 400:
        x = r.choice([*points])
        for _ in range(r.choice([1, 2, 3])):
            x ^= 1 << r.randrange(64 if r.random() < 0.2 else 14)
        points.add(x)
    points = [simhash._signed(x) for x in points]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(points) for b in points[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    got = [(x.u, x.v) for x in simhash.links_within(spark.createDataFrame([(p,) for p in points], "fp long"), 2, small).collect()]
    assert len(got) == len(want) and set(got) == want


def test_distinct_documents(spark, docs, rows):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    once = sorted({(i is None, i if i is not None else 0, t or "") for i, t, _ in rows})
    sets = [sh(t) for _, _, t in once]
    pairs = [(a, b) for a in range(len(once)) for b in range(a) if once[a][2] == once[b][2] or (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1) >= 0.8]
    root = classes(range(len(once)), pairs)
    kept = Counter((None if once[k][0] else once[k][1], once[k][2]) for k in set(root.values()))
    got = simhash.distinct_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in got.collect()) == kept


def near_copies(r, n, words, changed, vocabulary=20000):
    """Pairs of texts, the second with `changed` words replaced, and their five-word similarities."""
    out = []
    for _ in range(n):
        a = [f"w{r.randrange(vocabulary)}" for _ in range(words)]
        b = list(a)
        for at in r.sample(range(words), changed):
            b[at] = f"x{r.randrange(vocabulary)}"
        a, b = " ".join(a), " ".join(b)
        out.append((a, b, simhash.similarity(simhash.shingles(a.encode(), 5), simhash.shingles(b.encode(), 5))))
    return out


def test_near_copies_at_the_bound(spark):
    import random

    r = random.Random(2)
    pairs = [p for w, c in ((150, 3), (300, 6), (60, 1)) for p in near_copies(r, 200, w, c) if p[2] >= 0.8]
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string").repartition(4)
    assert len(pairs) > 400 and sorted(p[2] for p in pairs)[len(pairs) // 2] < 0.86
    assert sorted(x.doc_id for x in simhash.distinct_documents(docs).collect()) == [2 * i for i in range(len(pairs))]


def test_near_copies_between_boilerplate(spark):
    """Texts of one bucket that are near copies of one another, but not of its first or last."""
    import random

    r = random.Random(3)
    common, texts = [f"c{i}" for i in range(300)], []
    for _ in range(150):
        own = list(common)
        for at in r.sample(range(300), 10):
            own[at] = f"x{r.randrange(10**6)}"
        copy = list(own)
        copy[r.randrange(300)] = f"y{r.randrange(10**6)}"
        texts += [" ".join(own), " ".join(copy)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    root = classes(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if simhash.similarity(sets[a], sets[b]) >= 0.8])
    assert len(set(root.values())) == 150
    assert {x.doc_id for x in simhash.distinct_documents(docs).collect()} == set(root.values())
    assert {x.doc_id for x in simhash.distinct_documents(docs, small=4).collect()} == set(root.values())


def test_near_copies_that_only_fingerprints_tell(spark):
    """At a similarity of 0.8 these share no bucket of minima, but a fingerprint."""
    docs = []
    for k in (1131, 9178, 9798):
        a = "a " * 200 + " ".join(f"w{k}n{i}" for i in range(8))
        sets = [simhash.shingles(t.encode(), 5) for t in (a, a + "x")]
        assert simhash.similarity(*sets) == 0.8 and not {*simhash.bands(simhash.minhashes(sets[0]))} & {*simhash.bands(simhash.minhashes(sets[1]))}
        assert plain_fingerprint(a) == plain_fingerprint(a + "x")
        docs += [(2 * k, a), (2 * k + 1, a + "x")]
    got = simhash.distinct_documents(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x.doc_id for x in got.collect()) == [2 * k for k in (1131, 9178, 9798)]


@pytest.mark.parametrize("small", [4, 32])
def test_texts_of_a_fingerprint_component_meet(spark, monkeypatch, small):
    """Without any bucket of minima, the copies among the texts of one component go, and no other text."""
    import random

    r, texts = random.Random(8), []
    for _ in range(30):  # fingerprints alike, texts not
        a = ["a"] * 200 + [f"w{r.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join(a), " ".join([*a[:-1], f"x{r.randrange(10**6)}"])]
    texts += [t for p in near_copies(r, 30, 200, 1) for t in p[:2]]
    r.shuffle(texts)
    fps, sets = [plain_fingerprint(t) for t in texts], [simhash.shingles(t.encode(), 5) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    group = classes(range(len(texts)), [(a, b) for a, b in pairs if (fps[a] ^ fps[b]).bit_count() <= 2])
    root = classes(range(len(texts)), [(a, b) for a, b in pairs if group[a] == group[b] and simhash.similarity(sets[a], sets[b]) >= 0.8])
    assert max(list(group.values()).count(g) for g in group.values()) > 32 and 60 < len(set(root.values())) < 90
    real = simhash.shared_buckets
    monkeypatch.setattr(simhash, "shared_buckets", lambda nodes: real(nodes.where("size(bands) = 1")))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in simhash.distinct_documents(docs, small=small).collect()} == set(root.values())


def test_large_buckets_are_compared_in_full(spark):
    import random

    r = random.Random(5)
    marks = [r.randbytes(simhash.SKETCH) for _ in range(60)]
    marks = [m if k == 0 else m[: simhash.AGREE + k] + r.randbytes(simhash.SKETCH - simhash.AGREE - k) for m in marks for k in (0, 3, 9)]
    nodes = spark.createDataFrame([(i - 90, m) for i, m in enumerate(marks)], "node long, sketch binary")
    met = nodes.selectExpr("7L AS bucket", "node", f"{len(marks)}L AS n", "-90L AS a", f"{len(marks) - 91}L AS b")
    groups = spark.createDataFrame([(i, -90) for i in (-90, -89, -85, 3)], "node long, root long")
    root = {-89: -90, -85: -90, 3: -90}
    agree = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= simhash.AGREE
    want = {(i - 90, j - 90) for j in range(len(marks)) for i in range(j) if agree(marks[i], marks[j]) and root.get(i - 90, i - 90) != root.get(j - 90, j - 90)}
    got = [(x.u, x.v) for x in simhash.unlinked_pairs(met, nodes, groups, block=25).collect()]
    assert len(want) > 150 and len(got) == len(want) and set(got) == want


def test_masks_of_radius_six_read_half_the_bits():
    import random

    masks, r = simhash.covering_masks([*range(64)], 6), random.Random(6)
    assert len(masks) == 127 and all(20 <= m.bit_count() <= 44 for m in masks)
    for _ in range(3000):
        apart = sum(1 << b for b in r.sample(range(64), 6))
        assert any(not m & apart for m in masks)


def test_components(spark):
    import random

    from tessella.llm import graph

    r = random.Random(12)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(i, 600) for i in range(570, 600)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(-5, 3), (3, 3), (7, 8), (8, 7)]
    want = classes({x for p in links for x in p}, links)
    got = {x.node: x.root for x in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    alone = {n for n in want if all(n not in p or p[0] == p[1] for p in links)}
    assert got == {n: x for n, x in want.items() if n not in alone}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_and_null_ids_lose_no_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, "another clean text that shares an id with a copy"), (None, base + " end"), (None, "z " * 9 + "clean")]
    got = simhash.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.text) for x in got} == {rows[0], rows[2], rows[4]}


# BPE.
def test_bpe(spark, docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for i, t, _ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False))] += 1
    assert multiset(bpe.bpe_digest(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    texts = bpe.decode_ids(bpe.encode_texts(docs))
    assert multiset(texts, "doc_id", "text") == Counter((i, t or "") for i, t, _ in rows)


def test_automaton_on_random_strings():
    import json
    import random

    from tokenizers import Tokenizer

    tk, enc, r = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Encoder(json.load(open(bpe.default_vocabulary())), cache_words=50), random.Random(4)
    texts = ["".join(r.choice("aAbett  hings'r\n.-=0é€") for _ in range(r.randrange(80))) for _ in range(3000)] + ["-" * 9000, "ab" * 9000]
    for t, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t).tolist() == e.ids and enc.decode(e.ids) == t


# Decontamination.
ITEM = "many small rivers cross the old northern plain before they meet the wide grey sea near the harbour"


def test_contamination(spark, docs):
    words = ITEM.split()
    changed = [w if i % 6 != 3 else "blue" for i, w in enumerate(words)]
    texts = [ITEM, "intro " + ITEM.upper().replace(" ", " !! ") + " outro", " ".join(changed), " ".join(words[4:14]), " ".join(words[:6]), "clean words only", None, "", "tiny item of five", ITEM + " " + ITEM]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "tiny item of five words"), (3, None), (4, "the of"), (5, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_words) for r in decontam.find_overlaps(df, items).collect()}
    assert {d for d, _ in got} == {0, 1, 2, 9} and {i for _, i in got} == {1, 5}
    assert got[0, 1] == (len(words), len(words)) and got[2, 1][0] >= 8
    assert {r.doc_id for r in decontam.clean(df, items).collect()} == {3, 4, 5, 6, 7, 8}
    assert decontam.find_overlaps(docs, items).where("item_id = 1").count() == 0
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.find_overlaps(df, items.limit(0)).count() == 0
    assert decontam.find_overlaps(df.limit(0), items).count() == 0 and decontam.clean(df.limit(0), items).count() == 0


def overlap_by_force(text, item, least=decontam.MIN_ITEM):
    """The overlap of a text and an item by trying every stretch of every diagonal."""
    w, x = (re.sub(r"[^A-Za-z0-9\x80-\U0010ffff]+", " ", s or "").lower().split() for s in (text, item))
    if not w or not x or len(x) >= decontam.SPAN > len(w) or (len(x) < least and len(w) != len(x)):
        return None
    found = []
    for shift in range(1 - len(x), len(w)):
        lo, hi = max(0, -shift), min(len(x), len(w) - shift)
        agree = [x[i] == w[i + shift] for i in range(lo, hi)]
        sums = [0]
        for k in agree:
            sums.append(sums[-1] + (1 if k else -decontam.PENALTY))
        score, end, first = max(((sums[b] - sums[a], -b, a) for b in range(1, len(sums)) for a in range(b)), default=(0, 0, 0))
        n, size = sum(agree[first:-end]), -end - first
        if score > 0 and ((n >= 8 and n >= 0.7 * size) if len(x) >= decontam.SPAN else n == len(x)):
            found.append((-n, lo + first + shift, shift, size, lo + first))
    if not found:
        return None
    n, start, _, size, at = min(found)
    return -n, size, start, at


def test_overlaps_by_force(spark):
    import random

    r = random.Random(11)
    words = ["a", "b"]
    items = [(i if i % 7 else None, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 8, 11, 12, 20, 30])))) for i in range(40)] + [(3, None), (3, "a b a b")]
    texts = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.choice([0, 2, 4, 9, 12, 40]))]
        if i % 2:
            t += [w if r.random() < 0.9 else "zz" for w in items[i % 40][1].split()] + [r.choice(words)] * r.choice([0, 3])
        texts.append((i if i % 9 else None, r.choice([" ", ", ", "\n"]).join(t)))
    texts += [texts[1], texts[1], (5, None), (6, "a b a b"), (6, "a b")]
    want = Counter()
    for d, t in texts:
        for i, x in items:
            got = overlap_by_force(t, x)
            if got:
                want[d, i, *got] += 1
    got = decontam.find_overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 200 and multiset(got, "doc_id", "item_id", "n_agree", "n_words", "doc_start", "item_start") == want


def test_repetitive_texts_stay_small(spark):
    import time

    import numpy as np

    text, item = decontam.word_hashes([b"again " * 20_000])[0], decontam.word_hashes([b"again " * 500])[0]
    began = time.time()
    assert decontam.best_overlap(text, item) == (500, 500, 1.0, 0, 0) and time.time() - began < 20
    assert all(len(x) <= 7 for x in decontam.text_seeds(text, np.array([0, len(text)]), lambda h: np.ones(len(h), bool), []))
    df = spark.createDataFrame([(1, "again " * 20_000), (2, "clean")], "doc_id long, text string")
    assert [r.doc_id for r in decontam.clean(df, spark.createDataFrame([(1, "again " * 500)], "item_id long, text string")).collect()] == [2]


def test_planted_passages_with_substitutions(spark):
    import random

    r = random.Random(9)
    vocabulary = [f"w{r.randrange(5000)}" for _ in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(20)]
    docs = []
    for i, t in items:
        w = t.split()
        for at in r.sample(range(40), 5):
            w[at] = "changed"
        docs.append((i, " ".join(r.choice(vocabulary) for _ in range(200)) + " " + " ".join(w)))
    docs += [(100 + i, " ".join(r.choice(vocabulary) for _ in range(300))) for i in range(30)]
    got = decontam.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(i, i) for i in range(20)}


def overlap_of(text, item):
    """[the overlap] of a text and an item that share a seed, else []."""
    import numpy as np

    (w, _), (x, _) = decontam.word_hashes([text.encode()]), decontam.word_hashes([item.encode()])
    _, seeds = decontam.text_seeds(w, np.array([0, len(w)]), lambda h: np.ones(len(h), bool), [len(x)])
    got = decontam.best_overlap(w, x) if np.isin(decontam.item_seeds(x), seeds).any() else None
    return [] if got is None else [got]


def best_stretch(agree):
    """(score, agreeing words, words) of the best stretch, by trying all; of equal ones the one that ends first."""
    score = lambda a, b: sum(1 if x else -decontam.PENALTY for x in agree[a:b])
    top = max(((score(a, b), -b, a) for b in range(1, len(agree) + 1) for a in range(b)), default=(0, 0, 0))
    return top[0], sum(agree[top[2] : -top[1]]), -top[1] - top[2]


@pytest.mark.parametrize("words", [11, 12, 13])
def test_every_replacement_pattern_is_found(words):
    import itertools

    item = [f"w{i}" for i in range(words)]
    for agree in itertools.product([True, False], repeat=words):
        score, n, size = best_stretch(agree)
        found = overlap_of(" ".join(["before"] * 3 + [w if k else "other" for w, k in zip(item, agree, strict=True)] + ["after"] * 3), " ".join(item))
        assert [f[:2] for f in found] == ([(n, size)] if score > 0 and n >= 8 and n >= 0.7 * size else []), agree


@pytest.mark.parametrize("every", range(4, 12))
@pytest.mark.parametrize("first", range(4))
def test_regular_replacements_are_found(every, first):
    item = [f"w{i}" for i in range(60)]
    text = " ".join("other" if i % every == first else w for i, w in enumerate(item))
    assert len(overlap_of(text, " ".join(item))) == 1


@pytest.mark.parametrize("run", [media.media_round_trip, tokencount.token_counts, langid.language_predictions, pii.pii_digest, secrets.secrets_digest, simhash.simhash_digest, simhash.distinct_documents, bpe.bpe_digest, secrets.redacted])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
