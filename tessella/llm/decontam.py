"""Benchmark decontamination with spaced seeds.

A seed is a mask over consecutive words that reads SEED_WORDS of them and ignores the rest, so a
passage with words replaced still shares seeds with its source. The masks are all the ways in which
an overlap can begin, so each overlap of that many agreeing words or more holds a seed. The seed hashes
of the documents and of the test items are tables, and a join on the hash gives the documents and items
that share one. Around the hits of such a pair the item is laid over the document, and the best stretch
of it (an agreeing word counts 1, another -PENALTY) is the overlap. A document is contaminated by an
item if an overlap has at least MIN_WORDS agreeing words and these are at least MIN_SHARE of its words.
Of an item of fewer than SPAN words, all must agree, side by side; a document of fewer than SPAN words
is contaminated by such items only. An item of fewer than min_item words (MIN_ITEM) contaminates only
documents that are it, word for word.

Words are runs of letters, digits and non-ASCII signs, lower-cased in A-Z; other signs only part
words. Null texts are empty. Items without words match nothing. A null item_id is
kept as null. Of several overlaps of a document and an item, the one with most agreeing words is
reported, then the first. Repeated rows give repeated results; with no items nothing is
contaminated; an empty table gives an empty one; other columns are ignored or, by `clean`, kept.

At scale: documents are read in one narrow pass, which keeps the distinct seeds of a text that a filter
over the items' seeds passes (sized by their number, to a bound; a fuller one passes more and changes no
result). Only these seeds and the texts that have any move, each distinct text of a batch once. Nothing is
collected but the filter's words. A text of very many equal words has few distinct seeds, and is laid
against an item by whole diagonals, in blocks of a fixed size, not by pairs of positions. A worker holds
one batch of texts, and hashes texts in chunks of a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import storage

# Fixed values.
MIN_WORDS, MIN_SHARE, PENALTY, MIN_ITEM, SPAN, SEED_WORDS = 8, 0.7, 2, 5, 11, 6


def beginnings(read: int) -> tuple[str, ...]:
    """Every way in which a best stretch of at least `read` agreeing words can begin, up to the last of these: its score
    stays above 0. 1 is an agreeing word, 0 another."""
    out, grown = [], [("1", 1)]
    while grown:
        mask, score = grown.pop()
        if mask.count("1") == read:
            out.append(mask)
        else:
            grown += [(mask + "1", score + 1), *([(mask + "0", score - PENALTY)] if score > PENALTY else [])]
    return tuple(sorted(out, key=lambda m: (len(m), m)))


#: 1 reads a word, 0 ignores it.
MASKS = beginnings(SEED_WORDS)
#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Bits of the seed filter for each seed of the items.
BITS_A_SEED = 128
#: Words of items laid over words of a document at once.
CELLS = 1 << 22

HITS = "item_id {item}, n_agree int, n_words int, share double, doc_start int, item_start int"

_P, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as was asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, one after the other, and where each text's words begin."""
    joined = b" ".join(texts).translate(_LOWER)
    signs = np.frombuffer(joined, np.uint8)
    up, down = _powers.to(len(signs) + 1)
    inside = np.concatenate([[False], signs != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((signs.astype(np.uint64) + np.uint64(1)) * up[: len(signs)], dtype=np.uint64)])
    hashes = _mixed((sums[end] - sums[start]) * down[start])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return hashes, np.append(np.searchsorted(start, begins), len(start))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words that mask reads, at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, sum(1 << i for i, m in enumerate(mask) if m == "1") | len(mask) << 32, np.uint64)
    for i, m in enumerate(mask):
        if m == "1":
            out = out * np.uint64(_P) + words[i : i + n]
    return _mixed(out)


def masks_of(n: int, min_item: int = MIN_ITEM) -> tuple[str, ...]:
    """The masks that read an item of n words."""
    return MASKS if n >= SPAN else ("1" * n,) if n >= min_item else ()


#: Hash of a whole text of few words: told apart from that of a seed by another mask.
def whole_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a whole text of few words, told apart from that of a seed."""
    return _mixed(seed_hashes(words, "1" * len(words)) + np.uint64(1))


def item_seeds(words: np.ndarray, min_item: int = MIN_ITEM) -> np.ndarray:
    """Distinct seeds of an item, by its length."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    return np.unique(np.concatenate([seed_hashes(words, m) for m in masks_of(n, min_item)])) if n >= min_item else whole_hash(words)


def text_seeds(words: np.ndarray, at: np.ndarray, may_hold, sizes: list[int], min_item: int = MIN_ITEM) -> tuple[np.ndarray, np.ndarray]:
    """(text, seed), distinct, of the texts that begin `at` among words, of seeds that may_hold tells; sizes are the
    lengths of items below SPAN."""
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
    for m in (*MASKS, *("1" * n for n in sizes if min_item <= n)):
        h = seed_hashes(words, m)
        i = np.flatnonzero(may_hold(h))
        i = i[text_of[i] == text_of[i + len(m) - 1]]
        found.append((text_of[i], h[i]))
    tiny = {n for n in sizes if n < min_item}
    for k in np.flatnonzero(np.isin(np.diff(at), [*tiny])).tolist() if tiny else []:
        h = whole_hash(words[at[k] : at[k + 1]])
        found.append((np.full(1, k), h))
    text, seed = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((seed, text))
    text, seed = text[order], seed[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
    return text[fresh], seed[fresh]


def _shifts(words: np.ndarray, item: np.ndarray, min_item: int) -> np.ndarray:
    """Where the item's first word may lie in the text: the shifts at which they share a seed, or, where equal seeds
    make more pairs of positions than there are shifts, all of them."""
    n, m = len(words), len(item)
    if m < min_item:
        return np.zeros(1, np.int64)
    out = [np.empty(0, np.int64)]
    for mask in masks_of(m, min_item):
        mine, theirs = seed_hashes(words, mask), seed_hashes(item, mask)
        order = np.argsort(theirs, kind="stable")
        lo, hi = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
        many = hi - lo
        if many.sum() > 2 * (n + m):
            return np.arange(1 - m, n)
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        out.append(np.repeat(np.arange(len(mine)), many) - order[which])
    return np.unique(np.concatenate(out))


def best_overlap(words: np.ndarray, item: np.ndarray, min_item: int = MIN_ITEM) -> tuple | None:
    """(agreeing words, words, share, first word in the text, in the item) of the overlap of a text and an item, or None."""
    n, m = len(words), len(item)
    if not n or not m or (m >= SPAN > n) or (m < min_item and n != m):
        return None
    shifts, best = _shifts(words, item, min_item), None
    rows = max(1, CELLS // m)
    for k in range(0, len(shifts), rows):
        shift = shifts[k : k + rows]
        at = shift[:, None] + np.arange(m)
        inside = (at >= 0) & (at < n)
        same = inside & (words[np.clip(at, 0, n - 1)] == item)
        enough = np.flatnonzero(same.sum(axis=1) >= min(MIN_WORDS, m))
        shift, same, inside = shift[enough], same[enough], inside[enough]
        # The best stretch of every shift at once, word by word of the item.
        score, start, top, a, b = (np.zeros(len(shift), np.int64) for _ in range(5))
        for i in range(m):
            score += np.where(same[:, i], 1, -PENALTY)
            dead = (score <= 0) | ~inside[:, i]
            score[dead], start[dead] = 0, i + 1
            up = score > top
            top[up], a[up], b[up] = score[up], start[up], i + 1
        sums = np.concatenate([np.zeros((len(shift), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        agree, size = sums[np.arange(len(shift)), b] - sums[np.arange(len(shift)), a], b - a
        ok = np.flatnonzero((agree >= MIN_WORDS) & (agree >= MIN_SHARE * size) if m >= SPAN else agree == m)
        for x in ok[np.lexsort((shift[ok] + a[ok], -agree[ok]))][:1].tolist():
            got = (int(agree[x]), int(size[x]), float(agree[x] / size[x]), int(shift[x] + a[x]), int(a[x]))
            if best is None or (-got[0], got[3]) < (-best[0], best[3]):
                best = got
    return best


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """texts in chunks of bounded size."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", min_item: int = MIN_ITEM) -> DataFrame:
    """(key, item_id, ...): the overlaps of every distinct text of docs; key is the first half of its SHA-256."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    listed = storage.cut(items.select("item_id", F.coalesce("text", F.lit("")).alias("item")).withColumn("no", F.monotonically_increasing_id()), "items")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes([t.encode() for t in batch.column(1).to_pylist()])
            each = [item_seeds(words[a:b], min_item) for a, b in zip(at[:-1], at[1:], strict=True)]
            no = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in each])
            size = np.repeat(np.diff(at), [len(x) for x in each])
            seed = np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(seed), pa.array(size.astype(np.int32))], ["no", "seed", "n"])

    of_items = storage.cut(listed.select("no", "item").mapInArrow(seeds, "no long, seed long, n int"), "item-seeds")
    sizes = sorted(r.n for r in of_items.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most SPAN - 1 numbers
    sent = spark.sparkContext.broadcast(storage.KeyFilter(of_items, "seed", storage.filter_bits(of_items, a_key=BITS_A_SEED)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, seen = sent.value.may_hold_each, set()
        for batch in batches:
            for texts in _chunks([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]):
                words, at = word_hashes(texts)
                text, seed = text_seeds(words, at, told, sizes, min_item)
                with_hits, many = np.unique(text, return_counts=True)
                lists, ends, rows = seed.view(np.int64), np.concatenate([[0], np.cumsum(many)]), []
                for k, (i, j) in zip(with_hits.tolist(), zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), strict=True):
                    if (key := _key(texts[k])) not in seen:
                        seen.add(key)
                        rows.append((key, texts[k], lists[i:j]))
                if len(seen) > storage.BATCH_ROWS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["key", "text", "seeds"])

    met = storage.cut(docs.select(text_col).mapInArrow(hits, "key binary, text binary, seeds array<long>"), "hits")
    pairs = met.select("key", F.explode("seeds").alias("seed")).distinct().join(of_items.select("seed", "no"), "seed").select("key", "no").distinct()
    texts = met.select(F.col("key").alias("k"), "text").dropDuplicates(["k"])
    both = storage.cut(pairs, "pairs").join(texts, F.col("key") == F.col("k")).join(listed, "no").select("key", "item_id", "text", "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
        for batch in batches:
            rows, kept = [], []
            for k, (text, item) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                got = best_overlap(word_hashes([text])[0], word_hashes([item.encode()])[0], min_item)
                if got is not None:
                    rows.append(got)
                    kept.append(k)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["key", "item_id", "n_agree", "n_words", "share", "doc_start", "item_start"])

    return storage.cut(both.mapInArrow(verify, "key binary, " + HITS.format(item=kind)), "overlaps")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("__key", F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32))


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_item: int = MIN_ITEM) -> DataFrame:
    """(doc_id, item_id, n_agree, n_words, share, doc_start, item_start): a row for each contaminated document and item."""
    found = contaminated(docs, items, text_col, min_item)
    found = found.withColumn("__key", F.lower(F.hex("key"))).drop("key")
    rows = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), "__text").select("doc_id", "__key")
    told = storage.Told(storage.cut(found.select(F.xxhash64("__key").alias("h")).distinct(), "told"), "h")
    return rows.where(told.of(F.xxhash64("__key"))).join(found, "__key").drop("__key")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", min_item: int = MIN_ITEM) -> DataFrame:
    """The documents, with all their columns, that no item contaminates. Rows that a filter tells are clean stay where they are."""
    gone = storage.cut(contaminated(docs, items, text_col, min_item).select(F.lower(F.hex("key")).alias("__gone")).distinct(), "gone")
    told = storage.Told(gone.select(F.xxhash64("__gone").alias("h")), "h").of(F.xxhash64("__key"))
    rows = _keyed(docs, text_col)
    left = rows.where(told).join(gone.hint("shuffle_hash"), F.col("__key") == F.col("__gone"), "left_anti")
    return rows.where(~told).unionByName(left).select(*docs.columns)
