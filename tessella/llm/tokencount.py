"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens (the words that the merges never cross): leaves
are runs of pre-tokens with their lengths and token counts, inner nodes the sums of their subtrees.
An edit replaces characters [start, end) by a text. Only the region that it can touch is cut into
pre-tokens and encoded again: from the last boundary that the edit can't have moved (a pre-token may
depend on LOOKAHEAD characters after it) until a boundary met after the edit is an old one. The leaf
that holds the region takes the new pre-tokens, and the sums on its path to the root are updated.

Edits of a document are applied in the order of their array; positions are code points of the text
as it then is, held to its length; start > end counts as start = end, null numbers as 0 and a null
text as empty. A null document is empty. Repeated rows give repeated results; an empty table gives
an empty one; other columns are ignored. Special tokens in a text are ordinary text here.

At scale: each row is handled by itself, in a narrow pass; edits that come as a table are gathered by
document first, and meet it in one join on its id. What a worker holds is one batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bpe, storage

#: Characters after a pre-token that its extent may depend on: two for a contraction that fails late.
LOOKAHEAD = 2
#: Pre-tokens of a leaf when a tree is built; a leaf that has grown past LEAF * SPLIT has the tree built again.
LEAF, SPLIT = 64, 8

#: Pre-tokens of a generation of counts; two are held.
CACHE_COUNTS = 200_000

TREE = "struct<leaf_sizes:array<int>,lengths:array<int>,counts:array<int>,node_chars:array<int>,node_tokens:array<int>>"
EDITS = "array<struct<start:int,end:int,insert:string>>"

_next = regex.compile(bpe.WORDS).match


class PretokenTree:
    """Text, and the tree over its pre-tokens; count(word) is the number of a pre-token's tokens."""

    def __init__(self, text: str, count, words=regex.compile(bpe.WORDS).findall):
        self.text, self.count = text, count
        pre = words(text)
        self._build([*map(len, pre)], [*map(count, pre)])
        self.encoded = len(pre)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i : i + LEAF] for i in range(0, len(lengths), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)] or [[]]
        self.width = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (a, b) in enumerate(zip(self.lengths, self.counts, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(a), sum(b)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.lengths))

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at position, and where the leaf begins; from the root down."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if begin + self.chars[node] <= position:
                begin += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.lengths) - 1)
        return leaf, begin if leaf == node - self.width else self.chars[1] - self.chars[self.width + leaf]

    def _touch(self, leaf: int) -> list[int]:
        """Lengths of a leaf, as a list that can change; leaves come from storage as arrays."""
        if not isinstance(self.lengths[leaf], list):
            self.lengths[leaf], self.counts[leaf] = self.lengths[leaf].tolist(), self.counts[leaf].tolist()
        return self.lengths[leaf]

    def _update(self, leaf: int) -> None:
        node = self.width + leaf
        chars, tokens = sum(self.lengths[leaf]) - self.chars[node], sum(self.counts[leaf]) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def _restart(self, start: int) -> tuple[int, int, int]:
        """(leaf, index, position) of the first pre-token that an edit at start may have changed."""
        leaf, at = self._leaf_at(max(0, start - LOOKAHEAD - 1))
        index = 0
        for n in self._touch(leaf):
            if at + n + LOOKAHEAD > start:
                break
            at += n
            index += 1
        return leaf, index, at

    def edit(self, start: int, end: int, insert: str) -> int:
        """Apply one edit; the number of pre-tokens encoded again."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        leaf, index, at = self._restart(start)
        text = self.text[:start] + insert + self.text[end:]
        shift, stable = len(insert) - (end - start), start + len(insert)
        lengths, counts, pos = [], [], at
        # Old boundaries from the restart on, walked beside the new ones.
        to_leaf, to_index, old = leaf, index, at
        while True:
            while old + shift < pos or old < end:
                if to_index == len(self.lengths[to_leaf]):
                    if to_leaf + 1 == len(self.lengths):
                        break
                    to_leaf, to_index = to_leaf + 1, 0
                    continue
                old += self._touch(to_leaf)[to_index]
                to_index += 1
            if pos >= stable and old >= end and old + shift == pos or pos >= len(text):
                break
            word = _next(text, pos).group()
            lengths.append(len(word))
            counts.append(self.count(word))
            pos += len(word)
        if to_leaf == leaf:
            self.lengths[leaf][index:to_index] = lengths
            self.counts[leaf][index:to_index] = counts
        else:
            self._touch(to_leaf)
            for own, new in ((self.lengths, lengths), (self.counts, counts)):
                own[leaf][index:] = new
                own[to_leaf][:to_index] = []
                for i in range(leaf + 1, to_leaf):
                    own[i] = []
        for i in range(leaf, to_leaf + 1):
            self._update(i)
        self.text = text
        if len(self.lengths[leaf]) > LEAF * SPLIT:
            self._build([int(n) for x in self.lengths for n in x], [int(n) for x in self.counts for n in x])
        return len(lengths)

    def stored(self) -> dict:
        return {"leaf_sizes": [len(x) for x in self.lengths], "lengths": [*chain.from_iterable(self.lengths)], "counts": [*chain.from_iterable(self.counts)], "node_chars": self.chars, "node_tokens": self.tokens}

    @classmethod
    def loaded(cls, text: str, tree: dict, count) -> PretokenTree:
        self = cls.__new__(cls)
        self.text, self.count, self.encoded = text, count, 0
        ends = [0, *accumulate(tree["leaf_sizes"])]
        for name in ("lengths", "counts"):
            flat = np.asarray(tree[name], np.int32)
            setattr(self, name, [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        self.chars, self.tokens = ([int(n) for n in tree[k]] for k in ("node_chars", "node_tokens"))
        self.width = len(self.chars) // 2
        return self


def _stored_trees(column: pa.StructArray) -> Iterator[dict]:
    """The trees of a column, as slices of its arrays."""
    parts = {}
    for i, field in enumerate(column.type):
        lists = column.field(i)
        parts[field.name] = (lists.offsets.to_numpy(), lists.values.to_numpy())
    for r in range(len(column)):
        yield {name: values[at[r] : at[r + 1]] for name, (at, values) in parts.items()} if column[r].is_valid else None


class _Counts(dict):
    """Pre-token -> number of tokens, kept up to a bound."""

    def __init__(self, encoder: bpe.Encoder):
        super().__init__()
        self.automaton, self.most, self.old = encoder.automaton, CACHE_COUNTS, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.automaton.encode_word(word.encode()))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.automaton.trim()
        self[word] = n
        return n


def build_trees(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, tree) of every row."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    sent = bpe.shipped(spark, vocabulary)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, tree {TREE}"
    ints = pa.list_(pa.int32())
    kind = pa.struct([(n, ints) for n in ("leaf_sizes", "lengths", "counts", "node_chars", "node_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counts(bpe.encoder(sent.value)).__getitem__
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            trees = [PretokenTree(t, count).stored() for t in texts]
            parts = [pa.array([t[f.name] for t in trees], ints) for f in kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.StructArray.from_arrays(parts, fields=[*kind])], ["doc_id", "text", "tree"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def edited_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """For docs (doc_id, text, edits[, tree]): (doc_id, n_tokens, n_pretokens, n_edited, n_tokens_after,
    n_pretokens_after, n_reencoded, text_after). A null or absent tree is built first."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    sent = bpe.shipped(spark, vocabulary)
    has_tree = "tree" in docs.columns
    names = ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_pretokens_after", "n_reencoded", "text_after"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", text_after string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counts(bpe.encoder(sent.value)).__getitem__
        for batch in batches:
            rows = []
            trees = _stored_trees(batch.column(3)) if has_tree else [None] * batch.num_rows
            for text, edits, stored in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), trees, strict=True):
                tree = PretokenTree(text or "", count) if stored is None else PretokenTree.loaded(text or "", stored, count)
                before, pre = tree.n_tokens, tree.n_pretokens
                again = sum(tree.edit(e["start"] or 0, e["end"] or 0, e["insert"] or "") for e in edits or () if e is not None)
                rows.append((before, pre, len(edits or ()), tree.n_tokens, tree.n_pretokens, again, tree.text))
            cols = [pa.array([r[i] for r in rows], pa.string() if i == 6 else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    return docs.select("doc_id", "text", "edits", *["tree"] * has_tree).mapInArrow(run, schema)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Trees (doc_id, text, tree) with the edits table (doc_id, seq, start, end, insert) gathered by document, in order of seq."""
    by = edits.groupBy(F.col("doc_id").alias("i")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "insert"))).alias("e"))
    by = by.select("i", F.transform("e", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["insert"].alias("insert"))).alias("edits"))
    return trees.join(by, trees["doc_id"] == F.col("i"), "left").drop("i")


#: Texts that the query's edits insert.
INSERTS = ("", " and", "'s", "\n\n", " 2024", "é")


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with three edits a document, fixed by its id: a replacement, an insertion and a deletion."""
    n = F.length(F.coalesce("text", F.lit("")))

    def place(k: int):
        return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.greatest(n, F.lit(1)).cast("long")).cast("int")

    def insert(k: int):
        return F.get(F.array(*map(F.lit, INSERTS)), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.lit(len(INSERTS)).cast("long")).cast("int"))

    def one(start, end, text):
        return F.struct(start.alias("start"), end.alias("end"), text.alias("insert"))

    edits = F.array(one(place(1), place(1) + 7, insert(2)), one(place(3), place(3), insert(4)), one(place(5), place(5) + 23, F.lit("")))
    return docs.select("*", edits.cast(EDITS).alias("edits"))


def token_counts(docs: DataFrame) -> DataFrame:
    """The query's columns: counts before and after each document's edits, and what had to be encoded again."""
    trees = storage.cut(build_trees(docs), "trees")
    out = edited_counts(sample_edits(trees))
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_edits", "n_tokens_after", "n_pretokens_after", "n_reencoded", F.sha2(F.col("text_after"), 256).alias("edited_sha256"))
