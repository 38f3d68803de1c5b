"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token labels. It starts with one arc per byte from every state to every state;
each merge (a, b) -> c, in order of rank, is one gadget: every state with an arc a whose target has
an arc b gets an arc c to where that b leads, and the arc b after a is removed. A state is fixed by
the label that led to it, so the automaton is deterministic, and a label sequence is accepted exactly
if it is the BPE encoding of its text. Rows of arcs are shared between states: a gadget stores when a
row was forked and when an arc ended, and a row's entry is worked out on its first use and kept.

A word is encoded by transitions alone, with nothing to turn back from: the state after some bytes is the
label that ends their encoding, which is the one label ending there with an arc from the state where it
begins (there is exactly one, since every beginning has one encoding; longer labels are tried first, and
states are worked out when they are asked for, once; of a long word all, from its start on). The labels that may end at a byte come from a table
over the last bytes; states of recent beginnings of words are held. The states passed, from the last one
back, are the arcs; they give the ids, and decoding emits the labels of the arcs. Text is split into words by the byte-level pattern first, special tokens before that. Whole
texts are encoded, null ones as empty; an empty table gives an empty one; repeated rows give repeated
results; other columns are ignored.

Each row is encoded by itself: one narrow pass, no shuffle. The vocabulary (a few MB) is broadcast.
Words recur, so a worker keeps the encodings of recent words, in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm import storage

# Fixed value: the pattern that splits text into words before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of a worker's cache generation; two generations are held.
CACHE_WORDS = 100_000
#: Worked-out arcs of a generation, of which two are held, and beginnings of words whose state is held.
CACHE_ARCS = 100_000
NEVER = 1 << 60
#: Bits of a label's id.
SHIFT = 24
#: Bytes by which the labels that may end are looked up; bytes beyond which a word's states are held by position.
SUFFIX, DEPTH = 4, 200


def byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Ends(dict):
    """Last bytes of a word's beginning (up to SUFFIX) -> (length, label) of the labels that may end it, longest first;
    label is -1 where more bytes must be looked at."""

    def __init__(self, labels: dict[bytes, int]):
        super().__init__()
        self.labels, self.longer = labels, {}
        for x in labels:
            if len(x) > SUFFIX:
                self.longer.setdefault(x[-SUFFIX:], set()).add(len(x))

    def __missing__(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        short = [(n, self.labels[tail[-n:]]) for n in range(len(tail), 0, -1) if tail[-n:] in self.labels]
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[tail] = (*((n, -1) for n in sorted(self.longer.get(tail, ()), reverse=True)), *short)
        return got


class MergeAutomaton:
    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.label: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.label[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.label[i] = t.encode()
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.ended: dict[tuple[int, int], int] = {}
        self._life: dict[int, int] = {}
        self._old: dict[int, int] = {}
        self.arc_of = {self.label[i]: i for i in vocab.values() if len(self.label[i]) == 1}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self._gadget(vocab[a], vocab[b], vocab[a + b], rank)
        self.ends = _Ends(self.arc_of)
        self.sizes = [len(x) for x in self.label]
        self.decimal, self.packed = [str(i).encode() for i in range(size)], [i.to_bytes(4, "little") for i in range(size)]
        self._state: dict[bytes, int] = {}

    def _gadget(self, a: int, b: int, c: int, rank: int) -> None:
        reached = self._alive(a, b) >= 0
        if self.label[c] in self.arc_of:
            raise ValueError("two merges give one label")
        if reached:  # else no encoding passes these arcs, and c has none
            self.left[c], self.right[c], self.born[c] = a, b, rank
            self.arc_of[self.label[c]] = c
        self.ended[a, b] = rank
        self._life.pop(a << SHIFT | b, None)

    def _alive(self, u: int, v: int) -> int:
        """The rank at which the arc v from the state of u ended: NEVER if it holds, -1 if there was none."""
        got = self._life.get(u << SHIFT | v)
        if got is None and (got := self._old.get(u << SHIFT | v)) is not None:
            self._life[u << SHIFT | v] = got
        elif got is None:
            bu, bv = self.born[u], self.born[v]
            if bu < 0 and bv < 0:
                there = True
            elif bv >= bu:  # v came by a gadget that found its left half alive after u
                there = self._alive(u, self.left[v]) > bv
            else:  # u's row was forked from that of its right half, just before the gadget's removal
                there = self._alive(self.right[u], v) >= bu
            got = self.ended.get((u, v), NEVER) if there else -1
            self._life[u << SHIFT | v] = got
        return got

    def arc(self, u: int, v: int) -> bool:
        return self._alive(u, v) == NEVER

    def trim(self, most: int = CACHE_ARCS) -> None:
        """Bounds the arcs held: those not used since the last time go."""
        if len(self._life) > most:
            self._old, self._life = self._life, {}
        if len(self._state) > most:
            self._state.clear()

    def forget(self) -> None:
        self._state.clear()

    def encode_word(self, word: bytes) -> list[int]:
        arc_of = self.arc_of
        whole = arc_of.get(word)
        if whole is not None:  # the start state has every arc
            return [whole]
        if len(word) > DEPTH:
            return self._encode_long(word)
        state, sizes, n = self._state, self.sizes, len(word)
        if len(state) > CACHE_ARCS:
            state.clear()
        out = [self._ending(word)]
        del state[word]  # whole words are held elsewhere
        n -= sizes[out[0]]
        while n:
            head = word[:n]
            v = state.get(head)
            out.append(self._ending(head) if v is None else v)
            n -= sizes[out[-1]]
        return out[::-1]

    def _encode_long(self, word: bytes) -> list[int]:
        """Every byte's state from the first on, held by position."""
        states, out, n = [-1], [], len(word)
        for end in range(1, n + 1):
            for k, v in self.ends[word[max(0, end - SUFFIX) : end]]:
                at = end - k
                if at >= 0 and v < 0:
                    v = self.arc_of.get(word[at:end], -1)
                if at >= 0 and v >= 0 and (at == 0 or self.arc(states[at], v)):
                    states.append(v)
                    break
        while n:
            out.append(states[n])
            n -= self.sizes[out[-1]]
        return out[::-1]

    def _ending(self, head: bytes) -> int:
        """The label that ends the encoding of a word's beginning: its state."""
        state, life = self._state, self._life
        for k, v in self.ends[head[-SUFFIX:]]:
            at = len(head) - k
            if at < 0:
                continue
            if v < 0:
                v = self.arc_of.get(head[at:], -1)
                if v < 0:
                    continue
            if at:
                rest = head[:at]
                u = state.get(rest)
                if u is None:
                    u = self._ending(rest)
                held = life.get(u << SHIFT | v)
                if (self._alive(u, v) if held is None else held) != NEVER:
                    continue
            state[head] = v
            return v
        raise AssertionError("every byte has an arc")

    def decode(self, ids) -> str:
        return b"".join([self.label[i] for i in ids]).decode("utf-8", "replace")


class Encoder(dict):
    """word -> (decimal ids, number of ids, decoded bytes, ids as int32), over an automaton; a dict for its speed."""

    def __init__(self, spec: dict, cache_words: int = CACHE_WORDS):
        super().__init__()
        self.automaton, self.most, self.old = MergeAutomaton(spec), cache_words, {}
        self.words = regex.compile(WORDS).findall
        special = self.automaton.special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split if special else None
        self.marks = {s: (str(i).encode(), 1, s.encode(), np.int32(i).tobytes()) for s, i in special.items()}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            a = self.automaton
            ids = a.encode_word(word.encode())
            got = (b",".join([a.decimal[i] for i in ids]), len(ids), b"".join([a.label[i] for i in ids]), b"".join([a.packed[i] for i in ids]))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
            self.automaton.trim()
        self[word] = got
        return got

    def forget(self) -> None:
        """Let go of what was held of words: a worker that waits, or does other work, shouldn't hold it. Arcs stay."""
        self.clear()
        self.old = {}
        self.automaton.forget()

    def parts(self, text: str) -> list[tuple]:
        if self.cut is None or not any(s in text for s in self.marks):
            return list(map(self.__getitem__, self.words(text)))
        out = []
        for piece in self.cut(text):
            out += [self.marks[piece]] if piece in self.marks else map(self.__getitem__, self.words(piece))
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([p[3] for p in self.parts(text)]), "<i4")

    def decode(self, ids) -> str:
        return self.automaton.decode(ids)


_encoders: dict[bytes, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The worker's encoder for a vocabulary file's content; built once a process."""
    key = hashlib.sha256(raw).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(json.loads(raw))
    return _encoders[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shipped(spark, path: str | None):
    """The vocabulary file, read on the driver and broadcast: executors need not hold it."""
    storage.small_batches(spark)
    with open(path or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, token_ids, n_tokens, ids_sha256, decoded_sha256) of every row; token_ids null unless with_ids."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    sent = shipped(spark, vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            n, shas, back, ids, at = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                got = enc.parts(text or "")
                n.append(sum([p[1] for p in got]))
                shas.append(hashlib.sha256(b",".join([p[0] for p in got])).hexdigest())
                back.append(hashlib.sha256(b"".join([p[2] for p in got])).hexdigest())
                if with_ids:
                    ids.append(b"".join([p[3] for p in got]))
                    at.append(at[-1] + n[-1])
            if with_ids:
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            else:
                tokens = pa.nulls(len(n), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()
        storage.trim_memory()

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) from token ids; null ids give a null text."""
    sent = shipped(tokens.sparkSession, vocabulary)
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for batch in batches:
            texts = [None if ids is None else enc.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"doc_id {id_type}, text string")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return encode_texts(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
