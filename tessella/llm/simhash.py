"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints: 64 bits over word shingles. Two fingerprints within radius r agree on all bits of some
mask: give each bit position a nonzero vector of r + 1 bits, and let mask v (each nonzero v) hold the
positions whose vector has an odd product with v. At most r differing positions can't span all r + 1
dimensions, so some v is orthogonal to each of them, and its mask avoids them. So every pair within
the radius meets in one of 2^(r+1) - 1 tables: no pair is missed, whatever the data.

Distinct fingerprints, not documents, meet, so copies cost nothing. A bucket of more than SMALL
fingerprints isn't compared pair by pair: it is cut again by masks over the bits that its mask left
out, with the same guarantee, and again, until a bucket is small or few free bits bound its size.

Texts are lower-cased in A-Z and cut at ASCII white space; shingles count with repeats; a text of
fewer words is one shingle, one without words (or null) has fingerprint 0. A component's id is its
smallest document id; null ids take part, but name a component only if it has no other. Repeated
rows give repeated results; an empty table gives an empty one; other columns are ignored.

At scale: the text is read once, in one narrow pass; what is shuffled are 8-byte fingerprints. Links
go to the components algorithm as a table; nothing is collected.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import graph, storage

BITS, SEED = 64, 42
#: Fingerprints of a bucket that are compared pair by pair.
SMALL = 32
#: Open bits of a bucket that isn't cut further.
FREE = 6
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Buckets of a text, and the minima in each; minima whose bytes make a sketch; least agreement of a pair's sketches (at a
#: similarity of 0.8, 102 are expected with a deviation of 4.5).
BANDS, ROWS, SKETCH, AGREE = 50, 8, 128, 80
FACTORS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)
#: Nodes of a bucket that meet as many others at once, and their shingles.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 19


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        first = end - size
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], "<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""
    storage.small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over positions such that any `radius` of them are avoided by at least one."""
    top = (1 << (radius + 1)) - 1
    # Fewer positions than vectors are dealt out at random, so that all masks read about half of them.
    dealt = random.Random(SEED).sample(range(1, top + 1), len(positions)) if len(positions) < top else [i % top + 1 for i in range(len(positions))]
    vector = dict(zip(positions, dealt, strict=True))
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_levels(radius: int) -> list[list[list[int]]]:
    """For each level, for each bucket kind of the level before, the masks that refine it: bits that must agree so
    far. The last level leaves at most FREE bits open, which bounds its buckets by 2^FREE distinct fingerprints."""
    if radius not in (1, 2):
        raise ValueError("buckets are refined for a radius of 1 or 2")
    levels, kinds = [], [0]
    while max(BITS - k.bit_count() for k in kinds) > FREE:
        refined = [[k | m for m in covering_masks([p for p in range(BITS) if not k >> p & 1], radius)] for k in kinds]
        levels.append(refined)
        kinds = [m for ms in refined for m in ms]
    return levels


def links_within(fps: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """(u, v), u < v: every pair of the distinct fingerprints fps (fp) that differs in at most `radius` bits."""
    levels = mask_levels(radius)
    rows, out = fps.select(F.lit(0).alias("kind"), "fp"), []
    for depth, refined in enumerate(levels):
        width = len(refined[0])
        table = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in refined])
        dealt = rows.select("kind", "fp", F.posexplode(F.get(table, F.col("kind"))).alias("i", "mask"))
        dealt = dealt.select((F.col("kind") * width + F.col("i")).alias("kind"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        # Written, so that the join sees two plain inputs, whose hot partitions Spark can split.
        sizes = storage.cut(dealt.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        met = storage.cut(dealt.join(sizes, ["kind", "key"]), "buckets")
        last = depth + 1 == len(levels)
        few = met if last else met.where(F.col("n") <= small)
        group = few.groupBy("kind", "key").agg(F.collect_list("fp").alias("fps"))
        near = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= radius)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
        out.append(group.select(F.explode(near).alias("p")).select("p.u", "p.v"))
        if last:
            break
        rows = met.where(F.col("n") > small).select("kind", "fp")
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, out).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = storage.cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = storage.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = graph.connected_components(links_within(distinct.select("fp"), radius))
    named = groups.join(distinct, F.col("node") == F.col("fp"))
    ids = storage.cut(named.groupBy("root").agg(F.min("least").alias("component")), "ids")
    of_fp = named.select("node", "root").join(ids, "root").select(F.col("node").alias("fp"), "component")
    label = storage.cut(distinct.join(of_fp, "fp", "left").select(F.col("fp").alias("f"), F.coalesce("component", "least").alias("component_id")), "labels")
    return marked.join(label, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def shingles(text: bytes, words: int) -> set[int]:
    """Hashes of the distinct word shingles of a text; of fewer words, that of all; none of none."""
    w = text.lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(w[i : i + words])) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a: set[int], b: set[int]) -> float:
    """Jaccard similarity; 1 for two empty sets."""
    return len(a & b) / len(a | b) if a or b else 1.0


def minhashes(hashed: set[int]) -> np.ndarray:
    """BANDS * ROWS minima of the shingle hashes, each under a multiplication of its own; all ones for no shingle."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    every = np.fromiter(hashed, np.uint64, len(hashed))
    for i in range(0, len(every), 256):
        np.minimum(out, (every[i : i + 256, None] * FACTORS).min(axis=0), out=out)
    return out


def bands(minima: np.ndarray) -> list[int]:
    """A signed 64-bit bucket of each band."""
    raw, size = minima.tobytes(), 8 * ROWS
    return [_signed(xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i)) for i in range(BANDS)]


def sketch(minima: np.ndarray) -> bytes:
    """A byte of each of the first SKETCH minima."""
    return (minima[:SKETCH] >> np.uint64(16)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree in AGREE places or more."""
    return (a == b).sum(axis=-1) >= AGREE


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, a, b) of nodes (node, bands) in buckets of n > 1 nodes, a the first and b the last of them.

    Most buckets hold one node. Buckets are counted first, and a filter over those of more, sized by
    their number, keeps the rest from moving again. A bucket's first and last are partial sums, and meet its nodes
    in a join whose hot partitions Spark splits: no bucket is gathered in one task.
    """
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = storage.cut(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    met = storage.cut(dealt.where(storage.Told(shared, "bucket").of(F.col("bucket"))), "met")
    storage.drop(shared)
    ends = storage.cut(met.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "ends")
    out = storage.cut(met.join(ends, "bucket").select("bucket", "node", "n", "a", "b"), "buckets")
    storage.drop(met, ends)
    return out


def first_pairs(met: DataFrame, small: int = SMALL) -> DataFrame:
    """(u, v), u < v: all pairs of buckets of at most `small` nodes; of larger ones the first and the last with the others."""
    group = met.where(F.col("n") <= small).groupBy("bucket").agg(F.collect_list("node").alias("ns"))
    every = F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    star = met.where(F.col("n") > small).select("node", F.explode(F.array("a", "b")).alias("end")).where("node <> end")
    return group.select(F.explode(every).alias("p")).select("p.u", "p.v").unionByName(star.select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v"))).distinct()


def apart(met: DataFrame, groups: DataFrame, small: int = SMALL) -> DataFrame:
    """(bucket, node, root, main, n, outside): the nodes of buckets of more than `small` nodes that groups (node, root)
    leave apart. main is the root of a bucket's largest group, outside the number of nodes beyond it."""
    root = groups.select(F.col("node").alias("g"), "root")
    large = met.where(F.col("n") > small).select("bucket", "node", "n")
    large = storage.cut(large.join(root, F.col("node") == F.col("g"), "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root")), "large")
    most = large.groupBy("bucket", "root", "n").agg(F.count("*").alias("held"))
    most = most.groupBy("bucket").agg(F.max(F.struct("held", "root")).alias("m"), F.max("n").alias("all")).where("m.held < all")
    most = storage.cut(most.select("bucket", F.col("m.root").alias("main"), (F.col("all") - F.col("m.held")).alias("outside")), "most")
    return storage.cut(large.join(most, "bucket").select("bucket", "node", "root", "main", "n", "outside"), "apart")


def unlinked_pairs(met: DataFrame, nodes: DataFrame, groups: DataFrame, small: int = SMALL, block: int = BLOCK_NODES, least: float | None = None, parted: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: of buckets of more than `small` nodes, every pair with like sketches that groups (node, root) leave
    apart; with `least`, of the similar ones among them one for each node and root, which joins the same groups.

    Pairs inside a group can't change the components, so the nodes outside a bucket's largest group meet
    all its nodes, in blocks: no task holds more than two blocks of one bucket at a time, and what it gives
    back are links, not pairs. nodes are (node, sketch) and with `least` (bands, hashes), where a pair is
    compared in the first bucket only that both share. parted is what `apart` gives, if it is known.
    """
    exact = least is not None
    own = ["bucket", "node", "root", "sketch", *(["bands", "hashes"] if exact else [])]
    held = (apart(met, groups, small) if parted is None else parted).join(nodes.select(F.col("node").alias("k"), *own[3:]), F.col("node") == F.col("k")).drop("k")
    if exact:
        held = storage.cut(held, "held")
        size = held.groupBy("bucket").agg(F.sum(F.size("hashes")).alias("s"), F.sum(F.when(F.col("root") != F.col("main"), F.size("hashes"))).alias("t"))
        held = held.join(storage.cut(size.select(F.col("bucket").alias("b"), "s", "t"), "sizes"), F.col("bucket") == F.col("b"))
    else:
        held = held.withColumns({"s": F.lit(0), "t": F.lit(0)})
    blocks = lambda n, s: F.ceil(F.greatest(F.col(n) / block, F.col(s) / BLOCK_SHINGLES)).cast("int")
    held = held.withColumns({"gs": blocks("n", "s"), "ks": blocks("outside", "t")})
    here = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.where("root <> main").select(*own, F.lit(True).alias("left"), here(F.col("ks")).alias("i"), up_to("gs").alias("j"))
    right = held.select(*own, F.lit(False).alias("left"), here(F.col("gs")).alias("j"), up_to("ks").alias("i"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, of, is_left = (table.column(c).to_numpy() for c in ("node", "root", "left"))
        marks, u, v = _sketches(table.column("sketch")), [], []
        if exact:
            band = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            lists = table.column("hashes").combine_chunks()
            hashes, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            bucket = table.column("bucket")[0].as_py()
        right = np.flatnonzero(~is_left)
        for x in np.flatnonzero(is_left).tolist():
            near = right[alike(marks[right], marks[x]) & (of[right] != of[x])]
            if exact and len(near):
                same = band[near] == band[x]
                near = near[band[x][same.argmax(axis=1)] == bucket]
                mine, linked, kept = hashes[ends[x] : ends[x + 1]], set(), []
                for y in near.tolist():
                    if of[y] not in linked:
                        other = hashes[ends[y] : ends[y + 1]]
                        both = len(np.intersect1d(mine, other, assume_unique=True))
                        if both >= least * (len(mine) + len(other) - both):
                            linked.add(of[y])
                            kept.append(y)
                near = np.array(kept, np.int64)
            u.append(np.minimum(node[near], node[x]))
            v.append(np.maximum(node[near], node[x]))
        none = [np.empty(0, np.int64)]
        return pa.table({"u": np.concatenate(u + none), "v": np.concatenate(v + none)})

    return left.unionByName(right).groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def fingerprint_buckets(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(node, bucket) of nodes (node, fp): a bucket holds the texts of one component of the fingerprints' links, as
    `near_duplicates` finds them, so that any two texts within the radius are in one."""
    of_text = nodes.select("node", "fp")
    label = storage.cut(graph.connected_components(links_within(storage.cut(of_text.select("fp").distinct(), "distinct"), radius)), "labels")
    bucket = F.xxhash64(F.lit("fingerprints"), F.coalesce("root", "fp")).alias("bucket")  # told apart from those of minima
    return storage.cut(of_text.join(label.select(F.col("node").alias("f"), "root"), F.col("fp") == F.col("f"), "left").select("node", bucket), "components")


def pairs_between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (u, v) that groups (node, root) leave apart."""
    of = lambda n: groups.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root"))
    rooted = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return rooted.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def like_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["u", "v"]).filter(pa.array(alike(_sketches(batch.column(2)), _sketches(batch.column(3)))))

    of = lambda n, s: nodes.select(F.col("node").alias(n), F.col("sketch").alias(s))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def distinct_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest id.

    Two texts are near copies if their sets of `words`-word shingles have a similarity of `least` or
    more. First the texts of each component of SimHash fingerprints meet, as `near_duplicates` finds them, so
    every pair within its radius meets (among more than `small` texts by sketches first). Then come near copies
    whose fingerprints lie farther apart (64 bits can't hold the bound): texts that these groups leave apart and
    that share one of BANDS buckets, each of ROWS minima of the shingles' hashes: of a pair of similarity s, each
    bucket is shared with a chance of s^ROWS, so a pair at 0.8 is missed with a chance of 0.0001, and one at 0.85
    of 0.0000001. Each candidate is verified on the whole texts. Groups are the components of the verified pairs
    and of equal texts. A null id is the largest; rows that repeat an id and a text count once.
    """
    spark = docs.sparkSession
    storage.small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            minima = [minhashes(shingles(t, words)) for t in texts]
            fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            cols = [pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()), pa.array(fps), pa.array([bands(m) for m in minima], pa.list_(pa.int64())), pa.array([sketch(m) for m in minima], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "key", "fp", "bands", "sketch"])

    marked = storage.cut(docs.select(id_col, text_col).mapInArrow(mark, f"doc_id {id_type}, key binary, fp long, bands array<long>, sketch binary"), "marked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    nodes = marked.groupBy("key").agg(first.alias("first"), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = storage.cut(nodes.select("key", "first", "copies", "fp", "bands", "sketch", F.xxhash64("key").alias("node")), "nodes")
    storage.drop(marked)

    def texts_of(few: DataFrame) -> DataFrame:
        """(node, text) of few (node): one row a text moves."""
        asked = storage.cut(few.distinct().join(nodes, "node").select("node", "key"), "asked")
        hashed = asked.select(F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long").alias("h"))
        sent = spark.sparkContext.broadcast(storage.KeyFilter(hashed, "h"))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            may_hold = sent.value.may_hold
            for batch in batches:
                got = [(k, t) for t in (t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()) if may_hold(int((k := hashlib.sha256(t).digest()[:16]).hex()[:15], 16))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.binary()), pa.array([t for _, t in got], pa.binary())], ["k", "text"])

        picked = docs.select(text_col).mapInArrow(pick, "k binary, text binary")
        out = storage.cut(picked.dropDuplicates(["k"]).join(asked, F.col("k") == F.col("key")).select("node", "text"), "texts")
        storage.drop(asked)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = storage.cut(pairs, "candidates")
        texts = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similarity(shingles(a, words), shingles(b, words)) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
        out = storage.cut(both.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "verified")
        storage.drop(pairs, texts)
        return out

    def hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(np.fromiter((x := shingles(t, words)), np.uint64, len(x))).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["k", "hashes"])

    def joined(more: DataFrame) -> DataFrame:
        return graph.connected_components(more.unionByName(groups.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    of_fp = fingerprint_buckets(nodes)
    close = shared_buckets(of_fp.select("node", F.array("bucket").alias("bands")))
    groups = graph.connected_components(verified(first_pairs(close, small)))
    far = shared_buckets(nodes)
    groups = joined(verified(like_pairs(pairs_between(first_pairs(far, small), groups), nodes)))
    met = close.unionByName(far)
    parted = apart(met, groups, small)
    if not parted.isEmpty():
        texts = texts_of(parted.select("node"))
        sets = texts.mapInArrow(hashed_sets, "k long, hashes array<long>")
        every = F.concat(F.array("bucket"), "bands").alias("bands")
        known = storage.cut(nodes.join(sets, F.col("node") == F.col("k")).join(of_fp, "node").select("node", "sketch", every, "hashes"), "sets")
        storage.drop(texts)
        more = storage.cut(unlinked_pairs(met, known, groups, small, least=least, parted=parted), "more")
        storage.drop(known)
        if not more.isEmpty():
            groups = joined(more)
    storage.drop(close, far, of_fp, parted)
    # Nodes are named by their texts; of a group, that of the smallest id stays (of one id's texts, the smallest key).
    named = storage.cut(groups.join(nodes, "node").select("node", "root", F.struct("first", "key").alias("rank")), "named")
    stays = storage.cut(named.groupBy("root").agg(F.min("rank").alias("best")), "stays")
    gone = storage.cut(named.join(stays, "root").where("rank <> best").select("node"), "gone")
    storage.drop(named, stays)
    # Rows whose text no other row repeats or outranks stay where they are; a filter tells most of them.
    moot = storage.cut(nodes.where("copies > 1").select("node").unionByName(gone), "moot")
    told = storage.Told(moot, "node")
    stay = nodes.where(told.of(F.col("node"))).join(gone, "node", "left_anti").select(F.col("first.doc_id").alias("__stays"), F.hex("key").alias("__key"))
    key = F.substring(F.upper(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 32)
    keyed = docs.withColumn("__text_key", key)
    asked = told.of(F.xxhash64(F.unhex("__text_key")))
    kept = keyed.where(asked).join(stay.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__stays")) & (F.col("__text_key") == F.col("__key")), "left_semi")
    return keyed.where(~asked).unionByName(kept.dropDuplicates([id_col, "__text_key"])).select(*docs.columns)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
