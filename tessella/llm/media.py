"""Media columns: payloads as 8-bit samples, cut into content-defined chunks that are stored once.

A text's UTF-8 bytes, padded with blanks to a positive multiple of FRAME, are the samples of a mono
8-bit wave (RIFF) file. The file is cut where a gear hash that rolls over its bytes has its top bits
zero, so equal stretches give equal chunks wherever they stand. A chunk is named by the first 16
bytes of its SHA-256. Of equal chunks, that of the smallest (doc_id, file, position) is kept: names
are joined and summed, bytes are not. The store is a table with a row for each document: its ordered
chunk list and the bytes of the chunks it keeps. Reading back, a document that keeps all its chunks
is put together from its own row; for others the missing chunks are fetched by a join on their name.
Every chunk and every whole file is verified against its digest.

Equal texts give equal files, whatever chunks they share. Null texts count as empty (one frame of
blanks). A null doc_id keeps no chunk that another row has. Rows that repeat a doc_id with different
texts stay apart; exact repeats give the row as often as it came. An empty table gives an empty one;
other columns are ignored.

At scale: cutting is a narrow pass over the texts, and so is packing. Only files that share a chunk
with another move, once, to meet the list of chunks kept elsewhere; a Bloom filter of a fixed size
tells most of the rest, which are written where they are read (a fuller filter moves more files and
changes no result). A chunk that very many rows share is one row on its side of the fetching join,
whose hot partitions Spark splits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import storage

FRAME, RATE, TAIL, HEADER = 192, 8000, 16, 44
#: A cut has this many zero top bits (a chunk of 4 KB on average), and leaves chunks of LEAST to MOST bytes.
CUT_BITS, LEAST, MOST = 12, 1024, 32768
WINDOW = 32
LEVEL = 9


def gear_table() -> np.ndarray:
    """256 numbers of 32 bits, from SHA-256 of each byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], np.uint32)


_GEAR = gear_table()


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of gear[data[i - k]] << k, the hash after byte i; doubled window by window."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n]
    at = (np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, last = [], 0
    for end in [*at, n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST and end < n:
            ends.append(end)
            last = end
    return [*ends, n] if last < n else ends


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def wave(payload: bytes) -> bytes:
    """The payload as a mono wave file of unsigned 8-bit samples (its length is even, so no pad byte)."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of such a file; an error if it isn't whole."""
    riff, size, kind, _, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, kind, data, code, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or size != len(media) - 8 or n != len(media) - HEADER:
        raise ValueError("not a whole 8-bit wave file")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Samples, least, greatest, mean and root mean square about the mid level, and mean crossings of it."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.square(x.astype(np.int64) - 128).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"n={len(x)};min={x.min()};max={x.max()};mean={total / len(x):.4f};rms={(squares / len(x)) ** 0.5:.4f};crossings={crossings}"


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    for text in batch.column(1).cast(pa.binary()).to_pylist():
        text = text or b""
        yield len(text), wave(padded(text))


def _pieces(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


NAMES = ("doc_id", "n_bytes", "file", "media_sha256", "sizes", "names", "lacks", "lends", "packed")
STORED = "n_bytes long, file long, media_sha256 binary, sizes array<int>, names array<binary>, lacks array<int>, lends array<int>, packed binary"


def _name(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def _file_key(media: bytes) -> int:
    """Signed 64-bit key of a file, by which its rows meet (its SHA-256 is checked besides)."""
    k = xxhash.xxh64_intdigest(media)
    return k - (1 << 64) if k >> 63 else k


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, names): the ordered chunk list of every row; no bytes."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for _, media in _files(batch):
                keys.append(_file_key(media))
                lists.append([_name(p) for p in _pieces(media)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "file", "names"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {id_type}, file long, names array<binary>")


def build_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """Write the store of docs to folder and return it (columns NAMES): lacks are positions of chunks
    kept elsewhere, lends of chunks that others lack, packed the kept chunks, compressed."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    each = storage.cut(chunk_lists(docs, id_col, text_col), "chunks").select("doc_id", "file", F.posexplode("names").alias("pos", "name"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "pos")
    keepers = each.groupBy("name").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1").select("name", "keeper")
    keepers = storage.cut(keepers, "keepers")  # a plain input, so that Spark can split hot partitions of the join
    keeps = place.eqNullSafe(F.col("keeper"))
    shared = each.join(keepers, "name").groupBy(F.col("doc_id").alias("i"), F.col("file").alias("f")).agg(
        F.sort_array(F.collect_set(F.when(~keeps, F.col("pos")))).alias("lacks"), F.sort_array(F.collect_set(F.when(keeps, F.col("pos")))).alias("lends")
    )
    shared = storage.cut(shared, "shared")
    sent = spark.sparkContext.broadcast(storage.KeyFilter(shared, "f", filter_bits))
    none = F.array().cast("array<int>")
    stored = f"doc_id {id_type}, {STORED}"

    def row(n: int, key: int, media: bytes, lacks: list[int], lends: list[int], press) -> tuple:
        pieces, gone = _pieces(media), {*lacks}
        return (n, key, hashlib.sha256(media).digest(), [len(p) for p in pieces], [_name(p) for p in pieces], lacks, lends, press(b"".join(p for i, p in enumerate(pieces) if i not in gone)))

    def table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        ints, kinds = pa.list_(pa.int32()), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((*kinds, ints, ints, pa.binary())))], [*NAMES])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Store the files that the filter tells share nothing."""
        press, may_hold = zstandard.ZstdCompressor(level=LEVEL).compress, sent.value.may_hold
        for batch in batches:
            rows, at = [], []
            for i, (n, media) in enumerate(_files(batch)):
                if not may_hold(key := _file_key(media)):
                    at.append(i)
                    rows.append(row(n, key, media, [], [], press))
            yield table(batch.column(0).take(pa.array(at, pa.int64())), rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other files, compressed."""
        press, may_hold = zstandard.ZstdCompressor(level=LEVEL).compress, sent.value.may_hold
        for batch in batches:
            got = [(i, n, key, press(media)) for i, (n, media) in enumerate(_files(batch)) if may_hold(key := _file_key(media))]
            cols = [pa.array([g[i] for g in got], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), *cols], ["doc_id", "n_bytes", "file", "packed"])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Store them without the chunks that they lack."""
        press, open_ = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield table(batch.column(0), [row(n, key, open_(blob), lacks, lends, press) for n, key, blob, lacks, lends in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)])

    texts = docs.select(id_col, text_col)
    moved = texts.mapInArrow(send, f"doc_id {id_type}, n_bytes long, file long, packed binary")
    moved = moved.join(shared.hint("shuffle_hash"), moved["doc_id"].eqNullSafe(F.col("i")) & (moved["file"] == F.col("f")), "left")
    moved = moved.select("doc_id", "n_bytes", "file", "packed", F.coalesce("lacks", none).alias("lacks"), F.coalesce("lends", none).alias("lends"))
    for part in (texts.mapInArrow(keep, stored), moved.mapInArrow(thin, stored)):
        part.write.mode("append").option("compression", "none").parquet(folder)
    return spark.read.schema(stored).parquet(folder)


FOUND = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def _kept(sizes: list[int], lacks: list[int], packed: bytes) -> list[bytes | None]:
    """The chunks of a stored row by position; None where it lacks one."""
    data, gone, at, out = zstandard.ZstdDecompressor().decompress(packed), {*lacks}, 0, []
    for i, size in enumerate(sizes):
        out.append(None if i in gone else data[at : at + size])
        at += 0 if i in gone else size
    return out


def read_back(store: DataFrame, with_payload: bool = False) -> DataFrame:
    """(doc_id, features...[, payload]) of every row of the store, from its stored bytes."""
    storage.small_batches(store.sparkSession)
    id_type = store.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {FOUND}" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns NAMES, and the fetched chunks (position, bytes)."""
        for batch in batches:
            rows = []
            for n, _, sha, sizes, digests, lacks, _, packed, fetched in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                others = {f["pos"]: f["bytes"] for f in fetched}
                pieces = [others[i] if p is None else p for i, p in enumerate(_kept(sizes, lacks, packed))]
                if any(_name(p) != d for p, d in zip(pieces, digests, strict=True)):
                    raise ValueError("a chunk doesn't match its digest")
                media = b"".join(pieces)
                if hashlib.sha256(media).digest() != sha:
                    raise ValueError("a file doesn't match its digest")
                payload = samples(media)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), sha.hex(), feature(payload), len(pieces), payload))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds[: len(names) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sizes, digests, lacks, lends, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = _kept(sizes, lacks, packed)
                found += [(digests[i], pieces[i]) for i in lends]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["d", "bytes"])

    pairs = "array<struct<pos:int,bytes:binary>>"
    whole = store.where(F.size("lacks") == 0).select(*NAMES, F.array().cast(pairs).alias("fetched")).mapInArrow(rebuilt, schema)
    # Rows that lack chunks: a number tells repeated rows apart, so it is written before it is used twice.
    partial = storage.cut(store.where(F.size("lacks") > 0).withColumn("row", F.monotonically_increasing_id()), "partial")
    wanted = partial.select("row", F.explode("lacks").alias("pos"), "names").select("row", "pos", F.get("names", F.col("pos")).alias("name"))
    bytes_of = store.where(F.size("lends") > 0).select("sizes", "names", "lacks", "lends", "packed").mapInArrow(lent, "d binary, bytes binary").dropDuplicates(["d"])
    fetched = wanted.join(bytes_of, F.col("name") == F.col("d")).groupBy("row").agg(F.collect_list(F.struct("pos", "bytes")).alias("fetched"))
    patched = partial.join(fetched, "row").select(*NAMES, "fetched").mapInArrow(rebuilt, schema)
    return whole.unionByName(patched)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """The query's rows: every text stored, read back and measured."""
    return read_back(build_store(docs, storage.work_folder(docs.sparkSession, "media")))
