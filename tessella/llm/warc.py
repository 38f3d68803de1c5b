"""WARC archives: write records, index first, then coalesced byte-range reads.

Writing: of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest
page_id is a response and the others revisit it; smaller ones are all responses. A task writes one
archive of gzip members (one a record) in the shared folder and returns, for each record, its file,
offset, length, URL and digest. The index is committed as a table, so an archive that a lost task
left behind is never read. Reading: the index rows of the selected records are sorted by file and
offset, near ranges are fetched in one read, and each record is parsed and its digest checked.

Null html is empty, a null url is written as an empty one, a null page_id counts as the largest. A page_id
that is listed twice gives two records; if both are first of their payload, that of the smallest url is
the response, and of rows that are alike in all three one (which can't be told from the others). An empty
table gives an empty index. Other columns are ignored.

At scale: the choice of responses aggregates digests (partial sums first); page rows move once, by
digest, in an equi-join whose hot partitions Spark splits. Reads are dealt out by blocks of archives, to
as many tasks as the bytes of the selected records ask for.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import storage

MIN_REVISIT = 100
#: Ranges no further apart than GAP are read together, up to READ bytes; a reading task is given blocks of READ bytes.
GAP, READ = 64 << 10, 4 << 20
#: Bytes of archives that a reading task is given, at least and where there are more than all cores at a time can take.
TASK = (1 << 20, 64 << 20)
LEVEL = 4

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, payload binary, truncated boolean"


def classified(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) of (page_id, url, html)."""
    df = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    alike = df.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url", "n")
    firsts = alike.groupBy("digest").agg(F.min(order).alias("m")).select(F.col("digest").alias("d"), F.col("m.page_id").alias("first"), F.col("m.url").alias("first_url"), F.col("m.n").alias("n"))
    firsts = storage.cut(firsts, "firsts")  # a plain input, so that Spark can split hot partitions of the join
    df = df.join(firsts.hint("shuffle_hash"), F.col("digest") == F.col("d"), "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    first = F.col("d").isNull() | is_first
    out = ["page_id", "url", "html", "digest", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("first")).alias("refers_to")]
    if firsts.where("n > 1").isEmpty():
        return df.select(*out)
    # Rows that are alike in all columns: one of them stands for all, and is dealt out again as a response and its revisits.
    one = df.where(is_first & (F.col("n") > 1)).dropDuplicates(["digest"])
    first = F.col("copy") == 1
    again = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*out[:4], F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("first")).alias("refers_to"))
    return df.where(F.col("d").isNull() | ~is_first | (F.col("n") == 1)).select(*out).unionByName(again)


def _filesystem(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record: a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder; the index, committed as folder/index."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out, name, at = None, f"part-{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                rows = []
                for x in batch.to_pylist():
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(os.path.join(base, name), compression=None)
                    payload = x["html"].encode()
                    member = zlib.compress(record_bytes(x["page_id"], x["url"], payload, x["digest"], x["record_type"], x["refers_to"]), LEVEL, wbits=31)
                    out.write(member)
                    rows.append((x["page_id"], x["url"], x["digest"], len(payload), x["record_type"], x["refers_to"], name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], strict=True)], names)
        finally:
            if out is not None:
                out.close()

    spark = pages.sparkSession
    storage.small_batches(spark)
    classified(pages).mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the selected index rows; page_id, url and the rest come from the archives, not from the index."""

    def fetch(fs, path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
        with fs.open_input_file(path) as f:
            i = 0
            while i < len(ranges):
                j, start, end = i, ranges[i][0], sum(ranges[i])
                while j + 1 < len(ranges) and ranges[j + 1][0] - end <= GAP and sum(ranges[j + 1]) - start <= READ:
                    j += 1
                    end = max(end, sum(ranges[j]))
                got = f.read_at(end - start, start)
                for offset, length in ranges[i : j + 1]:
                    yield zlib.decompress(got[offset - start : offset - start + length], wbits=31)
                i = j + 1

    def number(urn: str) -> int | None:
        n = urn.rstrip(">").rpartition(":")[2]
        return None if n == "none" else int(n)

    def parsed(raw: bytes) -> tuple:
        warc, http, payload = parse_record(raw)
        size, digest, kind = int(http["Content-Length"]), warc["WARC-Payload-Digest"].partition(":")[2], warc["WARC-Type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {warc['WARC-Record-ID']} doesn't match its digest")
        to = number(warc["WARC-Refers-To"]) if kind == "revisit" else None
        return (number(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], digest, size, kind, to, payload if with_payload and kind == "response" else None, kind == "revisit")

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("truncated", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            files, at, size = (batch.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j, total = i, 0
                while j < len(files) and files[j] == files[i] and total < READ:
                    total += size[j]
                    j += 1
                rows = [parsed(raw) for raw in fetch(fs, os.path.join(base, files[i]), list(zip(at[i:j], size[i:j], strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                i = j

    storage.small_batches(selected.sparkSession)
    # The number of tasks is fixed: adaptive execution would merge them by the bytes of the index, not of the archives.
    total, cores = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], selected.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK[1]), min(4 * cores, -(-total // TASK[0])))
    ranges = selected.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / READ)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The query's rows: every page written, indexed, read back; a revisit takes size and digest from the response it names."""
    folder = storage.work_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
