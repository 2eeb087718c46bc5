"""WARC archives with an index that comes first: what is read back is read by byte ranges that the index gives.

`write_archives` writes one gzip member per record and returns the index: path, offset, length, url and digest of every
record, with page_id and record type. `read_records` takes any selection of index rows, sorts it by file and offset,
joins ranges that touch or nearly touch into one read, and parses the records from there.

Payloads of at least `least` bytes are stored once: of the records with equal payloads the one with the smallest page_id
is a response, and the others are revisits of it, without a body. Shorter ones are all responses.

Null html is an empty payload, a null url is an empty target, line breaks go out of urls, a null page_id is written as none and is never revisited
unless no record of that payload has an id (then all are responses). Repeated rows are written one by one; a row that
has the page_id of the response is a response itself. No rows, no files: reading gives no rows. Payloads of any length
are written and read whole; other columns of pages, whatever their names, are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bitmap import bitmap, has_hash, of_hash
from quire.llm.common import filesystem, new_folder, written

INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NAME = "urn:x-page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, not compressed."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_NAME}{'none' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(url.splitlines())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    block = _HTTP % len(payload)
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Refers-To", f"<{_NAME}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes]:
    """RECORD of an uncompressed record. A response's digest is taken from its payload; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x == "none" else int(x)
    name = lambda k: number(fields[k][1 + len(_NAME) : -1])
    size = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "revisit":
        return name("WARC-Record-ID"), fields["WARC-Target-URI"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", name("WARC-Refers-To"), b""
    if len(payload) != size or fields["WARC-Payload-Digest"] != "sha1:" + (found := digest(payload)):
        raise ValueError(f"the record {fields['WARC-Record-ID']} is damaged")
    return name("WARC-Record-ID"), fields["WARC-Target-URI"], size, found, "response", None, payload


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes all pages (page_id, url, html) as archives into folder; returns their INDEX, written there too."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sum", F.sha1("payload"))
    # only payloads that occur twice are joined, and these are dealt by a salt too, so no payload's copies meet in one task
    twice = rows.groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sum", "first")
    twice = written(twice.withColumn("key", F.xxhash64("sum")), "warc-copies")
    held = pages.sparkSession.sparkContext.broadcast(bitmap(twice, of_hash("key")))

    def part(maybe: bool) -> DataFrame:
        def parted(batches: Iterator) -> Iterator:
            import pyarrow as pa

            bits = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(has_hash(bits, batch.column(4).to_numpy()) == maybe))

        return rows.withColumn("key", F.xxhash64("sum")).mapInArrow(parted, "page_id long, url string, payload binary, sum string, key long")

    salted = twice.select("sum", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = part(True).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sum", "salt"], "left")
    known = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= least)
    copies = copies.select("page_id", "url", "payload", F.when(known, F.col("first")).alias("refers_to"))
    rows = part(False).select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(copies)

    def archived(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        system, top = filesystem(folder)
        system.create_dir(top, recursive=True)
        # attempts of one task may meet rows in another order: each writes files of its own, and the index tells which ones count
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        made, out, index, at, name, draft = 0, None, [], 0, "", ""

        def finish() -> pa.RecordBatch:
            nonlocal out, index, at, made
            out.close()
            system.move(draft, f"{top}/{name}")
            got = pa.RecordBatch.from_pylist(index, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())]))
            out, index, at, made = None, [], 0, made + 1
            return got

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{part:06d}-{made:06d}-{attempt}.warc.gz"
                    draft = f"{top}/_{name}"
                    out = system.open_output_stream(draft, compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(page_id, url, payload, refers_to)
                data = z.compress(raw) + z.flush()
                out.write(data)
                index.append({"path": f"{folder}/{name}", "offset": at, "length": len(data), "url": url, "payload_digest": digest(payload), "page_id": page_id, "record_type": "response" if refers_to is None else "revisit"})
                at += len(data)
                if at >= file_bytes:
                    yield finish()
        if out is not None:
            yield finish()

    return written(rows.mapInArrow(archived, INDEX), "warc-index")


def ranges(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) as reads: (from, to, offset, length), spans from-to lying in the range."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(spans):
        if out and offset - (out[-1][2] + out[-1][3]) <= gap and offset + length - out[-1][2] <= most:
            a, _, start, size = out[-1]
            out[-1] = a, i + 1, start, max(size, offset + length - start)
        else:
            out.append((i, i + 1, offset, length))
    return out


def read_records(selected: DataFrame, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True, task_bytes: int = 4 << 20) -> DataFrame:
    """RECORD of each row of selected, which has path, offset and length of an index. payloads: False leaves them null."""

    def fetched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            rows = [*zip(*(batch.column(i).to_pylist() for i in range(3)))]
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to][0] == rows[at][0]:
                    to += 1
                system, path = filesystem(rows[at][0])
                with system.open_input_file(path) as f:
                    for a, b, start, size in ranges([r[1:] for r in rows[at:to]], gap, most):
                        data = memoryview(f.read_at(size, start))
                        got = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows[at + a : at + b]]
                        cols = [*zip(*got)]
                        if not payloads:
                            cols[6] = [None] * len(got)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                at = to

    # dealt by bytes of archive, not of index: stretches of a file, as many tasks as there are `task_bytes`
    total = selected.agg(F.sum("length")).first()[0] or 0
    order = selected.select("path", "offset", "length").repartition(max(1, -(-total // task_bytes)), "path", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("path", "offset")
    return order.mapInArrow(fetched, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads all of them back, without payloads."""
    return read_records(write_archives(pages, new_folder(pages.sparkSession, "warc"), least), payloads=False).drop("payload")
