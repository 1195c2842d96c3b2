"""WARC files packed in ZIP archives, written and read by ranges.

An archive holds a WARC file of one gzip member a record and its index, both
stored without further compression. The reader parses the central directory, or
its ZIP64 form, locates the members and reads records by byte range; nothing is
extracted. Files are reached through pyarrow's file systems in the shared
folder, never in a local one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, new_path

#: A task starts a new archive beyond so many bytes, and a reader takes so many at once.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# Records


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'none' if page is None else page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Payload-Length", str(len(payload)))]
    else:
        block += payload
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = lambda v: None if v == "<urn:page:none>" else int(v[len("<urn:page:") : -1])
    out = {"page_id": page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "refers_to": None, "payload": payload}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "refers_to": page(fields["warc-refers-to"]), "payload_bytes": int(fields["warc-payload-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


# ZIP directories


def directory(read: Callable[[int, int], bytes], size: int) -> list[dict]:
    """name, method, header, size of each member, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    central, out, at = read(start, length), [], 0
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        packed, whole, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, at + 20)
        header = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that overflow, in this order
                values, v = struct.unpack_from(f"<{n // 8}Q", extra, k + 4), 0
                if whole == 0xFFFFFFFF:
                    whole, v = values[v], v + 1
                if packed == 0xFFFFFFFF:
                    packed, v = values[v], v + 1
                if header == 0xFFFFFFFF:
                    header = values[v]
            k += 4 + n
        out.append({"name": name, "method": method, "header": header, "size": packed})
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(read: Callable[[int, int], bytes], member: dict) -> int:
    """Where a stored member's bytes begin; its local header may differ in length from the central one."""
    head = read(member["header"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    if member["method"] != zipfile.ZIP_STORED:
        raise ValueError(f"{member['name']} is compressed and can't be read by range")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member["header"] + 30 + n_name + n_extra


def gzip_members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """start, length and content of each gzip member in a row of them."""
    at = 0
    while at < len(data):
        d = zlib.decompressobj(31)
        raw = d.decompress(data[at:])
        used = len(data) - at - len(d.unused_data)
        yield at, used, raw
        at += used


# Spark


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        body, index = io.BytesIO(), []

        def flush() -> pa.RecordBatch:
            # A new name for each attempt: a task that is run again never meets what an earlier attempt left.
            name = f"{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{base}/{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
                with z.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as f:
                    f.write(body.getbuffer())
                with z.open(zipfile.ZipInfo(INDEX_MEMBER), "w") as f:
                    f.write("".join(f"{key} 19700101000000 {json.dumps({'offset': str(o), 'length': str(n), 'filename': WARC_MEMBER})}\n" for key, o, n in sorted(index)).encode())
            out = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(index)], pa.int64())})
            body.seek(0)
            body.truncate()
            index.clear()
            return out

        files.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                raw = gzip.compress(record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["kind"], row["refers_to"]), 4, mtime=0)
                index.append((quote(row["url"] or "", safe=":/?&=.,-_~"), body.tell(), len(raw)))
                body.write(raw)
                if body.tell() >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    return write


def _locator(folder: str, range_bytes: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with files.open_input_file(f"{base}/{name}") as f:
                    read = lambda at, n, f=f: f.read_at(n, at)
                    yield from _ranges(name, read, f.size(), range_bytes)

    return locate


def _ranges(name: str, read, size: int, range_bytes: int) -> Iterator[pa.RecordBatch]:
    members = directory(read, size)
    start = {m["name"]: data_start(read, m) for m in members if m["name"].startswith("archive/")}
    found = []
    indexed = [m for m in members if m["name"].startswith("indexes/")]
    for m in indexed:
        for line in read(data_start(read, m), m["size"]).decode().splitlines():
            x = json.loads(line.split(" ", 2)[2])
            found.append((start[x["filename"]] + int(x["offset"]), int(x["length"])))
    if not indexed:
        for m in members:
            if m["name"] in start:
                found += [(start[m["name"]] + at, n) for at, n, _ in gzip_members(read(start[m["name"]], m["size"]))]
    found.sort()
    while found:
        k = next((i for i in range(1, len(found)) if found[i][0] + found[i][1] - found[0][0] > range_bytes), len(found))
        part, found = found[:k], found[k:]
        yield pa.RecordBatch.from_pydict({"archive": [name], "offsets": pa.array([[a for a, _ in part]], pa.list_(pa.int64())), "lengths": pa.array([[n for _, n in part]], pa.list_(pa.int64()))})


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _reader(folder: str):
    def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
        for batch in batches:
            for row in batch.to_pylist():
                first, last = row["offsets"][0], row["offsets"][-1] + row["lengths"][-1]
                with files.open_input_file(f"{base}/{row['archive']}") as f:
                    data = f.read_at(last - first, first)
                rows = [parse_record(gzip.decompress(data[o - first : o - first + n])) for o, n in zip(row["offsets"], row["lengths"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return read_ranges


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes a record per page and returns the folder and its table of archives (archive, records).

    Null html is an empty payload, null page_id and url are kept as such. Of
    equal payloads of REVISIT_FROM bytes or more the row with the largest
    page_id is the response; further rows with that page_id are revisits of it
    only if another row was it, so repeated rows are all responses. An empty
    table gives no archive.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= REVISIT_FROM
    first = p.where(large).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    p = p.join(first, "digest", "left").withColumn("kind", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response"))
    p = p.select("page_id", "url", "payload", "digest", "kind", F.when(F.col("kind") == "revisit", F.col("first")).alias("refers_to"))
    folder = new_path(pages.sparkSession, "archives")
    return folder, materialise(p.mapInArrow(_writer(folder, archive_bytes), "archive string, records long"), "archive-list")


def read_archives(archives: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives named in a table (archive), with their payloads; a revisit has none of its own."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.select("archive").repartition(n).mapInArrow(_locator(folder, range_bytes), "archive string, offsets array<long>, lengths array<long>")
    return ranges.repartition(n).mapInArrow(_reader(folder), READ_SCHEMA)
