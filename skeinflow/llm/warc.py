"""WARC records in ZIP packages: a writer that deduplicates payloads, and a reader that range-reads records in place."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, shared_path, staged

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Uncompressed bytes of records after which a package is closed and the next begun.
PACKAGE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


# --- records -------------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(ident: str, url: str | None, payload: bytes, kind: str, refers: str | None, extra: dict[str, str]) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "WARC-Payload-Length": str(len(payload))}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page": str(refers)}
    head |= extra | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload (of a response: the HTTP body) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- ZIP packages --------------------------------------------------------------------------------------------------

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


class Ranged:
    """Reads of byte ranges of a file, by way of its file system; counts what it reads."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size, self.bytes_read = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        self.bytes_read += len(data)
        if len(data) != n:
            raise ValueError(f"{n} bytes at {at} go beyond the file's end")
        return data

    def close(self) -> None:
        self.file.close()


def end_of_central(f: Ranged) -> tuple[int, int, int]:
    """(entries, size, offset, shift) of the central directory, from its end record or, where that is full, the ZIP64 one.

    shift is what stands in the file before the ZIP: all offsets that it holds are so much too small.
    """
    tail_at = max(0, f.size - 22 - FULL16)
    tail = f.read(tail_at, f.size - tail_at)
    # A comment may hold the signature too: the record's comment ends where the file does.
    at = tail.rfind(END, 0, len(tail) - 18)
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at + 3)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP file")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    here = tail_at + at
    if here >= 20 and (FULL16 == entries or FULL32 in (size, offset)):
        sign, _, where, _ = struct.unpack("<4sIQI", f.read(here - 20, 20))
        if sign == LOCATOR64:
            # Right before the locator, unless the record has data of its own; the locator's offset may be shifted.
            for here in (here - 76, where):
                if 0 <= here <= f.size - 56:
                    sign, *_, entries, size, offset = struct.unpack("<4sQHHIIQQQQ", f.read(here, 56))
                    if sign == END64:
                        break
            else:
                raise ValueError("the ZIP64 locator points to no end record")
    shift = here - size - offset
    if shift < 0 or entries and f.read(offset + shift, 4) != CENTRAL:
        shift = 0
    return entries, size, offset, shift


def members(f: Ranged) -> dict[str, tuple[int, int, int, int]]:
    """{name: (method, compressed size, size, offset of the local header)} from the central directory."""
    entries, size, offset, shift = end_of_central(f)
    raw, at, out = f.read(offset + shift, size), 0, {}
    for _ in range(entries):
        sign, flags, method, packed, full, n, x, c, where = struct.unpack_from("<4s4xHH8xIIHHH8xI", raw, at)
        if sign != CENTRAL:
            raise ValueError("a broken central directory")
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, wide = raw[at + 46 + n : at + 46 + n + x], {}
        while len(extra) >= 4:
            tag, k = struct.unpack_from("<HH", extra)
            wide[tag], extra = extra[4 : 4 + k], extra[4 + k :]
        big = iter(struct.unpack(f"<{len(wide[1]) // 8}Q", wide[1][: len(wide[1]) // 8 * 8])) if 1 in wide else iter(())
        full, packed, where = (next(big) if v == FULL32 else v for v in (full, packed, where))
        out[name] = method, packed, full, where + shift
        at += 46 + n + x + c
    return out


def member_start(f: Ranged, entry: tuple[int, int, int, int]) -> int:
    """Where a stored member's bytes begin in the file."""
    method, packed, full, where = entry
    if method or packed != full:
        raise ValueError("only stored members can be read in ranges")
    sign, n, x = struct.unpack("<4s22xHH", f.read(where, 30))
    if sign != LOCAL:
        raise ValueError("no local header where the directory says")
    return where + 30 + n + x


def index_lines(f: Ranged, name: str, entry: tuple[int, int, int, int], step: int) -> Iterator[bytes]:
    """Lines of an index member, streamed; of a gzipped one, member after member."""
    at, left, rest = member_start(f, entry), entry[2], b""
    unpack = zlib.decompressobj(31) if name.endswith(".gz") else None
    while left:
        part = f.read(at, min(left, step))
        at, left = at + len(part), left - len(part)
        if unpack:
            raw, part = part, b""
            while raw:
                part += unpack.decompress(raw)
                raw = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
        lines = (rest + part).split(b"\n")
        rest = lines.pop()
        yield from lines
    if rest:
        yield rest


def read_package(uri: str, wanted: set[str] | None = None, pattern: str = "archive/", index_bytes: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a package by its index: each is read by its own range, never the whole member. wanted: record ids.

    The index is streamed, so memory holds a part of it and one record. Indexes of other writers may be gzipped, name
    archives without their folder, give numbers as text, and no record ids: those are then the records' own. Archives
    are gzip members by record, or not compressed.
    """
    f = Ranged(uri)
    try:
        found = members(f)
        begin = {name: member_start(f, e) for name, e in found.items() if name.startswith(pattern)}
        for name in sorted(x for x in found if x.startswith("indexes/") and x.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
            for line in index_lines(f, name, found[name], index_bytes):
                if b"{" not in line:
                    continue
                entry = json.loads(line[line.index(b"{") :])
                if wanted is not None and "id" in entry and entry["id"] not in wanted:
                    continue
                file = entry["filename"]
                raw = f.read(begin[file if file in begin else pattern + file] + int(entry["offset"]), int(entry["length"]))
                head, body = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                if wanted is None or "id" in entry or head["warc-record-id"].strip("<>").removeprefix("urn:uuid:") in wanted:
                    yield head, body
    finally:
        f.close()


class Package:
    """A ZIP package being written: stored members, records as gzip members of one archive, an index beside it."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(_Unseekable(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index, self.at, self.raw, self.rows = io.BytesIO(), 0, 0, 0

    def add(self, ident: str, url: str | None, raw: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(raw) + pack.flush()
        self.member.write(data)
        self.index.write(f"{ident} {json.dumps({'id': ident, 'url': url, 'filename': ARCHIVE, 'offset': self.at, 'length': len(data)})}\n".encode())
        self.at, self.raw, self.rows = self.at + len(data), self.raw + len(raw), self.rows + 1

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(self.index.getbuffer())
        self.zip.close()
        self.out.close()


class _Unseekable(io.RawIOBase):
    """An output stream as zipfile wants it; object stores can't seek back, so sizes follow the data."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


# --- over Spark ----------------------------------------------------------------------------------------------------


def dedup_kinds(pages: DataFrame, ident: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """pages with __response (a taken name gets a _, the last column in any case): the largest id among rows of an equal payload of at least `least` bytes.

    Null where the payload is smaller, alone, or has no id among its rows. Digests and ids alone are grouped; the join
    deals rows by digest, and AQE splits a digest that many rows share.
    """
    sha, other, response = own(pages, "__sha", "__s", "__response")
    body = F.coalesce(F.col(quoted(payload)), F.lit(""))
    rows = pages.withColumn(sha, F.when(F.octet_length(body) >= least, F.sha1(body)))
    first = rows.where(F.col(sha).isNotNull()).select(F.col(sha).alias(other), F.col(quoted(ident)).alias("i")).groupBy(other).agg(F.max("i").alias(response), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, F.col(sha) == F.col(other), "left").select(*map(quoted, pages.columns), response)


def write_packages(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row into ZIP packages below folder; (package, records), written down once all are complete.

    A task writes files of its own names and reports those it closed, so that what a failed or doubled attempt left
    behind is never read. folder is a URI that executors can write to through Arrow's file systems.
    """
    rows = pages.select(F.col(quoted(ident)).alias("i"), F.col(quoted(url)).alias("u"), F.col(quoted(payload)).alias("p"))
    rows = dedup_kinds(rows, "i", "p", least).select(F.col("i").cast("string").alias("i"), "u", "p", F.col("__response").cast("string").alias("r"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for i, u, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    done.append([f"{folder}/{uuid.uuid4().hex}.wacz", 0])
                    now = Package(done[-1][0])
                kind = "revisit" if r is not None and r != i else "response"
                name = str(uuid.uuid4())
                now.add(name, u, record(name, u, (p or "").encode(), kind, r, {} if i is None else {"X-Page-Id": i}))
                if now.raw >= PACKAGE_BYTES:
                    now.close()
                    done[-1][1], now = now.rows, None
        if now is not None:
            now.close()
            done[-1][1] = now.rows
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["package", "records"])

    return staged(rows.mapInArrow(write, "package string, records long"), "packages")


SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the packages; a response whose payload isn't what its header says raises.

    payload_bytes and payload_digest are the record's headers; a record without them has its own payload's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                for head, body in read_package(uri):
                    here = digest_of(body), len(body)
                    said, size = head.get("warc-payload-digest", f"sha1:{here[0]}").removeprefix("sha1:"), int(head.get("warc-payload-length", here[1]))
                    if head["warc-type"] == "response" and ":" not in said and here != (said, size):
                        raise ValueError(f"{uri}: the payload of {head['warc-record-id']} is not what its digest says")
                    rows.append((head.get("x-page-id"), head.get("warc-target-uri"), size, said, head["warc-type"], head.get("x-refers-to-page"), body if payloads and head["warc-type"] == "response" else None))
                    held += len(body) if payloads else 200
                    if held > 8 << 20:
                        yield _table(rows)
                        rows, held = [], 0
                yield _table(rows)

    # A package is a task's work; their list alone would be a partition or two.
    return packages.select("package").repartition(max(1, min(packages.count(), 1 << 16)), "package").mapInArrow(read, SCHEMA)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; equal payloads of any size, empty ones too, are stored once.

    Repeated rows of one page that hold the largest id are each a response.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    back = read_packages(write_packages(pages, shared_path(spark, "warc")), payloads=False)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, coalesce(html, '') as body, sha1(coalesce(html, '')) as s from pages),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(s, i::int, 1))::int), 4, '0')), '') as bits, max(page_id) over (partition by body) as m from d)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, (i + 1)::int, 1)::int
  + 8 * substr(bits, (i + 2)::int, 1)::int + 4 * substr(bits, (i + 3)::int, 1)::int + 2 * substr(bits, (i + 4)::int, 1)::int + substr(bits, (i + 5)::int, 1)::int)::int, 1)), '') as payload_digest,
  case when page_id = m or m is null then 'response' else 'revisit' end as record_type, case when page_id <> m then m end as refers_to from b
"""
