"""WARC records in ZIP packages: written as stored members with an index, read by range without extraction.

A package holds stored archives ``archive/*.warc.gz``, in which every record is a gzip member of its own, and stored
indexes ``indexes/*.cdxj`` (a line for each record: key, time, JSON with file name, offset and length). The reader opens a
package in its file system, finds the end record from the file's tail, follows ZIP64 records where they are present,
walks the central directory, and reads indexes and records by offset: the package is never loaded or extracted, so its
size doesn't matter. Index entries become spans of bounded length, which are dealt over all tasks. An archive without an
index is walked from its first record to its last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import new_path, ship, snapshot
from rasterjobs.sources.files import ranges, write_bytes

#: Bytes of records from which a package closes; bytes that one read of records spans at most.
PACKAGE, SPAN = 64 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, payload binary"
_NONE = "none"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{_NONE if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    """The page of an id that :func:`record` wrote; ids of other writers name no page."""
    text = (uri or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if uri and uri.startswith("<urn:x-page:") and text.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        safe = "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False, comment: bytes = b"") -> bytes:
    """A ZIP file of stored members; ``zip64`` writes the 64-bit forms even where 32 bits would do."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), len(out)
        big = zip64 or len(data) >= 0xFFFFFFFF or at >= 0xFFFFFFFF
        size, place = (0xFFFFFFFF, 0xFFFFFFFF) if big else (len(data), at)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or at >= 0xFFFFFFFF or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment))
    else:
        out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, len(central), at, len(comment))
    return bytes(out + comment)


class ZipRanges:
    """Members of a ZIP package by byte range; ``read(offset, length)`` is all that it needs of the file."""

    def __init__(self, read, size: int):
        self.read, self.members = read, {}
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        at = len(tail) - 22
        # the comment's length must reach the end exactly, or these bytes aren't the end record
        while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at -= 1
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        place = tail_at + at
        if place >= 20:
            locator = read(place - 20, 20)
            if locator[:4] == b"PK\6\7":
                end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != b"PK\6\6":
                    raise ValueError("broken ZIP64 end record")
                n, length, start = struct.unpack_from("<QQQ", end, 32)
        directory, at = read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method, packed, plain = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<II", directory, at + 20)
            names, extras, comments = struct.unpack_from("<HHH", directory, at + 28)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            (flags,) = struct.unpack_from("<H", directory, at + 8)
            name = bytes(directory[at + 46 : at + 46 + names]).decode("utf-8" if flags & 0x800 else "cp437", "replace")
            extra = bytes(directory[at + 46 + names : at + 46 + names + extras])
            while len(extra) >= 4:
                kind, size_ = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                extra = extra[4 + size_ :]
            if method == 0 and packed == plain:
                self.members[name] = (local, plain)
            at += 46 + names + extras + comments
        self._data: dict[str, int] = {}

    def range(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        local, size = self.members[name]
        if name not in self._data:  # the local header's own lengths tell where the data starts
            head = self.read(local, 30)
            if head[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            self._data[name] = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        length = size - offset if length is None else length
        if offset + length > size:
            raise ValueError("range beyond the member")
        return self.read(self._data[name] + offset, length)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, of the first line of each; blanks around the colon don't matter, other lines are passed over."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon and name.strip() and not line[:1].isspace():
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _split(raw: bytes) -> tuple[bytes, bytes]:
    """Head and rest at the first empty line, of either kind of line end."""
    ends = [(at, gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := raw.find(gap)) >= 0]
    if not ends:
        return raw, b""
    at, gap = min(ends)
    return raw[:at], raw[at + len(gap) :]


def unchunked(body: bytes) -> bytes:
    """An HTTP body sent in chunks; of a broken one what can be read."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else 0
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def parse(raw: bytes) -> tuple | None:
    """A row of RECORDS of one WARC record of any writer; None unless it is a response, revisit or resource.

    A response's payload is its HTTP body, without chunks; of a record that isn't HTTP, its block. A missing digest is computed; a
    revisit has the length that its HTTP header tells, or none.
    """
    head, rest = _split(raw)
    fields = _fields(head)
    kind = fields.get("warc-type", "").lower()
    if kind not in ("response", "revisit", "resource"):
        return None
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    payload, size = block, len(block)
    if block[:5].upper() == b"HTTP/":
        http, payload = _split(block)
        told = _fields(http)
        if "chunked" in told.get("transfer-encoding", "").lower():
            payload = unchunked(payload)
        size = len(payload)
        if kind == "revisit":
            size = int(told["content-length"]) if told.get("content-length", "").isdigit() else None
    elif kind == "revisit":
        size = None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or (None if kind == "revisit" else base32_sha1(payload))
    refers = fields.get("warc-refers-to")
    name = fields.get("warc-record-id")
    return _page(name), fields.get("warc-target-uri"), size, digest, kind, _page(refers), name, refers, None if kind == "revisit" else payload


def _packages(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Writes packages under names of this attempt's own and tells (path, length); only what a finished task tells counts."""
    data, index = bytearray(), []

    def close():
        whole = zip_stored([(ARCHIVE, bytes(data)), (INDEX, "".join(index).encode())])
        name = f"{path}/{uuid.uuid4().hex}.wacz"
        write_bytes(name, whole)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(whole)], pa.int64())], ["path", "length"])

    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            for page_id, url, payload, first, revisit in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "revisit")), strict=True):
                raw = gzip.compress(record(page_id, url, payload, base32_sha1(payload), first, revisit), 6, mtime=0)
                place = {"filename": ARCHIVE.rsplit("/", 1)[1], "offset": str(len(data)), "length": str(len(raw))}
                index.append(f"{_NONE if page_id is None else page_id} 19700101000000 {json.dumps(place)}\n")
                data += raw
                if len(data) >= limit:
                    yield close()
                    data, index = bytearray(), []
    if index:
        yield close()


SPANS = "path string, archive string, at long, length long, records array<long>"


def spans(package: ZipRanges, limit: int = SPAN) -> Iterator[tuple[str, int, int, list[int] | None]]:
    """(archive, start, length, record starts) of a package: neighbours in its indexes share a span; starts are None for an archive without index."""
    archives = {name: size for name, (_, size) in package.members.items() if name.endswith((".warc", ".warc.gz"))}
    by_file = {name.rsplit("/", 1)[-1]: name for name in archives}
    places: dict[str, list[tuple[int, int]]] = {name: [] for name in archives}
    for name in package.members:
        if name.endswith((".cdx", ".cdxj")):
            for line in package.range(name).decode().splitlines():
                _, brace, rest = line.partition("{")
                if brace:
                    entry = json.loads(brace + rest)
                    if entry.get("filename", "").rsplit("/", 1)[-1] in by_file:
                        places[by_file[entry["filename"].rsplit("/", 1)[-1]]].append((int(entry["offset"]), int(entry["length"])))
    for name, found in places.items():
        if not found and archives[name]:
            yield name, 0, archives[name], None
        start, end, at = None, 0, []
        for offset, length in sorted(set(found)):
            if start is not None and (offset + length - start > limit or offset > end):
                yield name, start, end - start, at
                start, at = None, []
            start = offset if start is None else start
            at.append(offset)
            end = offset + length
        if at:
            yield name, start, end - start, at


def walk(read: Callable[[int, int], bytes], size: int, packed: bool, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive one by one, read in steps: gzip members, or plain records by their Content-Length."""
    at, held = 0, b""
    while packed and (held or at < size):
        out, inflate = [], zlib.decompressobj(31)
        while not inflate.eof:
            if not held:
                if at >= size:
                    raise ValueError("archive ends inside a record")
                held = read(at, min(step, size - at))
                at += len(held)
            out.append(inflate.decompress(held))
            held = inflate.unused_data
        yield b"".join(out)
    while not packed and (held or at < size):
        while b"\r\n\r\n" not in held and at < size:
            held += read(at, min(step, size - at))
            at = min(size, at + step)
        head, gap, _ = held.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("archive ends inside a header")
        sizes = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        end = len(head) + 4 + int(sizes[0]) + 4
        while len(held) < end and at < size:
            held += read(at, min(step, size - at))
            at = min(size, at + step)
        yield held[:end]
        held = held[end:]


def _listed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = list(spans(ZipRanges(*ranges(path)), limit))
            if found:
                archive, at, length, records = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(archive), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(records, pa.list_(pa.int64()))], ["path", "archive", "at", "length", "records"])


def _records(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "payload"]
    rows, held = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    path, package = None, None
    for batch in batches:
        for span in batch.to_pylist():
            if span["path"] != path:
                path, package = span["path"], ZipRanges(*ranges(span["path"]))
            name, at, packed = span["archive"], span["at"], span["archive"].endswith(".gz")
            if span["records"] is None:
                found = walk(lambda a, n, z=package, m=name: z.range(m, a, n), span["length"], packed)
            else:
                raw = package.range(name, at, span["length"])
                cuts = [x - at for x in span["records"]] + [len(raw)]
                found = (gzip.decompress(raw[a:b]) if packed else raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            for one in found:
                row = parse(one)
                if row is None:
                    continue
                rows.append(row if payloads else (*row[:-1], None))
                held += len(one) if payloads else 100
                if held > 4 << 20:
                    yield made()
                    rows, held = [], 0
    if rows:
        yield made()


def write_packages(pages: DataFrame, path: str, least: int = 0, package: int = PACKAGE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages in ``path``; ``(path, length)`` of those that count.

    Of equal payloads of at least ``least`` bytes only one is a response: the row with the smallest page_id; the
    others are revisits that refer to it. A null html is an empty payload. Rows that repeat both page_id and
    payload of a response are responses as well; rows with a null page_id are revisits if any row of the payload has
    an id, else responses. An empty table gives no packages. Other columns are not read. Payloads are shuffled only if the
    table of digests that occur twice is too large for a broadcast. A text of any length is one
    record, and packages close from ``package`` bytes on, so a task holds that and its longest text.
    """
    ship(pages.sparkSession)
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    twice = rows.where(F.length("payload") >= least).select("page_id", "key").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    told = salted_join(rows, snapshot(twice, "digests"), "key", "__n", ["page_id"], "left")
    told = told.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    made = told.select("page_id", "url", "payload", "first", "revisit").mapInArrow(lambda it: _packages(it, path, package), "path string, length long")
    return snapshot(made, "packages")


def read_packages(spark: SparkSession, packages: str | DataFrame, payloads: bool = True, span: int = SPAN) -> DataFrame:
    """Rows ``RECORDS`` of packages: all files of a folder, or those that a table (path) names; revisits have no payload of their own.

    Records of any writer are read: ``record_id`` and ``refers_to_id`` are their own names, ``page_id`` and ``refers_to`` are null unless
    :func:`write_packages` wrote them. Records other than responses, revisits and resources are left out. A record of any
    length is held whole, one at a time.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(packages).where("length > 0") if isinstance(packages, str) else packages
    found = snapshot(files.select("path").mapInArrow(lambda it: _listed(it, span), SPANS), "spans")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "path", "archive", "at").mapInArrow(lambda it: _records(it, payloads), RECORDS)


def archived(pages: DataFrame, least: int = 0, package: int = PACKAGE) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read them back: ``RECORDS`` without payloads."""
    path = new_path(pages.sparkSession, "warc")
    return read_packages(pages.sparkSession, write_packages(pages, path, least, package), payloads=False).drop("payload")
