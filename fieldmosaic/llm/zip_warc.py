"""WARC records in ZIP packages, written by tasks and read back by ranges of bytes.

A package is a ZIP file of stored members: ``archive/*.warc.gz`` with one gzip member per
record, ``indexes/index.cdxj`` with a line per record, ``datapackage.json``. The reader
parses the end record, the ZIP64 records and the central directory itself, finds where the
stored members and the index begin, and then reads nothing but the byte ranges of the
records asked for; no package is extracted or opened whole. A package without an index is
walked record by record once.

Pages with equal payloads of at least ``least`` bytes are one response, that of the largest
key, and revisits of it. Payloads are compared by length, SHA-1 and SHA-256.

Cases: a null payload is an empty one. A row without a key is a revisit where its payload
has a keyed response, else a response; it comes back with a null key. Repeated rows of the
largest key are all responses. A null address leaves its header out and comes back null; control
characters and spaces in an address are percent-encoded. Extra columns are left out. An
empty table makes no package and reads as an empty table. Compressed or encrypted archive
members, damaged directories and payloads that don't match their digest are errors.

Packages are named anew by each attempt of a task and count only once the task's row is in
the written manifest, so lost executors leave files nobody reads, never half a result.
Workers reach the shared folder through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.llm.common import batch_of, partitions, text_slices, written

#: Bytes after which a WARC member ends, and after which a package does.
MEMBER_BYTES, PACKAGE_BYTES = 64 << 20, 256 << 20
#: Bytes read at once from neighbouring records, and bytes of packages a reading task gets.
RANGE_BYTES, TASK_BYTES = 4 << 20, 128 << 20
#: Fetch time of pages that have none.
NO_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("package", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_ENTRY = pa.schema([("package", pa.string()), ("member", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ENTRY_DDL = "package string, member string, url string, record_type string, offset bigint, length bigint"
_RECORD = pa.schema(
    [("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
_RECORD_DDL = "key bigint, url string, date string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", uri) else (pa.fs.LocalFileSystem(), uri)


# --- writing ---


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 1000) -> DataFrame:
    """``key, url, date, body, digest, size, original`` of each page. ``original`` is the key
    that a revisit refers to, null for a response; a revisit has no ``body``.

    Only payloads that occur twice join back, as a row each; a payload of very many pages
    is one key of a left join, whose large side adaptive execution splits.
    """
    date = F.date_format("fetch_time", "yyyy-MM-dd'T'HH:mm:ss'Z'") if "fetch_time" in pages.columns else F.lit(None).cast("string")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"),
        F.coalesce(date, F.lit(NO_DATE)).alias("date"),
        body.alias("body"),
    ).withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long"), "identity": F.unhex(F.sha2("body", 256))})
    groups = (
        rows.where(F.col("size") >= least).groupBy("digest", "size", "identity")
        .agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("times"))
        .where("times > 1 AND last IS NOT NULL").drop("times")
    )
    again = F.col("last").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("last")))
    return rows.join(groups, ["digest", "size", "identity"], "left").select(
        "key", "url", "date", F.when(~again, F.col("body")).alias("body"), "digest", "size", F.when(again, F.col("last")).alias("original")
    )


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


def _page_record(key: int | None, url: str | None, date: str, body: bytes | None, digest: str, size: int, original: int | None) -> bytes:
    name = f"urn:page:{key}" if key is not None else f"urn:uuid:{uuid.uuid4()}"
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if original is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{original}>")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record("response" if original is None else "revisit", fields, http + (body or b""))


def _sort_key(url: str | None) -> str:
    """Host labels from the right, then the path: pages of a site stand together."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", url or "")
    return f"{','.join(reversed(found[1].lower().split('.')))}){found[2]}" if found else "-"


class _Package:
    """One package being written, front to back, as stores without seeking need it."""

    def __init__(self, folder: str):
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri, self.lines, self.members, self.size, self.filled = f"{folder.rstrip('/')}/{name}", [], 0, 0, 0
        self._out = fs.open_output_stream(f"{path.rstrip('/')}/{name}")
        self._zip, self._member = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED), None

    def _next_member(self) -> None:
        if self._member:
            self._member.close()
        self.name, self.filled = f"data-{self.members:05d}.warc.gz", 0
        self.members += 1
        self._member = self._zip.open(f"archive/{self.name}", "w", force_zip64=True)
        self._put(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", NO_DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> int:
        at = self.filled
        self._member.write(record)
        self.filled += len(record)
        self.size += len(record)
        return at

    def add(self, record: bytes, url: str | None, date: str, kind: str, digest: str) -> None:
        if not self._member or self.filled >= MEMBER_BYTES:
            self._next_member()
        at = self._put(record)
        line = {"url": url, "type": kind, "digest": f"sha1:{digest}", "offset": at, "length": len(record), "filename": self.name}
        self.lines.append(f"{_sort_key(url)} {re.sub('[^0-9]', '', date)} {json.dumps(line)}\n")

    def close(self) -> tuple[str, int, int]:
        self._member.close()
        with self._zip.open("indexes/index.cdxj", "w", force_zip64=True) as out:
            for line in sorted(self.lines):
                out.write(line.encode())
        self._zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
        self._zip.close()
        self._out.close()
        return self.uri, self.size, len(self.lines)


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``decided`` rows to packages below ``folder``, several per task where they grow
    beyond ``PACKAGE_BYTES``. Returns the manifest ``package, bytes, records``, written down:
    the packages of attempts that succeeded."""

    def write(batches):
        package = None
        for batch in batches:
            for part, bodies in text_slices([batch], "body"):
                columns = [part.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
                for (key, url, date, digest, size, original), body in zip(zip(*columns, strict=True), bodies, strict=True):
                    if package is None:
                        package = _Package(folder)
                    plain = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                    record = _page_record(key, plain, date, body, digest, size, original)
                    package.add(record, plain, date, "response" if original is None else "revisit", digest)
                    if package.size >= PACKAGE_BYTES:
                        yield batch_of(_MANIFEST, [[x] for x in package.close()])
                        package = None
        if package:
            yield batch_of(_MANIFEST, [[x] for x in package.close()])

    return written(rows.mapInArrow(write, "package string, bytes bigint, records bigint"), "warc-manifest")


# --- reading ---


class Member(NamedTuple):
    """What the central directory says of a member; ``header`` is where its local header is."""

    name: str
    flags: int
    method: int
    packed: int
    size: int
    header: int


Reader = Callable[[int, int], bytes]


def _exactly(read: Reader, at: int, n: int) -> bytes:
    got = read(at, n) if at >= 0 else b""
    if len(got) != n:
        raise ValueError(f"the package ends within {n} bytes at {at}")
    return got


def _end_record(read: Reader, size: int) -> tuple[int, int, int, int]:
    """Entries, length and place of the central directory, and how far the package lies
    behind the start of its file."""
    begin = max(0, size - 65_557)
    tail = _exactly(read, begin, size - begin)
    at = tail.rfind(b"PK\5\6")
    while at >= 0:  # the comment must reach to the end exactly
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    entries, length, place = struct.unpack_from("<HII", tail, at + 10)
    end = begin + at
    if end >= 20 and (locator := _exactly(read, end - 20, 20))[:4] == b"PK\6\7":
        said = struct.unpack_from("<Q", locator, 8)[0]
        # behind prepended bytes the record isn't where the locator says but just before it
        for record in (said, end - 76):
            if 0 <= record <= size - 56 and (big := read(record, 56))[:4] == b"PK\6\6":
                wide = struct.unpack_from("<QQQ", big, 32)
                entries = wide[0] if entries == 0xFFFF else entries
                length = wide[1] if length == 0xFFFFFFFF else length
                place = wide[2] if place == 0xFFFFFFFF else place
                end = record
                break
        else:
            raise ValueError("the ZIP64 end record is missing")
    before = end - length - place
    if before < 0:
        raise ValueError("the central directory is out of place")
    return entries, length, place + before, before


def central_directory(read: Reader, size: int) -> Iterator[Member]:
    """The members of a package, from its directory alone, read a megabyte at a time."""
    entries, left, at, before = _end_record(read, size)
    held = b""
    for _ in range(entries):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack_from("<HHH", held, 28)):
            if not left:
                raise ValueError("the central directory ends early")
            more = _exactly(read, at, min(left, 1 << 20))
            held, at, left = held + more, at + len(more), left - len(more)
        if held[:4] != b"PK\1\2":
            raise ValueError("a directory entry is damaged")
        flags, method = struct.unpack_from("<HH", held, 8)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", held, 20)
        header = struct.unpack_from("<I", held, 42)[0]
        name = held[46 : 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        wide = _wide_sizes(held[46 + names : 46 + names + extras])
        plain, packed, header = (next(wide) if value == 0xFFFFFFFF else value for value in (plain, packed, header))
        yield Member(name, flags, method, packed, plain, header + before)
        held = held[46 + names + extras + comments :]


def _wide_sizes(extra: bytes) -> Iterator[int]:
    """The eight-byte values of the ZIP64 field, in the order of the fields they stand for."""
    while len(extra) >= 4:
        kind, length = struct.unpack_from("<HH", extra)
        if kind == 1:
            for i in range(4, 4 + length - 7, 8):
                yield struct.unpack_from("<Q", extra, i)[0]
        extra = extra[4 + length :]
    raise ValueError("a ZIP64 size is missing")


def stored_at(read: Reader, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method or member.flags & 1 or member.packed != member.size:
        raise ValueError(f"{member.name} is compressed or encrypted; ranges can't be read from it")
    head = _exactly(read, member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _lines(read: Reader, at: int, size: int, packed: bool) -> Iterator[bytes]:
    """Lines of a stored member, plain or in gzip members, a megabyte at a time."""
    unpack, rest = zlib.decompressobj(31), b""
    for start in range(0, size, 1 << 20):
        chunk = _exactly(read, at + start, min(1 << 20, size - start))
        if packed:
            plain = b""
            while chunk:
                plain += unpack.decompress(chunk)
                chunk = unpack.unused_data
                if unpack.eof:
                    unpack = zlib.decompressobj(31)
            chunk = plain
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walked(read: Reader, at: int, size: int) -> Iterator[tuple[int, int]]:
    """Place and length of each gzip member in a stored member without an index."""
    unpack, begin, done = zlib.decompressobj(31), at, at
    for start in range(at, at + size, 1 << 20):
        chunk = _exactly(read, start, min(1 << 20, at + size - start))
        while chunk:
            unpack.decompress(chunk)
            done += len(chunk) - len(unpack.unused_data)
            chunk = unpack.unused_data
            if unpack.eof:
                yield begin, done - begin
                unpack, begin = zlib.decompressobj(31), done
    if begin != done:
        raise ValueError("a record ends early")


def package_entries(read: Reader, size: int) -> Iterator[tuple[str, str | None, str | None, int, int]]:
    """Member, address, type, place in the package and length of each record."""
    members = list(m for m in central_directory(read, size) if m.name.startswith(("archive/", "indexes/")) and not m.name.endswith("/"))
    places = {m.name: (stored_at(read, m), m.size) for m in members}
    indexes = [n for n in places if re.search(r"^indexes/.*\.cdxj?(\.gz)?$", n)]
    for name in indexes:
        for line in _lines(read, *places[name], name.endswith(".gz")):
            if (start := line.find(b"{")) >= 0:
                entry = json.loads(line[start:])
                member = f"archive/{entry['filename'].removeprefix('archive/')}"
                begin, length = places[member]
                if int(entry["offset"]) + int(entry["length"]) > length:
                    raise ValueError(f"the index of {member} points beyond it")
                yield member, entry.get("url"), entry.get("type"), begin + int(entry["offset"]), int(entry["length"])
    if not indexes:
        for name, (begin, length) in places.items():
            if name.endswith(".warc.gz"):
                for at, n in _walked(read, begin, length):
                    yield name, None, None, at, n


def _reader(uri: str) -> tuple[pa.NativeFile, Reader]:
    fs, path = _store(uri)
    file = fs.open_input_file(path)
    return file, lambda at, n: file.read_at(n, at)


def entries(manifest: DataFrame) -> DataFrame:
    """A row per record of the packages in ``manifest`` (``package``): ``package, member, url,
    record_type, offset, length``, from directories and indexes only. Filter it to read some."""

    def listed(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file, read = _reader(uri)
                rows: list[tuple] = []
                with file:
                    for row in package_entries(read, file.size()):
                        rows.append((uri, *row))
                        if len(rows) == 10_000:
                            yield batch_of(_ENTRY, zip(*rows, strict=True))
                            rows = []
                if rows:
                    yield batch_of(_ENTRY, zip(*rows, strict=True))

    return manifest.select("package").repartition(partitions(manifest.sparkSession)).mapInArrow(listed, _ENTRY_DDL)


def _parsed(raw: bytes) -> tuple | None:
    """The columns of one record, None for records that are no pages."""
    unpack = zlib.decompressobj(31)
    plain = unpack.decompress(raw) + unpack.flush()
    if not unpack.eof or unpack.unused_data:
        raise ValueError("a range of the index is no record")
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, body = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    key, to = (_key(fields.get(name, "")) for name in ("warc-record-id", "warc-refers-to"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        size = len(body)
        if hashlib.sha1(body).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    else:
        size, body = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1]), None
    return key, fields.get("warc-target-uri"), fields["warc-date"], kind, to, digest, size, body


def _key(identity: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identity)
    return int(found[1]) if found else None


def read_records(found: DataFrame, total: int, payloads: bool = True) -> DataFrame:
    """The records of ``entries`` rows, each read by its range. Neighbours are read at once,
    up to ``RANGE_BYTES``. ``total``, the bytes of the packages, sets the number of tasks.
    Columns: ``key, url, date, record_type, refers_to, payload_digest, payload_bytes, payload``
    (null for revisits, and for all without ``payloads``)."""
    spark = found.sparkSession
    tasks = max(partitions(spark), -(-total // TASK_BYTES))
    near = F.floor(F.col("offset") / RANGE_BYTES)

    def read(batches):
        uri, file = None, None
        for batch in batches:
            names, places, lengths = (batch.column(i).to_pylist() for i in (0, 1, 2))
            low = 0
            while low < len(names):
                high, end = low + 1, places[low] + lengths[low]
                while high < len(names) and names[high] == names[low] and end <= places[high] <= end + 4096 and places[high] + lengths[high] - places[low] <= RANGE_BYTES:
                    end = places[high] + lengths[high]
                    high += 1
                if names[low] != uri:
                    if file:
                        file.close()
                    uri = names[low]
                    file, at = _reader(uri)
                held = _exactly(at, places[low], end - places[low])
                rows = [_parsed(held[p - places[low] : p - places[low] + n]) for p, n in zip(places[low:high], lengths[low:high], strict=True)]
                rows = [r if payloads else (*r[:-1], None) for r in rows if r]
                if rows:
                    yield batch_of(_RECORD, zip(*rows, strict=True))
                low = high
        if file:
            file.close()

    dealt = found.repartition(tasks, "package", near).sortWithinPartitions("package", "offset")
    return dealt.select("package", "offset", "length").mapInArrow(read, _RECORD_DDL)


def total_bytes(manifest: DataFrame) -> int:
    return manifest.agg(F.sum("bytes")).first()[0] or 0


def round_trip(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", least: int = 1000) -> DataFrame:
    """Write all pages and read every record back, without payloads."""
    manifest = write_packages(decided(pages, key, payload, least), folder)
    return read_records(entries(manifest), total_bytes(manifest), payloads=False)


#: The rows of the query ``op11_warc`` in SQL.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         sha256(coalesce(html, '')) AS whole FROM pages),
g AS (SELECT whole, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY whole)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN g USING (whole)
"""
