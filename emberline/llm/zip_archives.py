"""Web archives in ZIP packages: written as WARC members with an index, read by ranges without extraction.

A package holds stored archive members, plain WARC or one gzip stream per record, and index members of CDXJ lines. ``Package`` needs nothing
but a function that reads a range of bytes: it finds the end record, follows the ZIP64 locator where there is one, parses the
central directory with its ZIP64 extra fields, locates stored members behind their local headers, and reads single records at
the places the indexes name. Records without an index are found by walking a member; an index may be deflated, an archive
may not, since ranges of it could not be read.

``file_records`` reads packages in files of a shared file system, a range at a time and none as a whole. The packages written here are
rows of a table in the shared folder, a bounded number of bytes each, so writing and reading are spread over tasks.

Defined results: null html is an empty payload; of equal payloads of at least ``least_bytes`` bytes the record with the smallest
``page_id`` is the response and the others revisit it, shorter ones are all responses; a null url is an empty target; rows that share a
``page_id`` are records of their own (the response is named by its id); an empty table gives no packages.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import written

PACKAGE_BYTES = 8 << 20
MEMBER_BYTES = 2 << 20
INDEX, ARCHIVE = "indexes/index.cdxj", "archive/"
STEP = 1 << 16  # bytes read at once where a length is not known
# Fixed values of the format
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = "2024-01-15T00:00:00Z"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    header_at: int


def zip64_extra(extra: bytes, wanted: list[bool]) -> list[int]:
    """The 8-byte values of the ZIP64 extra field, for the fields that are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            body = extra[at + 4 : at + 4 + size]
            if len(body) < 8 * sum(wanted):
                raise ValueError("ZIP64 field is too short")
            return [int.from_bytes(body[8 * i : 8 * i + 8], "little") for i in range(sum(wanted))]
        at += 4 + size
    raise ValueError("ZIP64 field is missing")


class Package:
    """A ZIP package behind ``read(offset, length)`` and its number of bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail_size = min(self.size, 22 + FULL16)
        tail = self.read(self.size - tail_size, tail_size)
        at = tail.rfind(END)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, begin = struct.unpack("<HII", tail[at + 10 : at + 20])
        if FULL16 == count or FULL32 in (size, begin):
            locator = self.read(self.size - tail_size + at - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            record = self.read(int.from_bytes(locator[8:16], "little"), 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, size, begin = struct.unpack("<QQQ", record[32:56])
        raw, at = self.read(begin, size), 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            crc, stored, full, names, extras, notes = struct.unpack("<IIIHHH", raw[at + 16 : at + 34])
            header = int.from_bytes(raw[at + 42 : at + 46], "little")
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + names : at + 46 + names + extras]
            wanted = [full == FULL32, stored == FULL32, header == FULL32]
            if any(wanted):
                values = iter(zip64_extra(extra, wanted))
                full, stored, header = [next(values) if w else v for w, v in zip(wanted, (full, stored, header), strict=True)]
            yield Member(name, method, crc, stored, full, header)
            at += 46 + names + extras + notes

    def data_at(self, member: Member, deflated: bool = False) -> int:
        """Offset of a stored member's first byte (or of a deflated one's)."""
        if member.method and not deflated:
            raise ValueError(f"{member.name} is not stored")
        head = self.read(member.header_at, 30)
        if head[:4] != LOCAL:
            raise ValueError("no local header")
        return member.header_at + 30 + sum(struct.unpack("<HH", head[26:30]))

    def range(self, name: str, offset: int, length: int) -> bytes:
        member = self.members[name]
        if offset < 0 or offset + length > member.size:
            raise ValueError("range is outside the member")
        return self.read(self.data_at(member) + offset, length)

    def whole(self, name: str) -> bytes:
        """A small member, stored or deflated, checked against its checksum."""
        member = self.members[name]
        if member.method == 8:
            raw = zlib.decompress(self.read(self.data_at(member, deflated=True), member.stored), -15)
        else:
            raw = self.range(name, 0, member.size)
        if zlib.crc32(raw) != member.crc:
            raise ValueError(f"{name} is damaged")
        return raw

    def index(self) -> list[tuple[str, int, int]]:
        """Member, offset and length of every record the indexes name: lines of a key, a time, and a JSON object."""
        places = []
        for name in self.members:
            if name.startswith("indexes/") and name.endswith((".cdxj", ".cdxj.gz")):
                raw = self.whole(name)
                text = (inflated(raw) if name.endswith(".gz") else raw).decode()
                for line in text.splitlines():
                    if "{" in line and not line.startswith("!"):
                        entry = json.loads(line[line.index("{") :])
                        places.append((self._archive(entry["filename"]), int(entry["offset"]), int(entry["length"])))
        return places

    def _archive(self, name: str) -> str:
        return name if name in self.members else ARCHIVE + name

    def walk(self) -> Iterator[tuple[str, int, int]]:
        """The same by reading the heads of all records in all archive members."""
        for name, member in self.members.items():
            at = 0
            while name.endswith(".warc.gz") and at < member.size:
                length = self._stream_length(name, at)
                yield name, at, length
                at += length
            while name.endswith(".warc") and at < member.size:
                head = self.range(name, at, min(member.size - at, STEP))
                end = head.find(b"\r\n\r\n")
                if end < 0:
                    raise ValueError("record without a head")
                length = end + 4 + int(head_fields(head[:end])["content-length"]) + 4
                yield name, at, length
                at += length

    def _stream_length(self, name: str, begin: int) -> int:
        """Bytes of the gzip stream that begins at this place of a member."""
        stream, at, size = zlib.decompressobj(31), begin, self.members[name].size
        while not stream.eof:
            if at >= size:
                raise ValueError("a compressed record has no end")
            part = self.range(name, at, min(STEP, size - at))
            stream.decompress(part)
            at += len(part)
        return at - len(stream.unused_data) - begin

    def records(self) -> Iterator[Record]:
        for name, offset, length in self.index() or self.walk():
            raw = self.range(name, offset, length)
            yield read_record(inflated(raw) if name.endswith(".gz") else raw)


def inflated(raw: bytes) -> bytes:
    """The content of one or more gzip streams."""
    out = []
    while raw:
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(raw))
        if not stream.eof:
            raise ValueError("a compressed record has no end")
        raw = stream.unused_data
    return b"".join(out)


def gzipped(raw: bytes) -> bytes:
    stream = zlib.compressobj(6, zlib.DEFLATED, 31)
    return stream.compress(raw) + stream.flush()


def index_line(url: str, name: str, offset: int, length: int) -> str:
    """A CDXJ line; its key is the address, its time that of all records here."""
    key = url.partition("://")[2].lower() or "-"
    return f"{key} {DATE.translate({ord(c): None for c in '-:TZ'})} {json.dumps({'url': url, 'filename': name, 'offset': str(offset), 'length': str(length)})}"


def build_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of stored members; ``zip64`` writes the large forms even where small ones would do."""
    out, directory, at = [], [], 0
    for name, data in members:
        raw, crc, big = name.encode(), zlib.crc32(data), zip64 or len(data) >= FULL32 or at >= FULL32
        size = FULL32 if big else len(data)
        local_extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        version = 45 if big else 20
        local = LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(local_extra)) + raw + local_extra
        directory.append(
            CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if big else at) + raw + extra
        )
        out += [local, data]
        at += len(local) + len(data)
    central = b"".join(directory)
    big = zip64 or at + len(central) >= FULL32 or len(members) >= FULL16
    if big:
        out64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
        locator = LOCATOR64 + struct.pack("<IQI", 0, at + len(central), 1)
        end = END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 0)
        return b"".join([*out, central, out64, locator, end])
    return b"".join([*out, central, END + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(central), at, 0)])


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def read_record(raw: bytes) -> Record:
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no record at this place")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = head_fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return Record(fields, head_fields(http), payload)


def urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def url_field(url: str | None) -> str:
    return "".join(c if c > " " else "%{:02X}".format(ord(c)) for c in url or "")


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url_field(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields.insert(6, f"WARC-Refers-To: {urn(refers_to)}\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id, url, html, digest, refers_to``. The first of equal payloads is found by digest alone, summed per task before the
    exchange, and only digests that occur twice meet the pages again."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha2(raw, 256).alias("digest"), (F.octet_length(raw) >= least_bytes).alias("_long"))
    copies = rows.filter("_long").groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("digest", "_first")
    joined = rows.join(copies.withColumn("_long", F.lit(True)), ["digest", "_long"], "left")
    refers = F.when(F.col("_first") != F.coalesce("page_id", F.col("_first") - 1), F.col("_first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def packages(
    pages: DataFrame, least_bytes: int = 100, package_bytes: int = PACKAGE_BYTES, member_bytes: int = MEMBER_BYTES, zip64: bool = True, compressed: bool = True
) -> DataFrame:
    """``package, bytes``: packages of about ``package_bytes``, each written by one task; ``compressed`` members are a gzip stream per record."""
    ending = "warc.gz" if compressed else "warc"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list[tuple[str, bytes]]] = [[]]
        sizes = [0]

        def package() -> pa.RecordBatch:
            members, index = [], []
            for i, records in enumerate(done):
                name, at = f"data-{i:05d}.{ending}", 0
                for url, record in records:
                    index.append(index_line(url, name, at, len(record)))
                    at += len(record)
                members.append((ARCHIVE + name, b"".join(r for _, r in records)))
            data = build_package([*members, (INDEX, "\n".join(sorted(index)).encode())], zip64)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(data).hexdigest()[:16]}.wacz"]), pa.array([data], pa.binary())], ["package", "bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, digest, refers_to = [c[i].as_py() for c in columns]
                record = build_record(page, url, (html or "").encode(), digest, refers_to)
                record = gzipped(record) if compressed else record
                done[-1].append((url_field(url), record))
                sizes[-1] += len(record)
                if sum(sizes) >= package_bytes:
                    yield package()
                    done, sizes = [[]], [0]
                elif sizes[-1] >= member_bytes:
                    done.append([])
                    sizes.append(0)
        if done[0]:
            yield package()

    return with_revisits(pages, least_bytes).mapInArrow(pack, "package string, bytes binary")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_rows(package: Package) -> Iterator[pa.RecordBatch]:
    """The responses and revisits of a package; digests of responses are verified."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    rows = []
    for r in package.records():
        kind, digest = r.fields["warc-type"], r.fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind not in ("response", "revisit"):
            continue
        if kind == "response" and hashlib.sha256(r.payload).hexdigest() != digest:
            raise ValueError("payload and digest differ")
        size = int(r.http["content-length"])
        rows.append((page_of(r.fields["warc-record-id"]), r.fields["warc-target-uri"], size, digest, kind, page_of(r.fields.get("warc-refers-to")), r.payload if kind == "response" else None))
        if len(rows) == 512:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def records(archives: DataFrame) -> DataFrame:
    """All records of packages (``bytes``), range-read at the places their indexes name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                view = memoryview(batch.column("bytes")[i].as_buffer())
                yield from record_rows(Package(lambda at, n: bytes(view[at : at + n]), len(view)))  # noqa: B023

    return archives.select("bytes").mapInArrow(read, RECORD)


def file_records(paths: DataFrame) -> DataFrame:
    """All records of the packages that ``path`` names (plain paths or addresses that Arrow's file systems know), by ranges of the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_file(inner) as file:
                    yield from record_rows(Package(lambda at, n: file.read_at(n, at), file.size()))  # noqa: B023

    return paths.select("path").mapInArrow(read, RECORD)


def archived(pages: DataFrame, **options) -> DataFrame:
    """The packages of ``pages``, written to the shared folder."""
    return written(packages(pages, **options), "packages")
