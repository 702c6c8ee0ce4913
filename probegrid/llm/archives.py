"""Web archives: writing legacy ARC files, converting them to WARC, reading WARC back.

The converter reads the version block of an ARC file, then record after record:
a header line whose fields depend on the version (5 in version 1, 10 in
version 2) and as many bytes of content as it declares. From these it makes the
WARC fields that ARC lacks: an identifier derived from the record, an ISO
timestamp from the 14 digits, the record type, and SHA-1 digests of block and
payload. Records with equal payloads become revisits of the one with the
smallest page id.

Scale: archives are rolled at ``roll_bytes`` and each is read and written by one
task, one record in memory at a time. Tasks write under a name of their own and
rename, so a task that runs again replaces its file. Payloads are never
shuffled: the choice between response and revisit is made on digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probegrid.llm.common import stored
from probegrid.session import work_folder

ROLL_BYTES = 64 << 20
# fixed values of the two formats
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"],
}
ARC_FIELD_LINE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member: archives hold one per record."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# --- ARC -------------------------------------------------------------------------

def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 probegrid\n{ARC_FIELD_LINE[version]}\n\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, content: bytes, name: str, offset: int, kind: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} {ip} {date} {kind}{middle} {len(content)}\n".encode() + content + b"\n"


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of all records of an ARC file but its version block."""
    first = stream.readline().split()
    block = stream.read(int(first[-1]))
    version = int(block.split(None, 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"ARC version {version} is not known")
    names = ARC_FIELDS[version]
    while line := stream.readline():
        if not line.strip():
            continue
        # a content type may hold blanks: the fields before and after it do not
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        extra = len(parts) - len(names)
        if extra < 0:
            raise ValueError(f"ARC header line with {len(parts)} fields, version {version} has {len(names)}")
        parts[3:4 + extra] = [" ".join(parts[3:4 + extra])]
        head = dict(zip(names, parts, strict=True))
        content = stream.read(int(head["length"]))
        if len(content) != int(head["length"]):
            raise ValueError(f"ARC record of {head['url']} ends early")
        yield head, content


def split_http(content: bytes) -> tuple[bytes | None, bytes]:
    """(status line and headers with the blank line, payload); no headers if the content is not a response."""
    if not content.startswith(b"HTTP/"):
        return None, content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[:end + 4], content[end + 4:])


def http_field(head: bytes | None, name: bytes) -> str | None:
    for line in (head or b"").split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip().decode("latin-1")
    return None


# --- WARC ------------------------------------------------------------------------

def warc_date(date: str) -> str:
    """ISO form of an ARC date; short dates are filled up."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str | None, digest: str, place: str) -> str:
    """An identifier that a second conversion of the same archive gives again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join([url, date, page or '', digest, place]))}>"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


# --- Spark jobs ------------------------------------------------------------------

def _open(uri: str) -> gzip.GzipFile:
    where, path = fs.FileSystem.from_uri(uri)
    return gzip.GzipFile(fileobj=io.BufferedReader(where.open_input_stream(path, compression=None), 1 << 20))


class _Rolling:
    """Writes members into files of about ``roll`` bytes; a file appears under its name when it is complete."""

    def __init__(self, folder: str, stem: str, suffix: str, roll: int, start):
        self.where, self.folder = fs.FileSystem.from_uri(folder)
        self.where.create_dir(self.folder, recursive=True)
        self.folder_uri, self.stem, self.suffix, self.roll, self.start = folder, stem, suffix, roll, start
        self.out, self.count, self.done = None, 0, []

    def name(self) -> str:
        return f"{self.stem}-{len(self.done):05d}{self.suffix}"

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.attempt = f"{self.folder}/.{uuid.uuid4().hex}"
            self.out, self.at, self.count = self.where.open_output_stream(self.attempt, compression=None), 0, 0
            if (head := self.start(self.name())):
                self._put(head)
        self._put(data)
        self.count += 1
        if self.at >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.where.move(self.attempt, f"{self.folder}/{self.name()}")
            self.done.append((f"{self.folder_uri}/{self.name()}", self.count))
            self.out = None


def _listing(done: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])


def _spread(files: DataFrame) -> DataFrame:
    """One task per archive, as far as that is sensible."""
    return files.repartition(min(10_000, max(1, files.count())), "path")


def write_arc(pages: DataFrame, folder: str, version: int = 1, date: str = "20240101000000", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as ARC files; ``path, records`` of each. A null html is an empty payload."""
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Rolling(folder, f"part-{TaskContext.get().partitionId():06d}", ".arc.gz", roll_bytes, lambda name: arc_version_block(version, name, date))
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += f"Content-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
                target = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page}"
                files.add(arc_record(version, target, date, head.encode() + payload, files.name(), getattr(files, "at", 0) or 0))
        files.close()
        yield _listing(files.done)

    return stored(plain.mapInArrow(write, "path string, records long"), "arc-files")


def arc_index(files: DataFrame) -> DataFrame:
    """A row per ARC record: ``path, seq, page_id, url, date, payload_bytes, payload_digest, record_id``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as stream:
                    for seq, (head, content) in enumerate(arc_records(stream)):
                        http, payload = split_http(content)
                        page, digest = http_field(http, b"x-page-id"), sha1_base32(payload)
                        place = f"{path.rsplit('/', 1)[-1]}#{seq}"
                        rows.append({"path": path, "seq": seq, "page_id": None if page is None else int(page), "url": head["url"], "date": warc_date(head["date"]),
                                     "payload_bytes": len(payload), "payload_digest": digest, "record_id": record_id(head["url"], head["date"], page, digest, place)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())])
    return _spread(files).select("path").mapInArrow(
        read, "path string, seq long, page_id long, url string, date string, payload_bytes long, payload_digest string, record_id string")


def convert(files: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Convert ARC files to WARC files in ``folder``; ``path, records`` of each.

    Of records with equal payloads of at least ``min_bytes``, the one with the
    smallest (page id, file, place) is a response and the others revisit it; records
    without page id come last. Content that is no HTTP response becomes a resource.
    """
    index = stored(arc_index(files), "arc-index")
    firsts = index.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_n")).agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "seq", "record_id", "url", "date")).alias("first"))
    again = index.join(firsts, (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_n"))).where("record_id != first.record_id")
    # a list per archive, which roll_bytes bounds
    by_file = again.groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct(
        "seq", F.col("first.record_id").alias("id"), F.col("first.page_id").alias("page"), F.col("first.url").alias("url"), F.col("first.date").alias("date"))).alias("again"))
    todo = files.select("path").join(by_file, F.col("path") == F.col("_path"), "left").select("path", F.to_json("again").alias("again"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for path, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                revisits = {r["seq"]: r for r in json.loads(listed or "[]")}
                source = path.rsplit("/", 1)[-1]
                info = f"software: probegrid\r\nformat: WARC File Format 1.0\r\nconverted-from: {source}\r\n".encode()

                def start(name: str, source: str = source, info: bytes = info) -> bytes:
                    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", "", None, "", name)),
                                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)

                files_out = _Rolling(folder, source.removesuffix(".gz").removesuffix(".arc"), ".warc.gz", roll_bytes, start)
                with _open(path) as stream:
                    for seq, (head, content) in enumerate(arc_records(stream)):
                        http, payload = split_http(content)
                        digest, first = sha1_base32(payload), revisits.get(seq)
                        fields = [
                            ("WARC-Type", "revisit" if first else "response" if http is not None else "resource"), ("WARC-Target-URI", head["url"]), ("WARC-Date", warc_date(head["date"])),
                            ("WARC-Record-ID", record_id(head["url"], head["date"], http_field(http, b"x-page-id"), digest, f"{source}#{seq}")),
                            ("WARC-IP-Address", head["ip"]), ("WARC-Payload-Digest", f"sha1:{digest}"),
                            ("Content-Type", "application/http; msgtype=response" if http is not None else head["content_type"]),
                        ]
                        if first:
                            fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", first["id"]), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]),
                                       ("WARC-Truncated", "length"), ("X-Payload-Length", str(len(payload)))]
                            if first.get("page") is not None:
                                fields.append(("X-Refers-To-Page-Id", str(first["page"])))
                        files_out.add(warc_record(fields, (http or b"") if first else content))
                files_out.close()
                yield _listing(files_out.done)

    return stored(_spread(todo).mapInArrow(write, "path string, records long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """A row per page record of the WARC files: ``page_id, url, date, record_id, record_type, payload_bytes, payload_digest, refers_to``.

    Digests and lengths of stored payloads are computed from what is read, and must
    agree with the declared ones; those of revisits are the declared ones.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with _open(path) as stream:
                    for fields, block in warc_records(stream):
                        kind = fields["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        http, payload = split_http(block)
                        digest, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields.get("x-payload-length", len(payload)))
                        if kind != "revisit" and sha1_base32(payload) != digest:
                            raise ValueError(f"payload digest of {fields['warc-record-id']} does not agree")
                        page, first = http_field(http, b"x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append({"page_id": None if page is None else int(page), "url": fields["warc-target-uri"], "date": fields["warc-date"], "record_id": fields["warc-record-id"],
                                     "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_to": None if first is None else int(first)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    return _spread(files).select("path").mapInArrow(
        read, "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive_pages(pages: DataFrame, version: int = 1, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Pages through ARC and WARC and back: see ``read_warc``. An empty table gives no rows."""
    folder = work_folder(pages.sparkSession, "archives")
    arc = write_arc(pages, f"{folder}/arc", version, roll_bytes=roll_bytes)
    return read_warc(convert(arc, f"{folder}/warc", min_bytes, roll_bytes))
