"""WARC records in ZIP archives: writing, and reading by byte ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (each record a gzip member of its own), ``indexes/index.cdxj`` (a
line per record with its offset and length) and ``datapackage.json``. A reader takes the end of the file, parses the central
directory (ZIP64 fields included), finds the members' bytes, reads the index, and then fetches single records by
range: nothing is extracted and no archive is read whole. Archives of other writers may hold several data members, several
indexes, gzipped indexes, and members of any other kind, compressed or not, which are passed over.

Tasks stream records into archives of about ``ARCHIVE_BYTES`` in the shared folder. Each attempt of a task uses file
names of its own, and only the attempt that Spark accepts gets into the manifest, so lost executors leave no half archives behind in
it.

Defined results: null html is the empty payload; among equal payloads of at least ``LEAST`` bytes the record with the largest page_id is the
response and null ids are smaller than all others; rows that share that id (or a null id, if there is no other) are all responses;
a null url becomes an empty one; an empty table gives no archive and an empty result; other columns are never looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import closing
from typing import BinaryIO
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.session import materialize, scratch_path

ARCHIVE_BYTES = 64 << 20
ARCHIVES = 16                     # archives whose indexes one task reads
READ_BYTES = 16 << 20             # bytes of records that one task fetches
LEAST = 1000                      # payloads of fewer bytes are never revisits
DATE = "1970-01-01T00:00:00Z"     # the tables have no time of capture
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
LEVEL = 6
# Where archives can be: Spark's scheme, and its name here.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


# --- files -------------------------------------------------------------------------------------


def store_uri(uri: str) -> str:
    """The URI as the tasks' file system names it: Hadoop's names of object stores are changed, unknown schemes refused."""
    scheme, colon, rest = uri.partition("://")
    if not colon:
        scheme = "file"  # a plain path, or file:/path
    if scheme not in SCHEMES:
        raise ValueError(f"archives can't be in {scheme}://, only in {', '.join(SCHEMES)}")
    return SCHEMES[scheme] + colon + rest if colon else uri


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = store_uri(uri)
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path if parsed.scheme else uri
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    store, path = _place(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


class Ranges:
    """Reads byte ranges of one file."""

    def __init__(self, uri: str) -> None:
        store, path = _place(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError(f"bytes {start} to {start + length} of a file of {self.size}")
        return self.file.read_at(length, start)

    def close(self) -> None:
        self.file.close()


# --- ZIP directories ---------------------------------------------------------------------------

# The layout of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
COMMENT, FULL16, FULL32, EXTRA64, STORED = 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0x0001, 0


def directory(ranges: Ranges, wanted: Callable[[str], bool] = lambda name: True) -> dict[str, tuple[int, int]]:
    """(first byte, bytes) of each wanted member. Fails if one of these is compressed, or the directory is broken."""
    tail_at = max(0, ranges.size - END_SIZE - COMMENT)
    tail = ranges.read(tail_at, ranges.size - tail_at)
    at = tail.rfind(END, 0, max(0, len(tail) - END_SIZE + len(END)))
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if entries == FULL16 or length == FULL32 or start == FULL32:
        mark, _, end64, _ = struct.unpack("<4sIQI", ranges.read(tail_at + at - LOCATOR_SIZE, LOCATOR_SIZE))
        if mark != LOCATOR:
            raise ValueError("no ZIP64 locator")
        record = ranges.read(end64, END64_SIZE)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    data, place, members = ranges.read(start, length), 0, {}
    for _ in range(entries):
        if data[place : place + 4] != CENTRAL:
            raise ValueError("no central directory entry")
        method, = struct.unpack_from("<H", data, place + 10)
        packed, size, name_size, extra_size, comment_size = struct.unpack_from("<IIHHH", data, place + 20)
        header, = struct.unpack_from("<I", data, place + 42)
        name_at = place + CENTRAL_SIZE
        name = data[name_at : name_at + name_size].decode("utf-8")
        extra = data[name_at + name_size : name_at + name_size + extra_size]
        size, packed, header = _wide(extra, size, packed, header)
        place = name_at + name_size + extra_size + comment_size
        if not wanted(name):
            continue
        if method != STORED or packed != size:
            raise ValueError(f"member {name} isn't stored")
        local = ranges.read(header, LOCAL_SIZE)
        if local[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        own_name, own_extra = struct.unpack_from("<HH", local, 26)
        members[name] = (header + LOCAL_SIZE + own_name + own_extra, size)
    return members


def _wide(extra: bytes, *fields: int) -> list[int]:
    """Replaces fields that hold all ones by the next value of the ZIP64 extra field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == EXTRA64:
            wide = extra[at + 4 : at + 4 + size]
        at += 4 + size
    found, used = [], 0
    for value in fields:
        if value == FULL32:
            value, = struct.unpack_from("<Q", wide, used)
            used += 8
        found.append(value)
    return found


# --- records -----------------------------------------------------------------------------------


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC record as one gzip member; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == REVISIT else http + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    if kind == REVISIT:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """page_id, url, kind, refers_to, payload (None in a revisit), payload_bytes and payload_digest of a record."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == RESPONSE and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == REVISIT else None,
        "payload": body if kind == RESPONSE else None, "payload_bytes": size, "payload_digest": digest,
    }


def is_data(name: str) -> bool:
    return name.startswith("archive/") and name.endswith(".warc.gz")


def is_index(name: str) -> bool:
    return name.startswith("indexes/") and name.removesuffix(".gz").endswith((".cdxj", ".cdx"))


def entries(ranges: Ranges) -> Iterator[tuple[int, int]]:
    """(first byte, bytes) of each record that the indexes of an archive name, each place once.

    An entry names its data member by the last part of its path; without a name it is in the only one. Lines that aren't entries
    (headers, comments) are passed over.
    """
    members = directory(ranges, lambda name: is_data(name) or is_index(name))
    data = {name.rpartition("/")[2]: place for name, place in members.items() if is_data(name)}
    seen = set()
    for name in sorted(filter(is_index, members)):
        text = ranges.read(*members[name])
        for line in (gzip.decompress(text) if name.endswith(".gz") else text).decode().splitlines():
            _, brace, rest = line.partition("{")
            if line.startswith("!") or not brace:
                continue
            entry = json.loads(brace + rest)
            if "offset" not in entry:
                continue
            named = entry.get("filename", "").rpartition("/")[2] or (next(iter(data)) if len(data) == 1 else "")
            if named not in data:
                raise ValueError(f"{name} names {named or 'no member'}, which the archive lacks")
            first, size = data[named]
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset < 0 or length < 0 or offset + length > size:
                raise ValueError(f"{name} names bytes beyond {named}")
            if (first + offset, length) not in seen:
                seen.add((first + offset, length))
                yield first + offset, length


class ArchiveWriter:
    """Streams records into one archive."""

    def __init__(self, uri: str) -> None:
        self.uri, self.file = uri, create(uri)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.index = 0, io.StringIO()
        self.records = 0

    def add(self, page_id: int | None, member: bytes) -> None:
        self.data.write(member)
        entry = {"filename": DATA.rpartition("/")[2], "offset": self.size, "length": len(member)}
        self.index.write(f"{_urn(page_id)} {DATE} {json.dumps(entry)}\n")
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        described = {"profile": "data-package", "resources": [{"path": DATA, "bytes": self.size}, {"path": INDEX}]}
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps(described))
        self.zip.close()
        self.file.close()
        return self.uri, self.size, self.records


# --- Spark jobs --------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest: archive, data_bytes, records."""
    store_uri(folder)  # refused here, before any work
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("same"),
    )
    # Only payloads that occur twice have an entry, a long and a hash each; texts are shuffled once, to meet them.
    groups = rows.where(F.length("payload") >= LEAST).groupBy("same").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("number")
    ).where("number > 1").select("same", "response")
    decided = rows.join(groups, "same", "left").select(
        "page_id", "url", "payload", F.when(F.col("response") != F.coalesce("page_id", F.col("response") - 1), F.col("response")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, body, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                kind = RESPONSE if refers_to is None else REVISIT
                writer.add(page_id, record(page_id, url, body, hashlib.sha1(body).digest(), kind, refers_to))
                if writer.size >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["archive", "data_bytes", "records"],
        )

    return materialize(decided.mapInArrow(run, "archive string, data_bytes long, records long"), "manifest")


def read_index(archives: DataFrame, tasks: int | None = None) -> DataFrame:
    """archive, start, length of every record of the archives named in column archive, from their directories and indexes.

    ``tasks`` defaults to one per ``ARCHIVES`` archives. The number is fixed, since adaptive execution would go by the bytes of
    the names and not by the work on the archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with closing(Ranges(archive)) as ranges:
                    places = list(entries(ranges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([archive] * len(places), pa.string()),
                        pa.array([start for start, _ in places], pa.int64()),
                        pa.array([length for _, length in places], pa.int64()),
                    ],
                    names=["archive", "start", "length"],
                )

    tasks = tasks or -(-archives.count() // ARCHIVES) or 1
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, "archive string, start long, length long")


def read_records(index: DataFrame, payload: bool = True, tasks: int | None = None) -> DataFrame:
    """The records at the places in ``index``, each fetched by its range; ``payload`` is null in revisits.

    ``tasks`` defaults to one per ``READ_BYTES`` of records, again a fixed number.
    """
    tasks = tasks or -(-index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // READ_BYTES) or 1
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" * payload
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now, ranges = None, None
        for batch in batches:
            found, held = [], 0
            for archive, start, length in zip(*[c.to_pylist() for c in batch.columns]):
                if archive != open_now:
                    if ranges is not None:
                        ranges.close()
                    open_now, ranges = archive, Ranges(archive)
                found.append(parse(ranges.read(start, length)))
                held += found[-1]["payload_bytes"] if payload else 0
                if not payload:
                    found[-1].pop("payload")
                if held > ARCHIVE_BYTES:
                    yield _batch(found, names, schema)
                    found, held = [], 0
            yield _batch(found, names, schema)
        if ranges is not None:
            ranges.close()

    # By range of place, so that one archive's records are read in order and a large archive by several tasks.
    return index.repartitionByRange(tasks, "archive", "start").sortWithinPartitions("archive", "start").mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)


def round_trip(pages: DataFrame, payload: bool = False) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back, record by record."""
    spark: SparkSession = pages.sparkSession
    manifest = write_archives(pages, scratch_path(spark, "archives"))
    size = manifest.agg(F.coalesce(F.sum("data_bytes"), F.lit(0))).first()[0]
    return read_records(read_index(manifest), payload, -(-size // READ_BYTES) or 1)
