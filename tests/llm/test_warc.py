import gzip
import hashlib
import json
import zipfile

import pytest

from trajspark.llm import warc
from trajspark.session import scratch_path

SCHEMA = "page_id long, url string, html string, payload string"


def brute(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        again = len(body) >= warc.LEAST and known and page_id != max(known)
        kind, of = ("revisit", max(known)) if again else ("response", None)
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), kind, of))
    return sorted(out, key=repr)


def test_odd_pages_come_back(spark):
    rows = [(1, "http://a", "x" * 1000), (2, "http://b?q=é \n", "x" * 1000), (3, None, "x" * 999), (4, "http://c", "x" * 999), (5, "u", None),
            (6, "u", ""), (None, "u", "x" * 1000), (None, None, "y" * 2000), (None, "v", "y" * 2000), (7, "u", "é漢🙂\r\n\r\n\x00" * 300),
            (7, "u", "z" * 1500), (7, "u", "z" * 1500), (8, "u", "w" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)
    found = warc.round_trip(pages, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == brute(rows)
    bodies = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert bodies[8] == b"w" * 3_000_000 and bodies[5] == b""
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_small_archives_are_rotated_and_readable_by_others(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " * 2000, "") for i in range(40)], SCHEMA)
    manifest = warc.write_archives(pages, scratch_path(spark, "small"), archive_bytes=1000).collect()
    assert len(manifest) > 4 and sum(r.records for r in manifest) == 40
    for r in manifest:
        with zipfile.ZipFile(r.archive.removeprefix("file://").removeprefix("file:")) as archive:
            assert archive.testzip() is None and archive.namelist() == [warc.DATA, warc.INDEX, warc.PACKAGE]
            assert gzip.decompress(archive.read(warc.DATA)).count(b"WARC/1.1\r\n") == r.records


def test_zip64_directories(tmp_path, monkeypatch):
    path = str(tmp_path / "many.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        for i in range(66_000):  # more than a plain directory can count
            archive.writestr(zipfile.ZipInfo(f"m{i}"), str(i))
        archive.comment = b"PK\x05\x06 in a comment"
    ranges = warc.Ranges(path)
    members = warc.directory(ranges)
    assert len(members) == 66_000 and all(ranges.read(*members[f"m{i}"]) == str(i).encode() for i in (0, 7, 65_999))

    large = str(tmp_path / "large.zip")
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)  # sizes and offsets beyond 100 go to the extra field
    with zipfile.ZipFile(large, "w", zipfile.ZIP_STORED) as archive:
        for k in range(3):
            archive.writestr(zipfile.ZipInfo(f"big{k}"), bytes([65 + k]) * 500)
    ranges = warc.Ranges(large)
    assert [ranges.read(*warc.directory(ranges)[f"big{k}"]) for k in range(3)] == [bytes([65 + k]) * 500 for k in range(3)]


def test_damage_is_noticed(tmp_path):
    packed = str(tmp_path / "packed.zip")
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m", "a" * 1000)
    with pytest.raises(ValueError, match="stored"):
        warc.directory(warc.Ranges(packed))
    short = str(tmp_path / "short.zip")
    with open(short, "wb") as file:
        file.write(open(packed, "rb").read()[:-5])
    with pytest.raises(ValueError, match="end of central directory"):
        warc.directory(warc.Ranges(short))
    member = warc.record(1, "u", b"body", hashlib.sha1(b"other").digest(), "response", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(member)


def test_archives_of_other_writers(spark, tmp_path):
    """Two data members, a plain and a gzipped index, a compressed page list, numbers as text, repeated entries."""
    records = [warc.record(i, f"http://h/{i}", f"body {i}".encode(), hashlib.sha1(f"body {i}".encode()).digest(), "response", None) for i in range(6)]
    lines = {"a.warc.gz": [], "b.warc.gz": []}
    data = {name: b"" for name in lines}
    for i, member in enumerate(records):
        name = "a.warc.gz" if i < 4 else "b.warc.gz"
        entry = {"url": f"http://h/{i}", "offset": str(len(data[name])), "length": str(len(member)), "filename": f"archive/{name}" if i % 2 else name}
        lines[name].append(f"h)/{i} 20200101 {json.dumps(entry)}")
        data[name] += member
    path = str(tmp_path / "other.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("pages/pages.jsonl", "x" * 5000, compress_type=zipfile.ZIP_DEFLATED)
        for name, body in data.items():
            archive.writestr(f"archive/{name}", body)
        archive.writestr("indexes/a.cdxj", "\n".join(["!meta {}", *lines["a.warc.gz"], lines["a.warc.gz"][0]]))
        archive.writestr("indexes/b.cdxj.gz", gzip.compress("\n".join(lines["b.warc.gz"]).encode()))
    archives = spark.createDataFrame([(path,)], "archive string")
    found = warc.read_records(warc.read_index(archives)).collect()
    assert sorted((r.page_id, r.payload) for r in found) == [(i, f"body {i}".encode()) for i in range(6)]

    wrong = str(tmp_path / "wrong.wacz")
    with zipfile.ZipFile(wrong, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("archive/a.warc.gz", data["a.warc.gz"])
        archive.writestr("indexes/a.cdxj", lines["b.warc.gz"][0])
    with pytest.raises(ValueError, match="lacks"):
        list(warc.entries(warc.Ranges(wrong)))


def test_schemes_are_known_before_any_work(spark):
    assert warc.store_uri("s3a://bucket/a") == "s3://bucket/a" and warc.store_uri("hdfs://n:1/a") == "hdfs://n:1/a"
    assert warc.store_uri("/a b") == "/a b" and warc.store_uri("file:/a") == "file:/a" and warc.store_uri("file:///a") == "file:///a"
    with pytest.raises(ValueError, match="wasbs"):
        warc.write_archives(spark.createDataFrame([], SCHEMA), "wasbs://c@a/b")
