import base64
import gzip
import hashlib
import json

from pyarrow import fs
from pyspark.sql import functions as F

from textharbor.llm import warc

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é" * 5000),
    (6, "two\r\nlines", "x\r\n\r\ny"), (7, "http://a/7", "<p>one</p>"), (7, "http://a/7", "<p>one</p>"), (None, "http://a/n", "null key"),
    (9, "http://a/9", "null key"), (0, "http://a/0", "WARC/1.1\r\n"), (11, "http://a/11", "z" * 300_000),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, archive string, digest string").repartition(3)


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(min_bytes=0):
    first = {}
    for key, _, html in ROWS:
        size = len((html or "").encode())
        if size >= min_bytes and key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out, seen = [], set()
    for key, _, html in ROWS:
        payload = (html or "").encode()
        target = first.get(html or "") if len(payload) >= min_bytes else None
        revisit = target is not None and (key != target or (key, html) in seen)
        seen.add((key, html))
        out.append((key, len(payload), sha1(html), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    for least in (0, 12):
        got = warc.warc_report(pages(spark), min_bytes=least).collect()
        assert sorted(map(tuple, got), key=repr) == wanted(least)


def test_every_record_is_a_member_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 6000)
    folder, archives = warc.write_archives(pages(spark))
    names = [r.archive for r in archives.collect()]
    files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    html = {k: h for k, _, h in ROWS}
    seen = 0
    for name in names:
        with files.open_input_file(f"{base}/{name}") as f:
            data = f.read()
        with files.open_input_file(f"{base}/{name}.idx") as f:
            entries = [json.loads(line) for line in f.read().splitlines()]
        assert sum(e["length"] for e in entries) == len(data)
        joined = b""
        for entry in entries:
            member = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            joined += member
            head, _, rest = member.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {entry['type']}".encode() in head
            if entry["type"] == "response":
                assert rest == (html[entry["page"] and int(entry["page"])] or "").encode() + b"\r\n\r\n"
            seen += 1
        assert gzip.decompress(data) == joined
    assert seen == len(ROWS) and len(names) > 1


def test_damage_is_noticed(spark, tmp_path):
    folder, archives = warc.write_archives(pages(spark, ROWS[:1]))
    name = archives.first().archive
    files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    with files.open_input_file(f"{base}/{name}") as f:
        headers, payload = warc.read_member(f, 0, f.size())
    assert payload == b"<p>one</p>" and headers["Page-ID"] == "1"
    broken = tmp_path / "broken.warc.gz"
    broken.write_bytes(gzip.compress(warc.record(headers | {"WARC-Payload-Digest": "sha1:A"}, payload)))
    with fs.LocalFileSystem().open_input_file(str(broken)) as f:
        try:
            warc.read_member(f, 0, f.size())
        except ValueError as error:
            assert "damaged" in str(error)
        else:
            raise AssertionError("damage went unnoticed")


def test_empty_table(spark):
    assert warc.warc_report(pages(spark, [])).count() == 0


def test_every_archive_has_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 800)
    rows = [(i, "http://a.example/", f"<p>{i}</p>".ljust(100, "x")) for i in range(64)]
    folder, archives = warc.write_archives(pages(spark, rows).coalesce(1))
    files = archives.select("archive", F.input_file_name().alias("file")).collect()
    assert len({r.archive for r in files}) == len({r.file for r in files}) == 8
    read = warc.read_archives(folder, archives).select("page", F.spark_partition_id().alias("task")).collect()
    assert len(read) == 64 and len({r.task for r in read}) == 8
