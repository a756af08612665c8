"""WARC archives: a monolithic gzip stream made into one member per record, with a sidecar index of offsets.

Archives that were compressed as one stream can only be read from the start. The normaliser inflates such a stream
once, writes every record as a gzip member of its own and notes offset, length and page of each in a sidecar, so any
record can be read alone. While it rewrites, records whose payload another record has become revisits.

Archives lie in the folder that all executors share; names are unique per attempt, and an archive counts once a row of
the manifest names it, so lost or repeated tasks leave at most files that nobody reads.
"""

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textharbor.llm import common
from textharbor.session import run_dir, write_and_read

#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Compression of both passes: archives are read back once or a few times.
GZIP_LEVEL = 1

_WRITTEN = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("page", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("digest", T.StringType()),
])


def digest_of(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers, payload):
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def read_record(stream):
    """Headers and payload of the next record of an inflated stream; None at its end."""
    if not stream.readline():
        return None
    headers = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(": ")
        headers[name] = value
    payload = stream.read(int(headers["Content-Length"]))
    stream.read(4)
    return headers, payload


def _headers(url, page, payload, archive, seq):
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{seq}')}>",
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "text/html",
        "Payload-Length": str(len(payload)),
    }
    return headers if page is None else headers | {"Page-ID": page}


def _open(uri):
    """The file system of a URI or path, and the path in it."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def _write_monolithic(folder):
    """Write records of a task into archives that are one gzip stream each."""

    def run(batches):
        files, base = _open(folder)
        rows, out = [], None

        def close():
            out[0].write(out[1].flush())
            out[0].close()
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))],
                names=_WRITTEN.names,
            )

        for batch in batches:
            for page, url, html in zip(*[common.as_text(c) for c in batch.columns]):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                if out is None:
                    archive, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{archive}", compression=None), zlib.compressobj(GZIP_LEVEL, wbits=31)
                headers = _headers(url.as_py(), page.as_py(), payload, archive, len(rows))
                out[0].write(out[1].compress(record(headers, payload)))
                rows.append((archive, len(rows), page.as_py(), len(payload), headers["WARC-Payload-Digest"][5:]))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    rows, out = [], None
        if out is not None:
            yield close()

    return run


def normalise(source, target, decisions):
    """Rewrite one monolithic archive: every record its own member, and a sidecar ``<target>.idx``.

    ``decisions`` gives for each record in turn whether it becomes a revisit, and of which page. Records pass one by
    one; no more than one is held.
    """
    files, path = _open(source)
    out_files, out_path = _open(target)
    with (
        files.open_input_stream(path, compression=None) as packed,
        gzip.GzipFile(fileobj=packed) as stream,
        out_files.open_output_stream(out_path, compression=None) as out,
        out_files.open_output_stream(f"{out_path}.idx", compression=None) as index,
    ):
        offset = 0
        for revisit, refers_to in decisions:
            headers, payload = read_record(stream)
            headers.pop("Content-Length")
            if revisit:
                headers |= {"WARC-Type": "revisit", "WARC-Profile": "identical-payload-digest"}
                if refers_to is not None:
                    headers["Refers-To-Page-ID"] = refers_to
                payload = b""
            packer = zlib.compressobj(GZIP_LEVEL, wbits=31)
            member = packer.compress(record(headers, payload)) + packer.flush()
            out.write(member)
            entry = {"offset": offset, "length": len(member), "page": headers.get("Page-ID"), "type": headers["WARC-Type"]}
            index.write(json.dumps(entry).encode() + b"\n")
            offset += len(member)
        if read_record(stream) is not None:
            raise ValueError(f"{source} has more records than its manifest")


def read_member(file, offset, length):
    """Headers and payload of the record at an offset; the payload must have the digest the headers name."""
    file.seek(offset)
    with gzip.GzipFile(fileobj=pa.BufferReader(file.read(length))) as stream:
        headers, payload = read_record(stream)
    if headers["WARC-Type"] == "response" and f"sha1:{digest_of(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record at {offset}")
    return headers, payload


def _normalise_all(source, target):
    """Rows (archive, seq, revisit, refers_to) sorted by archive and seq to rows (archive): those written."""

    def run(batches):
        archive, decisions = None, []
        for batch in batches:
            for name, revisit, refers_to in zip(*[batch.column(c).to_pylist() for c in ("archive", "revisit", "refers_to")]):
                if name != archive:
                    if archive is not None:
                        yield finish(archive, decisions)
                    archive, decisions = name, []
                decisions.append((revisit, refers_to))
        if archive is not None:
            yield finish(archive, decisions)

    def finish(archive, decisions):
        written = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
        normalise(f"{source}/{archive}", f"{target}/{written}", decisions)
        return pa.RecordBatch.from_arrays([pa.array([written])], names=["archive"])

    return run


_READ = T.StructType([
    T.StructField("page", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.StringType()),
])


def _read_all(folder):
    """All records of archives (archive), each read alone by its entry in the sidecar."""

    def rows_of(files, path):
        with files.open_input_stream(f"{path}.idx", compression=None) as index:
            entries = [json.loads(line) for line in index.read().splitlines()]
        with files.open_input_file(path) as file:
            for entry in entries:
                headers, _ = read_member(file, entry["offset"], entry["length"])
                yield (
                    headers.get("Page-ID"), int(headers["Payload-Length"]), headers["WARC-Payload-Digest"][5:],
                    headers["WARC-Type"], headers.get("Refers-To-Page-ID"),
                )

    def run(batches):
        files, base = _open(folder)
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                columns = list(zip(*rows_of(files, f"{base}/{archive}")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=_READ.names)

    return run


def _dealt(rows, archives):
    """Rows dealt by archive, so that about every archive has a task of its own.

    A row is a few bytes but stands for a part of an archive, so the number of tasks follows that of archives, whatever
    the size of the rows; twice as many ranges leave few archives together.
    """
    return rows.repartitionByRange(max(1, 2 * archives), "archive")


def write_archives(df, key="page_id", url="url", html="html", min_bytes=0):
    """Write a WARC record for every row; returns the folder and a table (archive) of what was written.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest key (null keys last; of
    repeated rows any one) is a response and the others are revisits of it; smaller ones are all responses. A null html
    is an empty payload, a null url an empty one. Extra columns are not looked at. An empty table writes nothing.
    """
    spark = df.sparkSession
    folder = run_dir(spark, "warc")
    for part in ("monolithic", "records"):
        files, path = _open(f"{folder}/{part}")
        files.create_dir(path)
    pages = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((key, "page"), (url, "url"), (html, "html"))])
    written = write_and_read(pages.mapInArrow(_write_monolithic(f"{folder}/monolithic"), _WRITTEN), "warc-manifest")

    typed = F.col("page").cast(df.schema[key].dataType)
    smallest = F.min(F.struct(F.col("page").isNull().alias("none"), typed.alias("key"), "page", "archive", "seq"))
    copies = written.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(
        smallest.alias("first"), F.count(F.lit(1)).alias("times")
    )
    firsts = copies.filter("times > 1").select("digest", F.col("first.page").alias("refers_to"), "first.archive", "first.seq")
    joined = written.alias("w").join(
        firsts.alias("f"), (F.col("w.digest") == F.col("f.digest")) & (F.col("w.payload_bytes") >= min_bytes), "left"
    )
    same = (F.col("w.archive") == F.col("f.archive")) & (F.col("w.seq") == F.col("f.seq"))
    revisit = F.col("f.digest").isNotNull() & ~F.coalesce(same, F.lit(False))
    decided = joined.select(
        "w.archive", "w.seq", revisit.alias("revisit"), F.when(revisit, F.col("f.refers_to")).alias("refers_to")
    )
    in_turn = _dealt(decided, written.select("archive").distinct().count()).sortWithinPartitions("archive", "seq")
    schema = T.StructType([T.StructField("archive", T.StringType())])
    names = in_turn.mapInArrow(_normalise_all(f"{folder}/monolithic", f"{folder}/records"), schema)
    archives = write_and_read(names, "warc-archives")
    files, path = _open(f"{folder}/monolithic")
    files.delete_dir(path)
    return f"{folder}/records", archives


def read_archives(folder, archives):
    """Rows (page, payload_bytes, payload_digest, record_type, refers_to) of all records."""
    return _dealt(archives, archives.count()).mapInArrow(_read_all(folder), _READ)


def warc_report(df, key="page_id", **options):
    kind = df.schema[key].dataType
    rows = read_archives(*write_archives(df, key, **options))
    return rows.select(
        F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
