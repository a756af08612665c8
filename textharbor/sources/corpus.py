"""Documents from text files or from rows of a table."""

import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from textharbor.functions import cleaning
from textharbor.functions.batches import slices
from textharbor.functions.text import content_hash
from textharbor.schema import DOCUMENT_COLUMNS
from textharbor.session import GATHER_BYTES, gathered

_FILES = "path string, modificationTime timestamp, length bigint, content binary"

#: Files that are listed as one row and read as one batch; a file beyond the bytes comes alone.
LIST_FILES = 64
LIST_BYTES = 4 << 20

#: Files that a task writes into one folder before it begins another.
FOLDER_FILES = 4096


def decode_utf8(content):
    """Bytes to text with undecodable bytes dropped; only invalid contents go to Python."""

    @F.arrow_udf("string")
    def salvage(contents: pa.Array) -> pa.Array:
        done = [
            pa.array([None if c is None else c.decode("utf-8", "ignore") for c in part.to_pylist()], pa.string())
            for part in slices(contents)
        ]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(salvage(F.when(~F.is_valid_utf8(text), content)))


def as_documents(
    df,
    key="doc_id",
    text="text",
    filename=None,
    metadata=None,
    cleaner=cleaning.clean,
    drop_empty=True,
    keep=(),
):
    """Rows of any table as documents.

    ``cleaner`` is a Column -> Column function (None: the text is clean already). ``doc_length``
    and ``content_hash`` are derived from the cleaned text unless the rows bring them: a length of
    0 and an empty hash count as not given. The key keeps its type; ``keep`` names columns to carry along.
    """
    original = F.col(text)
    content = cleaner(original) if cleaner else original
    if drop_empty:
        # No row or one row per text: unlike a filter, this cleans every text just once.
        content = F.explode(F.filter(F.array(content), lambda c: F.length(c) > 0))
    rows = df.select("*", content.alias("_content"))
    length, digest = F.length("_content"), content_hash(F.col("_content"))
    if "doc_length" in df.columns:
        given = F.col("doc_length").cast("int")
        length = F.when(given != 0, given).otherwise(length)
    if "content_hash" in df.columns:
        digest = F.when(F.col("content_hash") != "", F.col("content_hash")).otherwise(digest)
    no_metadata = F.lit(None).cast("map<string,string>")
    return rows.select(
        F.col(key).alias("doc_id"),
        F.col("_content").alias("content"),
        original.alias("original_content"),
        (F.col(filename) if filename else F.lit("")).alias("filename"),
        length.alias("doc_length"),
        digest.alias("content_hash"),
        (F.col(metadata) if metadata else no_metadata).alias("metadata"),
        *keep,
    )


def _text_files(files, cleaner):
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    rows = files.select(
        F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"),
        name.alias("name"),
        F.create_map(F.lit("source_path"), F.col("path")).alias("origin"),
        decode_utf8(F.col("content")).alias("text"),
    )
    return as_documents(rows, "stem", "text", filename="name", metadata="origin", cleaner=cleaner)


def _qualified(spark, path):
    """The file system of a path as Hadoop's object, and the path in full."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(at)


def _is_local(files):
    return files.getUri().getScheme() == "file"


def _opened(uri):
    """A local path as Hadoop writes it, for Python."""
    return uri.removeprefix("file:")


def _folders(spark, paths):
    """The folders that paths and patterns name; None unless all are folders of the file system that Python opens."""
    folders = []
    for path in paths:
        files, at = _qualified(spark, path)
        found = files.globStatus(at) if _is_local(files) else None
        if not found or not all(status.isDirectory() for status in found):
            return None
        folders += [status.getPath().toString() for status in found]
    return folders


def _is_text_file(name):
    """Spark's rule which names count as data, and ``*.txt``."""
    return name.endswith(".txt") and not (name.startswith(".") or (name.startswith("_") and "=" not in name))


def _listed(folder):
    """Rows (folder, names, bytes) of few files each; a row without names if there are folders that Spark takes for partitions."""
    names, total = [], 0
    with os.scandir(_opened(folder)) as entries:
        for entry in entries:
            if entry.is_dir():
                if "=" in entry.name:
                    yield folder, None, 0
                continue
            if not _is_text_file(entry.name):
                continue
            try:
                size = entry.stat().st_size
            except FileNotFoundError:  # gone meanwhile, or a link to nowhere
                continue
            if names and (len(names) >= LIST_FILES or total + size > LIST_BYTES):
                yield folder, _packed(names), total
                names, total = [], 0
            names.append(entry.name)
            total += size
    if names:
        yield folder, _packed(names), total


def _packed(names):
    return zlib.compress(b"\0".join(map(os.fsencode, names)))


def _contents(batches):
    for batch in batches:
        for folder, names in zip(*(column.to_pylist() for column in batch.columns)):
            names = [os.fsdecode(name) for name in zlib.decompress(names).split(b"\0")]
            contents = []
            for name in names:
                with open(f"{_opened(folder)}/{name}", "rb", buffering=0) as file:
                    contents.append(file.readall())
            paths = pa.array([f"{folder.rstrip('/')}/{name}" for name in names], pa.string())
            yield pa.RecordBatch.from_arrays([paths, pa.array(contents, pa.binary())], names=["path", "content"])


def _local_files(spark, paths):
    """Files of local folders, listed and read by tasks: (path, content); None where that is left to Spark's own reader.

    Spark's reader keeps a kilobyte for every file on the driver. Here it is the names alone, compressed.
    """
    folders = _folders(spark, paths)
    if folders is None:
        return None
    context = spark.sparkContext
    tasks = 4 * context.defaultParallelism
    listed = context.parallelize(folders, min(len(folders), tasks)).flatMap(_listed).collect()
    if any(names is None for _, names, _ in listed):
        return None
    tasks = max(tasks, -(-sum(total for *_, total in listed) // GATHER_BYTES))
    rows = context.parallelize([(folder, names) for folder, names, _ in listed], max(1, min(len(listed), tasks)))
    return spark.createDataFrame(rows, "folder string, names binary").mapInArrow(_contents, "path string, content binary")


def read_text_corpus(spark, path, cleaner=cleaning.clean):
    """Every ``*.txt`` directly in a folder as one document; files that clean to nothing are skipped.

    ``path`` may be a pattern of several folders, or a list of paths. Files are those that are there now. Folders of a file
    system that all executors mount (``file:``) are listed and read by tasks; in other stores Spark lists files on the
    driver, whose memory bounds their number. The key is the file name without its last extension. Files starting with
    ``_`` or ``.`` are not read.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = _local_files(spark, paths)
    if files is None:
        files = gathered(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(paths))
    return _text_files(files, cleaner)


def write_text_files(df, text, folder):
    """Every row of ``df`` as a text file of its own below ``folder``, a line feed at its end; the paths to read them from.

    On a file system that all executors mount (``file:``) tasks write the files themselves, at most ``FOLDER_FILES`` in a
    folder that no other attempt writes to; a folder counts once its task has named it. Spark's writer, used in other
    stores, starts processes for each local file and writes its checksum as another file.
    """
    spark = df.sparkSession
    files, at = _qualified(spark, folder)
    if not _is_local(files):
        rows = df.select(F.col(text), F.spark_partition_id().alias("task"))
        rows.write.option("maxRecordsPerFile", 1).partitionBy("task").text(folder)
        return [f"{folder}/task=*"]
    base = at.toString()
    files.mkdirs(at)
    per_folder = FOLDER_FILES

    def write(batches):
        name, n = None, 0
        for batch in batches:
            for value in batch.column(0):
                if name is None or n == per_folder:
                    if name is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["folder"])
                    name, n = uuid.uuid4().hex, 0
                    os.makedirs(f"{_opened(base)}/{name}")
                with open(f"{_opened(base)}/{name}/{name}-{n:06d}.txt", "xb") as file:
                    if value.is_valid:
                        file.write(value.as_buffer())
                    file.write(b"\n")
                n += 1
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["folder"])

    written = df.select(F.col(text).cast("binary")).mapInArrow(write, "folder string").collect()
    return [f"{base}/{row.folder}" for row in written] or [base]


def text_corpus_stream(spark, path, cleaner=cleaning.clean, max_files=None):
    """The same as a stream: files that arrive in the folder later become documents too."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.txt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _text_files(reader.load(path), cleaner)


def iterate_documents(docs):
    """Documents one at a time on the driver, one partition in memory at once."""
    return docs.select(*DOCUMENT_COLUMNS).toLocalIterator(prefetchPartitions=False)
