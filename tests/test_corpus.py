import pytest
from pyspark.sql import functions as F

from textharbor import as_documents, iterate_documents, read_text_corpus, run_dir, write_text_files
from textharbor.schema import document_schema
from textharbor.sources import corpus


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_text_folder(spark, tmp_path):
    folder = write(
        tmp_path / "in",
        {
            "physics.txt": "Quantum <b>Energy</b>",
            "a.b.txt": "two dots",
            "100% a+b é.txt": "odd name",
            "bad.txt": b"a\xffb",
            "empty.txt": "",
            "blank.txt": " \n&nbsp;",
            "note.md": "not read",
            "UPPER.TXT": "not read either",
        },
    )
    (tmp_path / "in" / "sub").mkdir()
    write(tmp_path / "in" / "sub", {"deep.txt": "not read"})
    docs = read_text_corpus(spark, folder)
    assert docs.schema.simpleString() == document_schema().simpleString()
    got = {r.doc_id: r for r in docs.collect()}
    assert {k: r.content for k, r in got.items()} == {
        "physics": "quantum energy",
        "a.b": "two dots",
        "100% a+b é": "odd name",
        "bad": "ab",
    }
    assert got["a.b"].filename == "a.b.txt" and got["100% a+b é"].filename == "100% a+b é.txt"
    assert got["physics"].original_content == "Quantum <b>Energy</b>"
    assert got["physics"].metadata["source_path"].endswith("/in/physics.txt")
    assert got["physics"].doc_length == 14


def test_empty_folder_and_missing_folder(spark, tmp_path):
    assert read_text_corpus(spark, write(tmp_path / "none", {})).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_text_corpus(spark, str(tmp_path / "missing"))


def test_derived_columns(spark):
    rows = spark.createDataFrame([(1, "Ab  C")], "k bigint, t string")
    doc = as_documents(rows, "k", "t").first()
    assert doc.doc_id == 1 and doc.content == "ab c" and doc.doc_length == 4 and len(doc.content_hash) == 64


def test_supplied_length_and_hash_are_kept(spark):
    rows = spark.createDataFrame([(1, "x", 9, "h"), (2, "x", 0, "")], "k int, t string, doc_length int, content_hash string")
    got = {r.doc_id: r for r in as_documents(rows, "k", "t").collect()}
    assert (got[1].doc_length, got[1].content_hash) == (9, "h")
    assert got[2].doc_length == 1 and len(got[2].content_hash) == 64


def test_equal_texts_hash_equal_and_others_do_not(spark):
    rows = spark.createDataFrame([(1, "A <b>b</b>"), (2, "a b"), (3, "a c")], "k int, t string")
    h = {r.doc_id: r.content_hash for r in as_documents(rows, "k", "t").collect()}
    assert h[1] == h[2] != h[3]


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, "<p>"), (2, None), (3, "x")], "k int, t string")
    assert [r.doc_id for r in as_documents(rows, "k", "t").collect()] == [3]
    assert as_documents(rows, "k", "t", drop_empty=False).count() == 3


def test_own_cleaner(spark):
    rows = spark.createDataFrame([(1, "Ab")], "k int, t string")
    assert as_documents(rows, "k", "t", cleaner=F.upper).first().content == "AB"
    assert as_documents(rows, "k", "t", cleaner=None).first().content == "Ab"


def test_iterate(spark, science):
    assert sorted(d.doc_id for d in iterate_documents(science)) == ["biology", "chemistry", "physics"]


def test_one_file_per_row_loads_back(spark, science):
    folder = run_dir(spark, "files")
    science.select("original_content").write.option("maxRecordsPerFile", 1).text(folder)
    back = read_text_corpus(spark, folder).select("content_hash", "doc_length")
    assert sorted(back.collect()) == sorted(science.select("content_hash", "doc_length").collect())


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cleaned_once(spark):
    docs = as_documents(spark.createDataFrame([(1, "a &amp; b")], "k int, t string"), "k", "t")
    assert plan(docs.filter("doc_length > 2").select("content", "content_hash")).count("unescape") == 1


def test_many_small_files_of_several_folders_take_few_tasks(spark, tmp_path):
    for i in range(200):
        folder = tmp_path / f"part={i % 5}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{i}.txt").write_text(f"text {i}")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        docs = read_text_corpus(spark, f"{tmp_path}/part=*")
        assert docs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert {r.doc_id for r in docs.collect()} == {f"f{i}" for i in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_rows_become_files_and_nothing_else(spark, tmp_path):
    rows = [("Grüße <b>x</b>",), ("",), (None,), ("two\nlines",), ("two\nlines",)] + [(f"t {i}",) for i in range(200)]
    df = spark.createDataFrame(rows, "body string").repartition(3)
    folder = tmp_path / "files"
    read = write_text_files(df, "body", f"file://{folder}")
    found = [f for f in folder.rglob("*") if f.is_file()]
    assert sorted(f.read_text() for f in found) == sorted((text or "") + "\n" for text, in rows)
    (folder / "other").mkdir()
    (folder / "other" / "of a lost attempt.txt").write_text("not read")
    docs = read_text_corpus(spark, read)
    assert sorted(r.content for r in docs.collect()) == sorted(["grüße x", "two lines", "two lines"] + [f"t {i}" for i in range(200)])
    assert docs.select("doc_id").distinct().count() == docs.count()
    none = write_text_files(df.limit(0), "body", str(tmp_path / "none"))
    assert read_text_corpus(spark, none).count() == 0


def test_a_task_begins_another_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FOLDER_FILES", 3)
    read = write_text_files(spark.range(7).select(F.col("id").cast("string").alias("t")).coalesce(1), "t", str(tmp_path / "files"))
    assert len(read) == 3 and {r.content for r in read_text_corpus(spark, read).collect()} == set("0123456")


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path):
    names = ["a.txt", "_h.txt", ".h.txt", "_k=v.txt", "_metadata.txt", "x.txt._COPYING_", "é [1].txt", "b.TXT", "c.txt.gz", ".txt"]
    folder = write(tmp_path / "in", {name: "word" for name in names})
    (tmp_path / "in" / "gone.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "in" / "linked.txt").symlink_to(tmp_path / "in" / "a.txt")
    docs = read_text_corpus(spark, folder)
    by_spark = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    assert "binaryFile" not in plan(docs)  # whose list of files the driver holds
    assert sorted(r[0] for r in docs.select("metadata.source_path").collect()) == sorted(r.path for r in by_spark.collect())
    write(tmp_path / "in", {"later.txt": "word"})
    assert docs.count() == by_spark.count()


def test_files_larger_than_a_batch_and_folders_of_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "LIST_BYTES", 10)
    folder = write(tmp_path / "in", {f"{i}.txt": "ab " * i for i in range(1, 9)})
    assert sorted(r.doc_length for r in read_text_corpus(spark, folder).collect()) == [3 * i - 1 for i in range(1, 9)]
    assert read_text_corpus(spark, f"{folder}/3.txt").first().doc_id == "3"
    (tmp_path / "parted").mkdir()
    write(tmp_path / "parted" / "k=1", {"p.txt": "word"})
    assert [r.doc_id for r in read_text_corpus(spark, str(tmp_path / "parted")).collect()] == ["p"]
