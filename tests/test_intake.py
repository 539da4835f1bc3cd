"""Content types, the manifest and text checks on micro-tables."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions.checks import text_checks
from foliospark.sources import intake

ZIP = b"PK\x03\x04" + b"\x00" * 26


@pytest.mark.parametrize(("content", "ext", "want"), [
    (b"%PDF-1.7 x", "txt", "application/pdf"), (b"\x89PNG\r\n\x1a\n..", "png", "image/png"), (b"\xff\xd8\xff\xe0", "", "image/jpeg"), (b"MM\x00*..", "tif", "image/tiff"),
    (b"RIFF\x01\x02\x03\x04WEBPVP8", "webp", "image/webp"), (b"MZ\x90", "txt", "application/x-executable"), (b"#!/bin/sh", "txt", "application/x-executable"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "xls", "application/vnd.ms-excel"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1..", "bin", "application/x-ole"),
    (ZIP + b"word/document.xml", "docx", intake._OFFICE + "wordprocessingml.document"), (ZIP + b"mimetypeapplication/epub+zipPK", "epub", "application/epub+zip"), (ZIP + b"a.txt", "zip", "application/zip"),
    (b"  <!DOCTYPE HTML><p>", "txt", "text/html"), (b"<a/>", "xml", "application/xml"), (b"<a/>", "txt", "text/plain"), (b"{\\rtf1 x", "rtf", "text/rtf"), (b"Subject: hi\n\nx", "txt", "message/rfc822"),
    (b"a,b\n1,2", "csv", "text/csv"), (b'{"a": 1}', "json", "application/json"), (b"{a", "json", None), (b"caf\xe9", "txt", "text/plain"), (b"a\x00b", "txt", None), (b" \n", "txt", None), (b"\x01\x02\x03a", "bin", None),
])
def test_sniff(spark, content, ext, want):
    df = spark.createDataFrame([(bytearray(content), ext)], "c binary, e string")
    assert df.select(intake.sniff(F.col("c"), F.col("e"))).first()[0] == want


def test_manifest_takes_the_first_rule_that_fails(spark):
    rows = [(b"", "a.txt", 1), (None, "a.txt", 1), (b"text", "a.txt", 1), (b"text", "a.pdf", 1), (b"%PDF-", "a.txt", 1), (b"%PDF-", "a.pdf", 2000), (b"MZ", "a.txt", 1), (b"\x00\x01", "a.txt", 1), (b"text", "noext", None)]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), n, p) for i, (c, n, p) in enumerate(rows)], "i int, content binary, display_name string, p int")
    got = [(r.code, r.warning, r.status) for r in intake.manifest(df, pages="p").orderBy("i").collect()]
    assert got == [
        ("EMPTY_FILE", None, "rejected"), ("EMPTY_FILE", None, "rejected"), (None, None, "accepted"), ("FORMAT_MISMATCH", None, "rejected"), (None, "FILE_EXTENSION_MISMATCH", "accepted"),
        ("TOO_LARGE", None, "rejected"), ("UNSUPPORTED_FORMAT", None, "rejected"), ("UNSUPPORTED_FORMAT", None, "rejected"), (None, None, "accepted"),
    ]


@pytest.mark.parametrize(("text", "want"), [
    ("", []), (None, []), ("due 31/02/2025", ["date_validity:fail", "unit_sanity:pass"]),
    ("from 2025-01-02 to 01/01/2025", ["date_validity:pass", "date_ordering:fail", "unit_sanity:pass"]),
    ("paid 1,00,000", ["currency_format:warn", "unit_sanity:pass"]), ("grew 1200%", ["unit_sanity:warn"]), ("owes 2,000,000,000", ["unit_sanity:warn"]),
    ("GB82WEST12345698765432 ok", ["checksum_iban:pass"]), ("GB82WEST12345698765433 no", ["checksum_iban:fail"]),
    ("card no 4111 1111 1111 1111", ["unit_sanity:pass", "checksum_luhn:pass"]), ("card 4111 1111 1111 1112", ["unit_sanity:pass", "checksum_luhn:fail"]),
])
def test_text_checks(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert [f"{c['name']}:{c['status']}" for c in df.select(text_checks(F.col("t"))).first()[0]] == want


def test_folder_through_the_manifest(spark, tmp_path):
    """Real files, read with their metadata, in folders below; a broken type, an empty file (which Spark leaves out), a name with blanks and a plus."""
    from foliospark.sources import intake

    (tmp_path / "deep").mkdir()
    files = {"a b+c.txt": b"plain words", "deep/x.pdf": b"%PDF-1.7 x", "empty.csv": b"", "deep/wrong.md": b"\x7fELF\x02\x01", "t.csv": b"a,b\n1,2\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.display_name: r for r in intake.manifest(intake.read_files(spark, str(tmp_path))).collect()}
    assert {n: (r.size_bytes, r.detected_mime, r.status, r.code) for n, r in rows.items()} == {
        "a b+c.txt": (11, "text/plain", "accepted", None), "x.pdf": (10, "application/pdf", "accepted", None), 
        "wrong.md": (6, "application/x-executable", "rejected", "UNSUPPORTED_FORMAT"), "t.csv": (8, "text/csv", "accepted", None)}
    assert all(r.modified is not None for r in rows.values())
    assert sorted(r.display_name for r in intake.read_files(spark, str(tmp_path), "*.csv").select("display_name").collect()) == ["t.csv"]


def test_xml_rows(spark):
    from foliospark.sources.documents import xml_rows

    texts = ["<f><e k='1'><n>2</n></e><e><n>x</n></e></f>", "<f><e k='1'>", "<f/>", None, "no xml", "<f><e k='7'/></f>"]
    got = xml_rows(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x", "e", "_k int, n long")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(0, 0, 1, 2, False), (0, 1, None, None, False), (1, None, None, None, True), (3, None, None, None, True), (4, None, None, None, True), (5, 0, 7, None, False)], key=repr)


def test_written_tables_go(spark, tmp_path):
    """Nothing that a query wrote for itself is left once its result is out and the session's tables are released."""
    import os

    from foliospark import tables
    from foliospark.queries import QUERIES

    tables.release(spark)
    QUERIES["t02_shared_sets"](spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out"))
    made = [p for p in spark._foliospark_written if os.path.isdir(p)]
    assert made and tables.release(spark) == len(made) and not any(os.path.isdir(p) for p in made)


def test_text_checks_read_a_text_once(spark):
    """The text is an expression of its own, which must not be copied into every check."""
    text = F.concat(F.lit("on "), F.col("id").cast("string"), F.lit("/2/2020"))
    plan = spark.range(3).select(text_checks(text).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/2/2020") == 1
