"""Intake: content types from leading bytes and text, the manifest of accepted and rejected files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OFFICE = "application/vnd.openxmlformats-officedocument."
_OPEN = "application/vnd.oasis.opendocument."
#: Extensions that fit a content type. Fixed values.
EXTENSIONS = {
    "application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpg jpeg", "image/tiff": "tif tiff", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp",
    _OFFICE + "wordprocessingml.document": "docx", _OFFICE + "presentationml.presentation": "pptx", _OFFICE + "spreadsheetml.sheet": "xlsx",
    _OPEN + "text": "odt", _OPEN + "presentation": "odp", _OPEN + "spreadsheet": "ods", "application/epub+zip": "epub",
    "application/msword": "doc", "application/vnd.ms-powerpoint": "ppt", "application/vnd.ms-excel": "xls",
    "text/csv": "csv tsv", "text/html": "html htm", "message/rfc822": "eml", "text/rtf": "rtf", "text/plain": "txt text", "text/markdown": "md markdown",
    "application/json": "json", "application/xml": "xml",
}
#: Leading bytes, in hex. Fixed values.
MAGIC = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("474946383761", "image/gif"),
         ("474946383961", "image/gif"), ("424D", "image/bmp"), ("4D5A", "application/x-executable"), ("7F454C46", "application/x-executable"), ("2321", "application/x-executable"))
OLE, ZIP = "D0CF11E0A1B11AE1", "504B0304"
#: Names inside an archive that tell its type. Fixed values.
PARTS = (("word/", _OFFICE + "wordprocessingml.document"), ("ppt/", _OFFICE + "presentationml.presentation"), ("xl/", _OFFICE + "spreadsheetml.sheet"))
MOST_BYTES, MOST_PAGES = 52_428_800, 1000
#: Types whose content outweighs a wrong extension: a warning only. Fixed values.
STRONG = ("application/pdf", "application/epub+zip", *(m for m in EXTENSIONS if m.startswith(("image/", _OFFICE, _OPEN))))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def sniff(content: Column, ext: Column) -> Column:
    """Content type of a binary column, or null: leading bytes decide first, then text forms, then the extension."""
    head = F.hex(F.substring(content, 1, 16))
    raw = F.decode(content, "ISO-8859-1")  # one character a byte
    ole = F.when(ext == "doc", "application/msword").when(ext == "xls", "application/vnd.ms-excel").when(ext == "ppt", "application/vnd.ms-powerpoint").otherwise("application/x-ole")
    archive = F.lit("application/zip")
    for part, mime in reversed(PARTS):
        archive = F.when(raw.contains(part), mime).otherwise(archive)
    for mime in (m for m in EXTENSIONS if m.startswith(_OPEN) or m == "application/epub+zip"):
        archive = F.when(raw.substr(31, 100).startswith("mimetype" + mime), mime).otherwise(archive)

    start = F.substring(content, 1, 65536)
    text = F.when(F.is_valid_utf8(start.cast("string")), start.cast("string")).otherwise(F.decode(start, "ISO-8859-1"))
    body = F.regexp_replace(text, r"^\s+", "")
    low = F.lower(body)
    some = body != ""
    shown = F.length(text) - F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]|[ \r\n\t]", ""))
    words = (
        F.when(F.hex(F.substring(content, 1, 2048)).rlike("^(?:..)*?00"), F.lit(None).cast("string"))
        .when(low.startswith("{\\rtf"), "text/rtf")
        .when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html")
        .when(low.startswith("<?xml") | (low.startswith("<") & (ext == "xml")), "application/xml")
        .when(low.rlike("^(from|received|mime-version|return-path|date|subject):"), "message/rfc822")
        .when(ext.isin("csv", "tsv") & some, "text/csv")
        .when(ext.isin("md", "markdown") & some, "text/markdown")
        .when((ext == "json") & some, F.when(F.try_parse_json(text).isNotNull(), "application/json"))
        .when(ext.isin("txt", "text") & some, "text/plain")
        .when(some & (shown >= 0.96 * F.length(text)), "text/plain")
    )
    out = F.when(head.startswith(OLE), ole).when(head.startswith(ZIP), archive).otherwise(words)
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise(out)
    for magic, mime in reversed(MAGIC):
        out = F.when(head.startswith(magic), mime).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, glob: str | None = None, deep: bool = True) -> DataFrame:
    """One row a file below path: path, display_name, modified, size_bytes, content. Listed and read by Spark, so a folder of any
    store; a column that is not used is not read, and filters on size and time skip files unread. Spark leaves out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # a path is a URI: its last part, decoded
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return reader.load(path).select("path", name.alias("display_name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), "content")


def manifest(df: DataFrame, content: str = "content", name: str = "display_name", pages: str | None = None) -> DataFrame:
    """df with detected_mime, status, code and warning: the first rule that fails rejects a file.

    Map-only. A null content is empty; a file without extension fits every type; `pages` names a page count.
    """
    ext, size = extension(F.coalesce(F.col(name), F.lit(""))), F.coalesce(F.octet_length(content), F.lit(0))
    fits = F.create_map(*[F.lit(x) for m, e in EXTENSIONS.items() for x in (m, f" {e} ")])
    mime = F.col("detected_mime")
    wrong = (ext != "") & ~F.coalesce(F.try_element_at(fits, mime).contains(F.concat(F.lit(" "), ext, F.lit(" "))), F.lit(False))
    many = F.coalesce(F.col(pages) > MOST_PAGES, F.lit(False)) if pages else F.lit(False)
    code = (
        F.when(size == 0, "EMPTY_FILE").when(size > MOST_BYTES, "TOO_LARGE").when(mime.isNull(), "UNSUPPORTED_FORMAT")
        .when(mime.isin("application/x-executable", "application/x-ole", "application/zip"), "UNSUPPORTED_FORMAT")
        .when(wrong & ~mime.isin(*STRONG), "FORMAT_MISMATCH").when(many, "TOO_LARGE")
    )
    known = F.when((size > 0) & (size <= MOST_BYTES), sniff(F.col(content), ext))
    out = df.withColumn("detected_mime", known).withColumn("code", code)
    warning = F.when(F.col("code").isNull() & wrong, "FILE_EXTENSION_MISMATCH")
    return out.withColumn("status", F.when(F.col("code").isNull(), "accepted").otherwise("rejected")).withColumn("warning", warning)


def extension_verdict(mime: Column, ext: Column) -> Column:
    """match, warn (a strong type under another name), reject (a weak one), or unknown where the bytes tell no type."""
    fits = F.create_map(*[F.lit(x) for m, e in EXTENSIONS.items() for x in (m, e)])
    known = F.split(F.coalesce(F.try_element_at(fits, mime), F.lit("")), " ")
    return F.when(mime.isNull() | (mime == "application/x-executable"), "unknown").when((ext != "") & F.array_contains(known, ext), "match").when(mime.isin(*STRONG), "warn").otherwise("reject")
