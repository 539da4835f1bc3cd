"""Readers that turn text, HTML, CSV, JSON, XML and e-mail columns into rows."""

from __future__ import annotations

import csv
import email
import email.policy
import hashlib
import io
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Elements whose text is no content, marks of such regions, elements that form a block, and those without an end. Fixed values.
SKIPPED = {"script", "style", "nav", "footer", "noscript"}
MARKS = ("cookie-banner", "cookie-consent", "navbar", "navigation")
BLOCKS = {"p": "paragraph", "li": "list_item", "pre": "paragraph", "blockquote": "paragraph", "figcaption": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


#: Elements that an opening one of the kind on the left ends, as their own end may be left out. Fixed values.
ENDS = {"li": ("li", "p"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "table": ("p",), "ul": ("p",), "ol": ("p",), "div": ("p",)} | {k: ("p",) for k in BLOCKS if k != "li"}


#: Elements whose inside ends nothing outside. Fixed values.
WALLS = {"table", "ul", "ol", "div", "article", "section", "main", "body"}


class _Events(HTMLParser):
    """A page as a list of (what, name or text, attributes)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []
        self.handle_starttag = lambda tag, attrs: self.seen.append(("open", tag, dict(attrs)))
        self.handle_endtag = lambda tag: self.seen.append(("close", tag, None))
        self.handle_data = lambda data: self.seen.append(("text", data, None))
        self.feed(html)
        self.close()


def _is_hidden(tag: str, attrs: dict) -> bool:
    named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
    return tag in SKIPPED or any(m in named for m in MARKS)


def page_blocks(html: str) -> list[tuple[str, int, str]]:
    """(type, level, text) of one page in order, by one fold over its events with a stack of open elements.

    An element hands on what it holds when it ends: a cell its text to the row, a row its cells to the table, a block
    and a table their text to the result. A block inside another ends the text before it. Hidden elements hand on nothing.
    """
    out: list[tuple[str, int, str]] = []
    stack: list[dict] = []
    hidden = 0

    def hand_on(e: dict) -> None:
        text = " ".join("".join(e["text"]).split())
        e["text"] = []
        if e["tag"] in BLOCKS and text:
            kind = BLOCKS[e["tag"]]
            out.append((kind, int(e["tag"][1]) if kind == "heading" else 0, text))
        elif e["tag"] in ("td", "th") or e["tag"] == "tr" and e["held"]:
            into = next((o for o in reversed(stack) if o["tag"] == ("tr" if e["tag"] != "tr" else "table")), None)
            if into:
                into["held"].append(text if e["tag"] != "tr" else " | ".join(e["held"]))
        elif e["tag"] == "table" and e["held"]:
            out.append(("table", 0, "\n".join(e["held"])))

    def end(tag: str) -> None:
        nonlocal hidden
        if any(e["tag"] == tag for e in stack):
            while True:
                e = stack.pop()
                hidden -= e["hides"]
                if not hidden and not e["hides"]:
                    hand_on(e)
                if e["tag"] == tag:
                    return

    for what, name, attrs in _Events(html).seen:
        if what == "close":
            end(name)
        elif what == "text":
            into = None if hidden else next((e for e in reversed(stack) if e["tag"] in BLOCKS or e["tag"] in ("td", "th", "table")), None)
            if into is not None and into["tag"] != "table":
                into["text"].append(name)
        else:
            for other in ENDS.get(name, ()):
                inner = next((e["tag"] for e in reversed(stack) if e["tag"] == other or e["tag"] in WALLS and e["tag"] != other), None)
                if inner == other:
                    end(other)
            hides = _is_hidden(name, attrs)
            holder = next((e for e in reversed(stack) if e["tag"] in BLOCKS or e["tag"] in ("td", "th")), None)
            if name in VOID:
                if not hidden and not hides and name == "img":
                    out.append(("figure", 0, attrs.get("alt") or attrs.get("title") or "(picture without a text)"))
                elif name == "br" and holder:
                    holder["text"].append(" ")
                continue
            if not hidden and not hides and (name in BLOCKS or name == "table") and holder and holder["tag"] in BLOCKS:
                hand_on(holder)
            hidden += hides
            stack.append({"tag": name, "hides": hides, "text": [], "held": []})
    while stack:
        end(stack[-1]["tag"])
    return out


def html_blocks(df: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, seq, block_type, level, text: headings, paragraphs, list items, tables and image texts in order.

    Map-only; null html gives no block."""

    def run(frames):
        for f in frames:
            rows = []
            for i, h in zip(f[id_col], f[html], strict=True):
                rows += [(i, k, *b) for k, b in enumerate(page_blocks(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "block_type", "level", "text"])

    return df.select(id_col, html).mapInPandas(run, "page_id long, seq long, block_type string, level long, text string")


#: Extensions of attachments that become sources of their own. Fixed values.
SUPPORTED = {"pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp", "txt", "md", "csv", "tsv", "json", "xml", "html", "htm", "docx", "xlsx", "pptx", "eml", "rtf"}


def _text(part) -> str:
    """A text part as it stands; without a charset of its own it is text already and is not decoded again."""
    plain = part.get_content_charset() is None and (part.get("content-transfer-encoding") or "7bit").lower() in ("7bit", "8bit")
    return part.get_payload() if plain and isinstance(part.get_payload(), str) else part.get_content()


def emails(df: DataFrame, id_col: str, raw: str) -> DataFrame:
    """message_id, kind, text, child_id of each message: one metadata row, body rows (plain text before HTML, whose blocks
    are read as a page's) and attachment rows by name. A supported attachment has a child id, the first 16 hex digits of
    the SHA-256 of the message's id, its name and its place. A null message has one empty metadata row."""

    def run(frames):
        for f in frames:
            rows = []
            for i, r in zip(f[id_col], f[raw], strict=True):
                m = email.message_from_string(r or "", policy=email.policy.default)
                rows.append((i, "metadata", f"{m.get('from', '')} | {m.get('subject', '')}", None))
                body = m.get_body(("plain", "html"))
                text = _text(body) if body else ""
                parts = [t for *_, t in page_blocks(text)] if body and body.get_content_type() == "text/html" else text.split("\n\n")
                rows += [(i, "body", p, None) for p in parts if p.strip()]
                for k, name in enumerate(sorted(a.get_filename() or "unnamed" for a in m.iter_attachments())):
                    child = hashlib.sha256(f"{i}|{name}|{k}".encode()).hexdigest()[:16] if name.rpartition(".")[2].lower() in SUPPORTED else None
                    rows.append((i, "attachment", name, child))
            yield pd.DataFrame(rows, columns=["message_id", "kind", "text", "child_id"])

    return df.select(F.col(id_col).cast("string").alias(id_col), raw).mapInPandas(run, "message_id string, kind string, text string, child_id string")


DELIMITERS = ",;\t|"


def csv_cells(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, row, col, value: long cells of delimited text; the delimiter is the one of `, ; tab |` that the first line
    holds most. Fields may be quoted and then hold delimiters, line breaks and doubled quotes. Rows count the records,
    blank ones included, but have no cells for them; null and empty texts have none at all."""

    def run(frames):
        csv.field_size_limit(sys.maxsize)
        for f in frames:
            rows = []
            for i, t in zip(f[id_col], f[text], strict=True):
                if not t:
                    continue
                head = t.split("\n", 1)[0]
                best = max(DELIMITERS, key=lambda d: (head.count(d), -DELIMITERS.index(d)))
                rows += [(i, r, c, v) for r, record in enumerate(csv.reader(io.StringIO(t, newline=""), delimiter=best)) for c, v in enumerate(record)]
            yield pd.DataFrame(rows, columns=[id_col, "row", "col", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, row int, col int, value string")


#: Lines that are list items, headings, and rules between the head and body of a table. Fixed values.
ITEM, HEADING, RULE = r"^\s*(?:[-*•+]\s+|\d+[.)]\s+)", r"^#{1,6}\s+", r"^[|]*\s*:?-{3,}:?\s*(?:[|]\s*:?-{3,}:?\s*)*[|]*$"


def text_blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text", markdown: bool = True) -> DataFrame:
    """id, block, block_type, level, text of plain or Markdown text; null and empty texts give no block.

    Blank lines end a block, list runs stay together behind bullets, headings and code fences stand alone, lines
    with bars form tables without their rules; the lines of a paragraph are joined by blanks.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    lines = df.select(id_col, F.posexplode(F.split(t, "\n")).alias("n", "line")).withColumn("s", F.regexp_replace("line", r"^\s+|\s+$", ""))
    s, plain = F.col("s"), F.when(F.col("line").rlike(ITEM), "list").otherwise("paragraph")
    kind = F.when(s == "", "blank")
    if markdown:
        lines = lines.where(~(s.contains("|") & s.rlike(RULE)))
        kind = kind.when(s.startswith("```"), "code_fence").when(s.rlike(HEADING), "heading").when(s.contains("|"), "table")
    lines = lines.withColumn("kind", kind.otherwise(plain))
    cells = F.trim(F.regexp_replace(F.regexp_replace(s, "^[|]+|[|]+$", ""), r"\s*[|]\s*", " | "))
    k = F.col("kind")
    shown = F.when(k == "heading", F.regexp_replace(s, HEADING, "")).when(k == "table", cells).when(k == "list", F.regexp_replace("line", ITEM, "• ")).otherwise(s)
    w = Window.partitionBy(id_col).orderBy("n")
    new = (k != F.lag("kind", 1, "").over(w)) | k.isin("heading", "code_fence")
    lines = lines.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.when(k == "heading", F.length(F.regexp_extract(s, "^(#+)", 1))).otherwise(0).cast("bigint")
    out = lines.where("kind <> 'blank'").groupBy(id_col, "block").agg(F.first("kind").alias("block_type"), F.max(level).alias("level"), F.array_sort(F.collect_list(F.struct("n", shown.alias("t")))).alias("l"))
    body = F.transform("l", lambda x: x["t"])
    return out.select(id_col, "block", "block_type", "level", F.when(F.col("block_type") == "paragraph", F.array_join(body, " ")).otherwise(F.array_join(body, "\n")).alias("text"))


def json_value(raw: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def flatten_blocks(documents: DataFrame) -> DataFrame:
    """One row a block of documents whose column `pages` is array<struct<page_number, blocks array<struct>>>: the other
    columns, page_number and the fields of the block. Without a shuffle; null or empty pages give no row."""
    keys = [c for c in documents.columns if c != "pages"]
    pages = documents.select(*keys, F.explode("pages").alias("p"))
    return pages.select(*keys, "p.page_number", F.explode("p.blocks").alias("b")).select(*keys, "page_number", "b.*")


def xml_rows(df: DataFrame, text: str, row: str, fields: str) -> DataFrame:
    """df with one row for each element `row` of its XML texts: seq from 0, the `fields` (DDL; `_x` is an attribute x), is_corrupt.

    A text that is no XML gives one row without seq that is_corrupt, one with no such
    element none; a value of another type is null. Read by Spark's own parser against the schema, one text at a time."""
    made = T.StructType.fromDDL(fields)
    # read as text and cast then, so that a value of another type does not make its whole text corrupt
    plain = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.StructType, T.ArrayType)) else T.StringType()) for f in made.fields])
    schema = T.StructType([T.StructField(row, T.ArrayType(plain)), T.StructField("_corrupt", T.StringType())])
    keep = [F.col(f"`{c}`") for c in df.columns if c != text]
    got = df.withColumn("__x", F.from_xml(F.col(f"`{text}`"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.col("__x._corrupt").isNull() & F.col("__x").isNotNull()
    none = F.array(F.lit(None).cast(plain))
    rows = got.select(*keep, (~whole).alias("is_corrupt"), F.posexplode(F.when(whole, F.col(f"__x.`{row}`")).otherwise(none)).alias("__n", "__r"))
    return rows.select(*keep, F.when(~F.col("is_corrupt"), F.col("__n")).alias("seq"), *[F.col(f"__r.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in made.fields], "is_corrupt")
