"""Scalar functions over text, numbers and dates, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier word -> (rule, factor). Fixed values.
MULTIPLIERS = {"k": ("NUM_MULT_K", 1000), "lakh": ("NUM_MULT_LAKH", 100000), "lakhs": ("NUM_MULT_LAKH", 100000), "crore": ("NUM_MULT_CRORE", 10**7),
               "crores": ("NUM_MULT_CRORE", 10**7), "million": ("NUM_MULT_MILLION", 10**6), "m": ("NUM_MULT_MILLION", 10**6)}
#: Currency sign or word -> code. Fixed values.
CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "usd": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP"}
#: Words that give a fact's category and frequency, in order. Fixed values.
CATEGORIES = [("income", ("salary", "income", "wage", "earning", "revenue", "pay")), ("tax", ("tax", "gst", "tds", "vat")),
              ("expense", ("rent", "expense", "cost", "emi", "premium")), ("balance", ("balance", "closing", "opening"))]
FREQUENCIES = [("monthly", "monthly"), ("weekly", "weekly"), ("annual", "annual"), ("yearly", "annual"), ("per annum", "annual"), ("per month", "monthly"), ("per week", "weekly")]
DECIMAL = "decimal(38,10)"


def stable_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def plain(v: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(v.cast(DECIMAL).cast("string"), r"\.?0+$", "")


def amount(raw: Column, mult: Column | None = None) -> Column:
    """struct(value decimal, rule): commas, parentheses or minus for negatives, k / lakh / crore / million."""
    t = F.trim(raw)
    paren = t.startswith("(") & t.endswith(")")
    core = F.regexp_replace(t, r"^[()\-]+|[()\-]+$", "")
    word = F.lower(mult) if mult is not None else F.lit("")
    rule = F.when(paren, "NUM_PARENS_NEGATIVE").when(core.contains(","), "NUM_THOUSANDS_COMMA").otherwise("NUM_PLAIN")
    factor = F.lit(1)
    for w, (r, f) in MULTIPLIERS.items():
        rule, factor = F.when(word == w, r).otherwise(rule), F.when(word == w, f).otherwise(factor)
    v = F.regexp_replace(core, ",", "").try_cast(DECIMAL)
    signed = F.when(paren | t.startswith("-"), -v).otherwise(v)
    return F.struct((signed * factor).cast(DECIMAL).alias("value"), rule.alias("rule"))


def cell_number(text: Column) -> Column:
    """struct(value decimal, rule) of a table cell; null where it is no number (a currency sign makes it none)."""
    t = F.regexp_replace(F.trim(text), "−", "-")
    paren = t.startswith("(") & t.endswith(")")
    inner = F.when(paren, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    pct = inner.endswith("%")
    rule = F.when(pct, "percent_strip").when(paren, "parentheses_negative").when(t.contains(","), "strip_thousands_separator").otherwise("plain_number")
    v = F.regexp_replace(inner, "[,%]", "").try_cast(DECIMAL)
    return F.when(t.rlike(r"^\(?-?[\d,]+(\.\d+)?\)?%?$") & v.isNotNull(), F.struct(F.when(paren, -v).otherwise(v).cast(DECIMAL).alias("value"), rule.alias("rule")))


def number_token(tok: Column) -> Column:
    """A number as text in one spelling: no commas, no leading or trailing zeros, minus for parentheses."""
    t = F.regexp_replace(F.trim(tok), "%+$", "")
    neg = (t.startswith("(") & t.endswith(")")) | t.startswith("-")
    core = F.regexp_replace(F.regexp_replace(t, r"^[()\-]+|[()\-]+$", ""), ",", "")
    s = plain(core.try_cast(DECIMAL))
    return F.when(core.rlike(r"^\d+(\.\d+)?$"), F.when(s == "0", "0").otherwise(F.concat(F.when(neg, "-").otherwise(""), s)))


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text, each in one spelling and also without its sign."""
    found = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])-?\(?\d[\d,]*(?:\.\d+)?\)?%?"), F.lit(0)), number_token))
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(found, lambda x: F.regexp_replace(x, "^-", "")))))


def to_iso(text: Column) -> Column:
    """A date from yyyy-mm-dd or d/m/yyyy (also with dots); null where the calendar has none."""
    parts = F.split(text, "[/.]")
    two = lambda c: F.lpad(c, 2, "0")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$"), F.concat_ws("-", F.get(parts, F.lit(2)), two(F.get(parts, F.lit(1))), two(F.get(parts, F.lit(0)))))
    return iso.try_cast("date")


def dates_in(text: Column) -> Column:
    """All valid dates of a text, ISO ones and d/m/y ones, in order of kind and place."""
    iso = F.regexp_extract_all(text, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))
    dmy = F.regexp_extract_all(text, F.lit(r"\b\d{1,2}[/.]\d{1,2}[/.]\d{4}\b"), F.lit(0))
    return F.array_compact(F.transform(F.concat(iso, dmy), to_iso))


def category(label: Column) -> Column:
    l, out = F.lower(label), F.lit(None).cast("string")
    for cat, words in reversed(CATEGORIES):
        out = F.when(reduce(or_, [l.contains(w) for w in words]), cat).otherwise(out)
    return out


def basis(label: Column) -> Column:
    l = F.lower(label)
    return F.when(l.contains("gross"), "gross").when(l.rlike(r"\bnet\b|take.?home"), "net").otherwise("unknown")


def frequency(label: Column, word: Column) -> Column:
    """From the words after the number, else from the label."""
    w = F.lower(word)
    out = F.lit(None).cast("string")
    for key, value in reversed(FREQUENCIES):
        out = F.when(F.lower(label).contains(key), value).otherwise(out)
    return F.when(w.contains("month"), "monthly").when(w.contains("week"), "weekly").when(w != "", "annual").otherwise(out)


def currency(sign: Column) -> Column:
    """Code of a sign or word; a bare dollar sign names no currency."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv]), F.lower(sign))


def iban_ok(s: Column) -> Column:
    """ISO 13616 check: the moved string, letters as 10..35, leaves 1 modulo 97."""
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")

    def step(acc, c):
        digit = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit) % 97

    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step) == 1


def mask_digits(s: Column) -> Column:
    """Digit runs of six and more: all but the last two become dots."""
    parts = F.split(s, r"\d{6,}", -1)
    runs = F.regexp_extract_all(s, F.lit(r"\d{6,}"), F.lit(0))
    hidden = F.transform(runs, lambda r: F.concat(F.repeat(F.lit("•"), F.length(r) - 2), F.substring(r, -2, 2)))
    woven = F.zip_with(parts, F.concat(hidden, F.array(F.lit(""))), lambda p, h: F.concat(p, h))
    return F.array_join(woven, "")


def mask_mail(s: Column) -> Column:
    return F.regexp_replace(s, r"([\w.+-])[\w.+-]*@([\w-]+\.[\w.]+)", "$1***@$2")


def mask_text(s: Column) -> Column:
    """E-mail names to one letter and stars, long digit runs to dots."""
    return mask_digits(mask_mail(s))


def mask_ip(s: Column) -> Column:
    return F.regexp_replace(s, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}\b", "$1.x")


def scrub(s: Column) -> Column:
    """`secret = value` pairs lose the value."""
    return F.regexp_replace(s, r"(?i)(password|secret|token|api[_-]?key)\s*[:=]\s*\S+", "$1=[redacted]")


def normal(s: Column) -> Column:
    """Lower case, white space runs as one space. Compatibility forms: see functions.text.nfkc."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def garbage_count(s: Column) -> Column:
    """Private-use and replacement characters of a text."""
    return F.length(s) - F.length(F.regexp_replace(s, "[\ue000-\uf8ff\ufffd]", ""))


def garbage_ratio(s: Column) -> Column:
    """Share of private-use and replacement characters."""
    return F.coalesce(F.try_divide(garbage_count(s), F.length(s)), F.lit(0.0))


def column_name(col: Column) -> Column:
    """Spreadsheet letters of a zero-based column: A, Z, AA, XFD and on, three letters at most (18,278 columns)."""
    n = col.cast("bigint")
    letter = lambda c: F.chr(65 + F.pmod(c, F.lit(26)))
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three)).otherwise(""), F.when(n >= 26, letter(two)).otherwise(""), letter(n))


def a1(row: Column, col: Column) -> Column:
    """Spreadsheet name of a zero-based cell."""
    return F.concat(column_name(col), (row + 1).cast("string"))


def a1_col(name: Column) -> Column:
    """Zero-based column of a cell name."""
    letters = F.split(F.regexp_extract(F.upper(name), "^([A-Z]+)", 1), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def file_name(name: Column) -> Column:
    """Last path part, no control characters, others than word characters, dot, dash, blank and brackets as _."""
    n = F.element_at(F.split(F.coalesce(name, F.lit("")), r"[\\/]"), -1)
    n = F.regexp_replace(F.regexp_replace(n, r"\p{C}", ""), r"(?U)[^\w.\- ()]", "_")
    n = F.regexp_replace(n, r"^[ .]+|[ .]+$", "")
    stem, ext = F.regexp_extract(n, r"^(.*)\.[^.]*$", 1), F.regexp_extract(n, r"\.([^.]*)$", 1)
    short = F.when(stem != "", F.concat(F.substring(stem, 1, 100), F.lit("."), F.substring(ext, 1, 10))).otherwise(F.substring(n, 1, 120))
    n = F.when(F.length(n) > 120, short).otherwise(n)
    return F.when(n == "", "file").otherwise(n)


def duration_hours(text: Column) -> Column:
    """`24 h`, `3d`, `2w` or plain hours; null where it is no duration."""
    n = F.regexp_extract(F.lower(text), r"^\s*(\d+)\s*([a-z]*)\s*$", 1).try_cast("bigint")
    unit = F.regexp_extract(F.lower(text), r"^\s*(\d+)\s*([a-z]*)\s*$", 2)
    return F.when(unit.isin("", "h", "hr", "hrs", "hour", "hours"), n).when(unit.isin("d", "day", "days"), n * 24).when(unit.isin("w", "week", "weeks"), n * 168)


def display(v: Column, decimals: int, thousands: bool = False, percent: bool = False, parens: bool = False, symbol: str = "") -> Column:
    """A number as a sheet shows it."""
    val = v * 100 if percent else v
    body = F.format_number(F.abs(val), decimals)
    body = body if thousands else F.regexp_replace(body, ",", "")
    s = F.concat(F.lit(symbol), body, F.lit("%" if percent else ""))
    return F.when(val < 0, F.concat(F.lit("("), s, F.lit(")")) if parens else F.concat(F.lit("-"), s)).otherwise(s)


#: Letters of a sheet's date format and of Spark's, longest first. Fixed values.
DATE_LETTERS = (("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("dd", "dd"), ("d", "dd"), ("m", "MM"))


def display_date(day: Column, sheet_format: str) -> Column:
    """A date as a sheet shows it: days and months always with two digits, other characters as they are."""
    out, rest = "", sheet_format.lower()
    while rest:
        sheet, spark = next((k for k in DATE_LETTERS if rest.startswith(k[0])), (rest[0], f"'{rest[0]}'" if rest[0].isalpha() else rest[0]))
        out, rest = out + spark, rest[len(sheet) :]
    return F.date_format(day, out)


def severity(pct: Column, medium: float = 5.0, high: float = 20.0) -> Column:
    return F.when(pct >= high, "high").when(pct >= medium, "medium").otherwise("low")


def band(confidence: Column, high: float = 0.85, medium: float = 0.6) -> Column:
    """Bands include both ends and the lower one wins at a boundary."""
    return F.when(confidence.isNull(), None).when(confidence <= medium, "low").when(confidence <= high, "medium").otherwise("high")
