"""Text functions of the document pipeline, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEDIA_TOKENS = 512


def normalize_text(text: Column) -> Column:
    """Letters, digits and single spaces, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))


def token_estimate(chars: Column, media: Column | int = 0) -> Column:
    return F.greatest(F.floor(chars / 4), F.lit(1)) + F.lit(media) * MEDIA_TOKENS if isinstance(media, int) else F.greatest(F.floor(chars / 4), F.lit(1)) + media * MEDIA_TOKENS


def head_tail(text: Column, most: int) -> Column:
    """A marked extract: the trimmed text, or its beginning and end where it has more than `most` characters, at least
    256; an empty one says so."""
    most = max(256, most)
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    cut = F.concat(F.substring(bare, 1, most // 2), F.lit("\n...\n"), F.right(bare, F.lit(most // 2)))
    return F.when(bare == "", "[FALLBACK-EXTRACT] (empty content)").otherwise(F.concat(F.lit("[FALLBACK-EXTRACT]\n"), F.when(F.length(bare) > most, cut).otherwise(bare)))


def line_chunks(docs: DataFrame, size: int = 150, overlap: int = 20, small: int = 8000) -> DataFrame:
    """doc_id, chunk, start, lines: overlapping runs of lines; a short text is one chunk."""
    rows = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    count = F.size("lines")
    starts = F.filter(F.sequence(F.lit(0), count - 1, F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < count))
    starts = F.when((count <= size) & (F.col("chars") <= small), F.array(F.lit(0))).otherwise(starts)
    out = rows.select("doc_id", "lines", F.posexplode(starts).alias("chunk", "start"))
    return out.select("doc_id", "chunk", "start", F.slice("lines", F.col("start") + 1, size).alias("lines"))


def drop_repeated_lines(text: Column) -> Column:
    """A text without lines that repeat the one before; blank lines stay."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, i: (F.trim(x) == "") | (i == 0) | (x != F.get(lines, i - 1))), "\n")


def forward_fill(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    window = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(F.nullif(F.trim(F.col(column)), F.lit("")), True).over(window))


def safe_float(text: Column) -> Column:
    """A number written with thousands separators; null for anything else."""
    bare = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))


# Labels of rows that carry a sum over, by themselves and as a pattern before a currency, a colon and a figure.
SUBTOTALS = (
    "TO COLLECTION", "TO COLLECTION AED", "TO SUMMARY", "SUB-TOTAL", "SUBTOTAL", "SUB TOTAL", "C/F", "B/F", "C/FWD", "B/FWD", "CARRIED FORWARD", "BROUGHT FORWARD",
    "PAGE TOTAL", "SHEET TOTAL", "AMOUNT CARRIED", "AMOUNT BROUGHT", "TOTAL CARRIED", "TOTAL BROUGHT", "CARRIED TO SUMMARY", "CARRIED TO COLLECTION",
)
SUBTOTAL = r"TO COLLECTION|TO SUMMARY|SUB-?TOTAL|SUB\s+TOTAL|CARRIED FORWARD|BROUGHT FORWARD|C/?F(?:WD)?|B/?F(?:WD)?|PAGE TOTAL|SHEET TOTAL|TOTAL[\s\-]+(?:CARRIED|BROUGHT)\s|AMOUNT[\s\-]*(?:CARRIED|BROUGHT)[\s\-\w]*|CARRIED TO (?:SUMMARY|COLLECTION|BILL)"
FIGURE = r"(\s+AED)?(\s*:?\s*[\d,\.]*)?"


def is_subtotal(label: Column) -> Column:
    """Whether a row's label only carries a sum over: a known label, or one of the patterns, then perhaps a currency, a
    colon and a figure. A total carried or brought may have any spaces and hyphens between its words."""
    upper = F.regexp_replace(F.upper(label), r"(?U)^\s+|\s+$", "")
    return F.coalesce(upper.isin(*SUBTOTALS) | upper.rlike(f"(?iU)^({SUBTOTAL}){FIGURE}$"), F.lit(False))


def is_junk(description: Column, qty: Column, rate: Column, amount: Column, raw: Column) -> Column:
    """Whether a row has neither a figure that counts nor a text that tells what is priced."""
    told = F.coalesce(F.trim(description) != "", F.lit(False))
    figures = amount.isNotNull() | (qty.isNotNull() & rate.isNotNull())
    return ~(figures | (qty.isNotNull() & told) | (F.coalesce(raw != "", F.lit(False)) & told))


def sheet_kind(name: Column) -> Column:
    upper = F.upper(name)
    return F.when(upper.rlike("SUMMARY|BILL 1-SUM|TOTALS"), "summary").when(upper.rlike("FLY|COVER|INDEX|PREAMBLE"), "skip").otherwise("content")


# Entities by name; others are decoded by their number.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "middot": "·", "eacute": "é", "amp": "&"}


def html_text(html: Column) -> Column:
    """A page's text by patterns: scripts, styles, comments and tags go, entities are decoded, white space collapses."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|<[^>]*>", " ")
    # a text's numbered entities, each once
    numbers = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), 1))

    def decoded(text: Column, n: Column) -> Column:
        code = F.when(F.lower(F.substring(n, 1, 1)) == "x", F.conv(F.substring(n, 2, 9), 16, 10)).otherwise(n).cast("int")
        low = F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), F.when(code.between(32, 0xD7FF) | code.between(0xE000, 0x10FFFF), low).otherwise(" "))

    out = F.aggregate(numbers, bare, decoded)
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def incremental_diff(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """Sources to read again: new ones, ones whose record is malformed (no size, or neither etag nor time), and ones
    whose etag and size, or else size and time, changed; all of them by `force`."""
    if force:
        return new
    before = old.select("source_key", F.col("etag").alias("_etag"), F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    tagged = F.col("etag").isNotNull() & F.col("_etag").isNotNull()
    same = F.when(tagged, (F.col("etag") == F.col("_etag")) & (F.col("size") == F.col("_size"))).otherwise((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")))
    return new.join(before, "source_key", "left").filter(~F.coalesce(same, F.lit(False))).select(*new.columns)


def normalize_name(name: Column) -> Column:
    """A file's name for comparison: straight quotes, single spaces, lower case; punctuation stays."""
    quoted = F.translate(name, "’‘'", '"""')
    return F.lower(F.trim(F.regexp_replace(quoted, r"(?U)\s+", " ")))


def stem(name: Column) -> Column:
    """A file's name without its last extension, in lower case; a leading point begins none."""
    return F.regexp_replace(F.lower(F.trim(name)), r"^(.*[^./]\.*)\.[^./]*$", "$1")


def source_key(key: Column, company: str | None = None) -> Column:
    """A key decoded, with plain slashes and spaces, in lower case, without scheme and bucket, and without a company's
    two leading folders."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.trim(key), F.lit("+"), F.lit("%2B"))), F.trim(key))
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.replace(decoded, F.lit("\\"), F.lit("/")), "(?<!:)/+", "/"), r"\s+", " ")))
    path = F.when(F.contains(bare, F.lit("://")), F.regexp_replace(bare, "^.*?://[^/]*/?", "")).otherwise(bare)
    if company is None:
        return path
    parts = F.split(path, "/")
    return F.when(path.startswith(company.strip().lower() + "/") & (F.size(parts) >= 3), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/")).otherwise(path)


def parse_uri(uri: Column) -> Column:
    """scheme, bucket and key of an address; null for anything else."""
    part = lambda n: F.regexp_extract(uri, r"^([a-z][a-z0-9+.-]*)://([^/]+)/?(.*)$", n)
    return F.when(part(1) != "", F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def key_url(key: Column, endpoint: str) -> Column:
    """A key's address: each folder's name percent-encoded, spaces as %20."""
    return F.concat(F.lit(endpoint.rstrip("/") + "/"), F.array_join(F.transform(F.split(key, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))


def object_name(name: Column) -> Column:
    """A name of letters, digits, points, lines and hyphens, of at most 200 characters."""
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, 200)


def continued(name: Column) -> Column:
    return F.coalesce(F.upper(name).rlike(r"\(CONT'?D?\)"), F.lit(False))


def sanitize(text: Column, most: int = 500_000) -> Column:
    """Plain line ends, no byte order mark, trimmed; what is beyond the most characters gives way to a mark."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "^﻿", "")
    bare = F.regexp_replace(plain, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("\n\n[... truncated for extraction ...]"))).otherwise(bare)


def shorten(text: Column, most: int) -> Column:
    """Control characters and runs of spaces become one space; cut at the last word that fits."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]", " "), r"\s+", " "))
    cut = F.regexp_replace(F.substring(bare, 1, most + 1), r"\s\S*$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(F.substring(cut, 1, most))


def pipe_text(cells: Column, most: int = 6) -> Column:
    """The first cells of a row that aren't blank, between bars."""
    return F.array_join(F.transform(F.filter(F.slice(cells, 1, most), lambda c: F.trim(c) != ""), lambda c: F.trim(c)), " | ")


def csv_line(cells: Column) -> Column:
    """One row of cells as CSV; a cell with a comma, quote or line end is quoted, and its quotes are doubled."""
    quoted = F.transform(cells, lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.array_join(quoted, ",")


def markdown_tables(text: Column) -> Column:
    """The Markdown tables of a text as CSV texts: the head and all rows; empty cells go."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text, F.lit("\n")), F.lit(r"\n((?:\|[^\n]+\|\n)+\|[-:]+[-|\s:]*\|\n(?:\|[^\n]+\|\n?)+)"), 1)
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")

    def table(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
        rows = F.filter(F.transform(F.concat(F.slice(lines, 1, 1), F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(1)))), cells), lambda r: F.size(r) > 0)
        return F.concat(F.array_join(F.transform(rows, csv_line), "\r\n"), F.lit("\r\n"))

    return F.transform(found, table)


def categories(category: Column, key: Column) -> Column:
    """The tools that a document belongs to, by its category and source key."""
    c, k = F.lower(F.coalesce(category, F.lit(""))), F.lower(F.coalesce(key, F.lit("")))
    has = lambda x, s: F.contains(x, F.lit(s))
    found = F.array(F.when(has(k, "comm_rfp") | has(c, "commercial"), F.lit("comm_rfp")), F.when(has(k, "tech_rfp") | has(c, "tech"), F.lit("tech_rfp")), F.when(has(c, "contract") | has(k, "/contract/"), F.lit("contract")))
    return F.array_compact(found)


def scrub_json(raw: Column) -> Column:
    """Common faults of written JSON mended: broken array ends, trailing commas, missing and repeated braces, control
    characters. Twice is as good as once."""
    out = F.regexp_replace(raw, r"\},\s*\],\s*\{", "}, {")
    out = F.regexp_replace(out, r",\s*([\]}])", "$1")
    out = F.regexp_replace(out, r'("pageNumber"\s*:\s*\d+)\s*\]', "$1}\n]")
    out = F.regexp_replace(out, r"\}\s*\}\s*\}\s*$", "}}")
    return F.regexp_replace(out, r"(?<!\\)[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def cut_to_brackets(raw: Column) -> Column:
    """A JSON text that was cut off, up to its last bracket, with as many brackets as lack one added, square ones first;
    null where more are closed than opened. Brackets within strings count like others."""
    lacking = lambda one, other: F.length(F.replace(raw, F.lit(other), F.lit(""))) - F.length(F.replace(raw, F.lit(one), F.lit("")))
    kept = F.regexp_extract(raw, r"(?s)^(.*[}\]])", 1)
    left = lambda one, other: F.length(F.replace(kept, F.lit(other), F.lit(""))) - F.length(F.replace(kept, F.lit(one), F.lit("")))
    sound = (lacking("{", "}") >= 0) & (lacking("[", "]") >= 0) & (kept != "")
    return F.when(sound, F.concat(kept, F.repeat(F.lit("]"), left("[", "]")), F.repeat(F.lit("}"), left("{", "}"))))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. The parser stops at the end of a value, so what stands around it tells
    whether anything follows."""
    return (F.trim(text) != "") & F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def tolerant_json(raw: Column) -> Column:
    """The JSON in a text: the text itself, else from its first brace to its last, else the text cut back to its last
    bracket with what is open closed; null where none of them parses."""
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    candidates = (bare, F.regexp_extract(bare, r"(?s)(\{.*\})", 1), cut_to_brackets(bare))
    return F.coalesce(*(F.when(is_json(c), c) for c in candidates))


def unwrap_result(raw: Column, depth: int = 3) -> Column:
    """What lies in a JSON's nested `result` or `data` fields, up to a depth."""
    for _ in range(depth):
        raw = F.coalesce(F.get_json_object(raw, "$.result"), F.get_json_object(raw, "$.data"), raw)
    return raw


def first_filled(*columns: Column) -> Column:
    """The first of several fields that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


# What the head of a column says it holds, in the order that decides.
COLUMN_KINDS = {
    "item_id": r"item|no|number|id|code|ref|s/?n|#",
    "description": r"desc|particulars|specification|work\s*item|scope",
    "quantity": r"qty|quan",
    "unit": r"unit|uom|u/?m",
    "rate": r"rate|price|unit\s*cost",
    "amount": r"amount|total|value|sum",
}


def column_kind(head: Column) -> Column:
    """The kind of a column by its head: the first that matches; else unknown."""
    lowered = F.lower(F.trim(head))
    kind = F.lit("unknown")
    for name, pattern in reversed(COLUMN_KINDS.items()):
        kind = F.when(F.coalesce(lowered.rlike(pattern), F.lit(False)), name).otherwise(kind)
    return kind


def is_header(cells: Column) -> Column:
    """Whether a row names columns: three cells or more, and two matches of kinds or more."""
    filled = F.filter(F.transform(cells, lambda c: F.lower(F.trim(c))), lambda c: c != "")
    hits = F.aggregate(filled, F.lit(0), lambda n, c: n + sum((c.rlike(p).cast("int") for p in COLUMN_KINDS.values()), F.lit(0)))
    return (F.size(filled) >= 3) & (hits >= 2)


def row_kind(cells: Column, quantity: Column, description: Column) -> Column:
    """division, grouping, item or other: by how many cells are filled, how their text begins, and whether there is a
    quantity, or a description in three cells or more."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    n, text = F.size(filled), F.array_join(filled, " ")
    upper = F.upper(text)
    division = (n <= 2) & (upper.rlike("DIVISION|SECTION|WORK|PART") | (F.length(text) > 5))
    grouping = (n <= 3) & (text.rlike(r"^[A-Za-z][.)]\s+\w+") | text.rlike(r"^\d+\.\d+\s+\w+"))
    item = F.coalesce(safe_float(quantity).isNotNull(), F.lit(False)) | (F.coalesce(description != "", F.lit(False)) & (n >= 3))
    return F.when(division, "division").when(grouping, "grouping").when(item, "item").otherwise("other")
