"""A content sheet cut into its divisions by the names that its summary gives them.

Lines are rows (doc, line_no, line), names rows (doc, ord, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of a division that goes on, the two written forms of a header, and by how many characters a bare
# header may be longer than the name.
CONTINUED = ("CONT'D", "CONT)", "(CONTINUED)")
SECTION = r"^SECTION\s+[A-Z]\s*:\s*"
BILL = r"^BILL\s*(?:NO\.?)?\s*\d+\s*[-–:]\s*(.+)$"
LONGER = 25

#: Names that one summary may give; more are an error.
MOST_NAMES = 10_000


#: What `\\s` matches in Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def header_lines(lines: DataFrame) -> DataFrame:
    """Lines as headers: `_bare` without bars and spaces around, `_section` and `_bill` what follows such a mark; lines of
    a division that goes on are left out."""
    bare = stripped(F.btrim(stripped(F.upper(F.coalesce("line", F.lit("")))), F.lit("|")))
    # as a generated row, so that it is computed once for all that is asked of it
    rows = lines.select("doc", "line_no", F.inline(F.array(F.struct(bare.alias("_bare"))))).filter("_bare <> ''")
    for mark in CONTINUED:
        rows = rows.filter(~F.contains("_bare", F.lit(mark)))
    headed = lambda word, form: F.startswith("_bare", F.lit(word)) & F.col("_bare").rlike(form)
    section = F.when(headed("SECTION", SECTION), stripped(F.regexp_replace("_bare", SECTION, "")))
    bill = F.when(headed("BILL", BILL), stripped(F.regexp_extract("_bare", BILL, 1)))
    return rows.select("doc", "line_no", "_bare", section.alias("_section"), bill.alias("_bill"))


def name_forms(names: DataFrame) -> DataFrame:
    """doc, ord, name, full (in capitals), key (what follows its last colon); names without a key are left out."""
    full = stripped(F.upper("name"))
    return names.select("doc", "ord", "name", full.alias("full"), stripped(F.element_at(F.split(full, ":"), -1)).alias("key")).filter("key <> ''")


def division_starts(lines: DataFrame, names: DataFrame) -> DataFrame:
    """doc, ord, name, key, tier, start: the line where each name's division begins. A line `Section X: name` counts
    before `Bill n - name`, and that before a short line that holds the name; of one kind the first line counts. Of names
    with one key the first that is found stays.

    A document's names go to its lines as one array, so a line is a row once, whatever it holds, and only hits are
    exploded. All steps go by document, so lines and names are shuffled once at most. A text that holds a name in full
    holds its key, and what follows a mark is part of the line, so names whose key the line doesn't hold are passed over."""
    forms = name_forms(names)
    listed = F.collect_list(F.struct("ord", "name", "key", F.length("full").alias("size")))
    listed = F.when(F.count(F.lit(1)) > MOST_NAMES, F.raise_error(F.lit(f"more than {MOST_NAMES} names of one document"))).otherwise(listed)
    patterns = forms.groupBy("doc").agg(listed.alias("_names"), F.max(F.length("full")).alias("_longest"))
    possible = F.coalesce("_section", "_bill").isNotNull() | (F.length("_bare") < F.col("_longest") + LONGER)
    rows = header_lines(lines).join(patterns, "doc").filter(possible)
    held = F.filter("_names", lambda n: F.contains("_bare", n["key"]))
    rows = rows.select("doc", "line_no", "_bare", "_section", "_bill", F.inline(held))
    tier = F.when(F.contains("_section", "key"), 1).when(F.contains("_bill", "key"), 2).when(F.length("_bare") < F.col("size") + LONGER, 3)
    at = [F.min(F.when(tier == k, F.col("line_no"))).alias(f"_at{k}") for k in (1, 2, 3)]
    first = rows.groupBy("doc", "ord", "name", "key").agg(*at).filter(F.coalesce("_at1", "_at2", "_at3").isNotNull())
    kind = F.when(F.col("_at1").isNotNull(), 1).when(F.col("_at2").isNotNull(), 2).otherwise(3)
    found = first.select("doc", "ord", "name", "key", kind.alias("tier"), F.coalesce("_at1", "_at2", "_at3").alias("start"))
    own = F.row_number().over(Window.partitionBy("doc", "key").orderBy("ord"))
    return found.withColumn("_own", own).filter("_own = 1").drop("_own")


def division_segments(lines: DataFrame, names: DataFrame) -> DataFrame:
    """doc, name, tier, start, stop (null for the last), text: from each division's line to the next one's. Documents in
    which fewer than two are found have none, and of two on one line the later name has it."""
    order = Window.partitionBy("doc").orderBy("start", "ord")
    starts = division_starts(lines, names).withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy("doc")), "stop": F.lead("start").over(order)})
    starts = starts.filter((F.col("_n") > 1) & (F.col("stop").isNull() | (F.col("stop") > F.col("start"))))
    listed = starts.groupBy("doc").agg(F.collect_list(F.struct("name", "tier", "start", "stop")).alias("_divisions"))
    holds = lambda x: (x["start"] <= F.col("line_no")) & (x["stop"].isNull() | (F.col("line_no") < x["stop"]))
    held = lines.select("doc", "line_no", F.coalesce("line", F.lit("")).alias("line")).join(listed, "doc")
    parts = held.select("doc", "line_no", "line", F.get(F.filter("_divisions", holds), F.lit(0)).alias("_in")).filter("_in IS NOT NULL")
    parts = parts.groupBy("doc", "_in").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = stripped(F.array_join(F.col("_lines.line"), "\n"))
    return parts.select("doc", "_in.*", text.alias("text")).filter("text <> ''")


# Division names that a sheet's head may hold, in the order that decides; how much of a sheet is its head;
# what a given name looks like that is only a sheet's code; a bill's and a bare header's forms.
KNOWN = (
    "SITE WORK", "SITEWORK", "SITE WORKS", "CONCRETE WORK", "CONCRETE WORKS", "CONCRETEWORK", "MASONRY", "MASONRY WORK", "METALWORK", "METAL WORK", "STRUCTURAL STEEL",
    "WOODWORK", "WOOD WORK", "CARPENTRY", "JOINERY", "THERMAL & MOISTURE PROTECTION", "THERMAL AND MOISTURE PROTECTION", "WATERPROOFING", "INSULATION",
    "DOORS AND WINDOWS", "DOORS & WINDOWS", "WINDOWS AND DOORS", "FINISHES", "FINISHING", "FINISH WORK", "ACCESSORIES", "SPECIALTIES", "EQUIPMENT", "SPECIAL EQUIPMENT",
    "CONVEYING SYSTEM", "CONVEYING SYSTEMS", "ELEVATORS", "LIFTS", "MECHANICAL ENGINEERING", "MECHANICAL WORKS", "HVAC", "PLUMBING",
    "ELECTRICAL ENGINEERING", "ELECTRICAL WORKS", "ELECTRICAL", "ALTERNATIVE", "ALTERNATIVES", "PROVISIONAL SUMS", "EXTERNAL WORKS", "LANDSCAPING",
)
HEAD_CHARS = 2000
CODE = r"(?i)^[\d#].*[-]|^Bill\s*\d+$"
BILL_NAME = r"BILL\s*(?:NO\.?)?\s*\d+\s*[-–:]\s*([A-Z][A-Z\s&]+)"
BARE_NAME = r"(?m)^([A-Z]{4,}(?:\s+[A-Z&]{2,})*)\s*$"


def resolved_divisions(sheets: DataFrame, names: DataFrame) -> DataFrame:
    """doc, division, tier: a name for each sheet (doc, sheet_name, text, given), by the first that there is: 1 the given
    name, unless it is a code; 2 the summary's only name that the text holds; 3 a known name in the sheet's head; 4 a
    bill's name there; 5 a line of capitals there; 6 the sheet's own name. But for the second, the name gives way to the
    summary's first one that equals it, holds it or is held by it, whatever the case. Summary names are rows (doc, ord,
    name), at most MOST_NAMES of a document; empty ones don't count, and a sheet may have none."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "name", F.upper("name").alias("key"))))
    listed = F.when(F.count(F.lit(1)) > MOST_NAMES, F.raise_error(F.lit(f"more than {MOST_NAMES} names of one document"))).otherwise(listed)
    own = names.filter("name <> ''").groupBy("doc").agg(listed.alias("_names"))
    rows = sheets.join(own, "doc", "left").withColumn("_names", F.coalesce("_names", F.array().cast(dict(own.dtypes)["_names"])))
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"_upper": F.upper(text), "_head": F.upper(F.substring(text, 1, HEAD_CHARS)), "_given": stripped(F.coalesce("given", F.lit("")))})
    filled = lambda c: F.when(c != "", c)
    held = F.filter("_names", lambda n: F.contains("_upper", n["key"]))
    chain = F.array(
        F.struct(F.lit(1).alias("tier"), F.when((F.col("_given") != "") & ~F.col("_given").rlike(CODE), F.col("_given")).alias("name")),
        F.struct(F.lit(2).alias("tier"), F.when(F.size(held) == 1, F.get(held, F.lit(0))["name"]).alias("name")),
        F.struct(F.lit(3).alias("tier"), F.get(F.filter(F.array(*map(F.lit, KNOWN)), lambda k: F.contains("_head", k)), F.lit(0)).alias("name")),
        F.struct(F.lit(4).alias("tier"), filled(stripped(F.regexp_extract("_head", BILL_NAME, 1))).alias("name")),
        F.struct(F.lit(5).alias("tier"), filled(stripped(F.regexp_extract("_head", BARE_NAME, 1))).alias("name")),
        F.struct(F.lit(6).alias("tier"), F.coalesce("sheet_name", F.lit("")).alias("name")),
    )
    rows = rows.withColumn("_pick", F.get(F.filter(chain, lambda c: c["name"].isNotNull()), F.lit(0)))
    key = stripped(F.upper(F.col("_pick.name")))
    alike = F.get(F.filter("_names", lambda n: F.contains(n["key"], key) | F.contains(key, n["key"])), F.lit(0))["name"]
    name = F.when((F.col("_pick.tier") == 2) | (F.col("_pick.name") == ""), F.col("_pick.name")).otherwise(F.coalesce(alike, F.col("_pick.name")))
    return rows.select("doc", name.alias("division"), F.col("_pick.tier").alias("tier"))
