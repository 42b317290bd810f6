"""Documents, their parts, lines and keys over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import fuzzy, text
from tallyspark.operators import documents
from tallyspark.sources import tables
from tallyspark.sources.tables import load

from .register import query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def digest(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


@query(r"SELECT doc_id, sha256(lower(trim(regexp_replace(replace(replace(replace(text, '’', '\"'), '‘', '\"'), '''', '\"'), '\s+', ' ', 'g')))) AS digest FROM documents")
def txt_name_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", digest(text.normalize_name(F.col("text"))).alias("digest"))


@query(r"SELECT page_id, regexp_replace(lower(trim(url || CASE page_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '/.hidden' ELSE '.PDF ' END)), '^(.*[^./]\.*)\.[^./]*$', '\1') AS stem FROM pages")
def txt_stem(spark, sf_dir):
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".tar.gz").when(F.col("page_id") % 3 == 1, "/.hidden").otherwise(".PDF "))
    return load(spark, sf_dir, "pages").select("page_id", text.stem(name).alias("stem"))


@query(f"SELECT {LINE}, CASE WHEN l_returnflag = 'A' THEN 'vendor ' || l_suppkey || '/bid 1.pdf' ELSE l_partkey || '/bid.pdf' END AS key FROM lineitem")
def txt_source_key(spark, sf_dir):
    given = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("s3://Bucket//Vendor%20"), F.col("l_suppkey").cast("string"), F.lit("\\Bid  1.PDF "))).otherwise(F.concat(F.lit("Acme/P7/"), F.col("l_partkey").cast("string"), F.lit("//bid.pdf")))
    return lines(spark, sf_dir).select(*KEYS, text.source_key(given, "ACME").alias("key"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]+)/?(.*)$', 2) AS bucket, regexp_extract(url, '^([a-z][a-z0-9+.-]*)://([^/]+)/?(.*)$', 3) AS key FROM pages WHERE url LIKE '%://%'")
def src_parse_uri(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.parse_uri(F.col("url")).alias("u")).filter("u IS NOT NULL").select("page_id", "u.*")


@query(f"SELECT {LINE}, 'https://files/' || l_returnflag || '%20x/' || l_partkey || '%26.pdf' AS url, l_returnflag || '_x_' || l_partkey || '_.pdf' AS name FROM lineitem")
def src_key_url(spark, sf_dir):
    key = F.concat("l_returnflag", F.lit(" x/"), F.col("l_partkey").cast("string"), F.lit("&.pdf"))
    return lines(spark, sf_dir).select(*KEYS, text.key_url(key, "https://files/").alias("url"), text.object_name(key).alias("name"))


@query(f"SELECT {LINE}, l_linenumber % 3 <> 2 AS continued FROM lineitem")
def boq_continued(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    name = F.concat(F.lit("Bill "), F.col("l_partkey").cast("string"), F.when(n == 0, " (Cont'd)").when(n == 1, " (CONT) p 2").otherwise(" continued"))
    return lines(spark, sf_dir).select(*KEYS, text.continued(name).alias("continued"))


@query(r"SELECT doc_id, sha256(CASE WHEN length(t) > 3000 THEN t[:3000] || chr(10) || chr(10) || '[... truncated for extraction ...]' ELSE t END) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)")
def txt_sanitize(spark, sf_dir):
    given = F.concat(F.lit("﻿\r\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")), F.lit(" \r"))
    return load(spark, sf_dir, "documents").select("doc_id", digest(text.sanitize(given, 3000)).alias("digest"))


@query()
def txt_shorten(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text"), 2000).alias("text"))


@query(f"SELECT {LINE}, l_orderkey || ' | ' || l_returnflag || ' | ' || l_quantity::INT || ' | ' || l_linestatus AS line FROM lineitem")
def src_pipe_text(spark, sf_dir):
    cells = F.array(F.col("l_orderkey").cast("string"), F.lit(" "), "l_returnflag", F.lit(None).cast("string"), F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit(" "), "l_linestatus"), F.lit("beyond"))
    return lines(spark, sf_dir).select(*KEYS, text.pipe_text(cells).alias("line"))


@query("SELECT l_orderkey, 'Item,Qty' || chr(13) || chr(10) || string_agg('\"P, \"\"' || l_partkey || '\"\"\",' || l_quantity::INT || chr(13) || chr(10), '' ORDER BY l_linenumber, l_partkey, l_quantity) AS csv FROM lineitem GROUP BY 1")
def txt_md_table(spark, sf_dir):
    row = F.concat(F.lit('| P, "'), F.col("l_partkey").cast("string"), F.lit('" | | '), F.col("l_quantity").cast("int").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", row.alias("row")))), lambda r: r["row"]), "\n")
    shown = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.concat(F.lit("An answer:\n| Item | Qty |\n|---|:-:|\n"), rows, F.lit("\nand more | text")).alias("text"))
    return shown.select("l_orderkey", F.explode(text.markdown_tables(F.col("text"))).alias("csv"))


@query(f"SELECT {LINE}, CASE l_linenumber WHEN 1 THEN 'comm_rfp' WHEN 2 THEN 'tech_rfp' WHEN 3 THEN 'contract' WHEN 4 THEN 'comm_rfp,contract' ELSE '' END AS categories FROM lineitem")
def txt_categories(spark, sf_dir):
    n = F.col("l_linenumber")
    kind = F.when((n == 1) | (n == 4), "CommercialRFP").when(n == 2, "TechRFP").when(n > 4, "other")
    key = F.when((n == 3) | (n == 4), F.concat(F.lit("a/Contract/"), F.col("l_partkey").cast("string"))).when(n < 6, "x")
    return lines(spark, sf_dir).select(*KEYS, F.array_join(text.categories(kind, key), ",").alias("categories"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '{"a": [' || props || ']}' WHEN 3 THEN '{"a": {"x": ' || props || '}}' WHEN 4 THEN '{"d": [{"n": ' || props || '}]}' WHEN 7 THEN '[' || props || ']' END AS json FROM events""")
def txt_json_repair(spark, sf_dir):
    """Whole, wrapped, and cut in a string, after a colon, in a list's next object; no object; one cut inside a string that
    holds a bracket, which isn't mended; a list."""
    say = lambda before, after: F.concat(F.lit(before), F.col("props"), F.lit(after))
    forms = F.array(F.col("props"), say("Here: ", " done."), say('{"a": [', ', {"b": "cut off'), say('{"a": {"x": ', '}, "b":'), say('{"d": [{"n": ', '}, {"n":'), F.lit("no object"), say('{"a": ', ', "b": "cut } off'), say(" [", "] "))
    given = F.element_at(forms, (F.col("event_id") % 8 + 1).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", text.tolerant_json(given).alias("json"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '[' || props || ', {\"pageNumber\": 3}' || chr(10) || ']' AS scrubbed FROM events")
def txt_json_scrub(spark, sf_dir):
    given = F.concat(F.lit("["), "props", F.lit(', {"pageNumber": 3, ]'))
    broken = F.concat(F.lit("["), "props", F.lit(', {"pageNumber": 3]'))
    rows = load(spark, sf_dir, "events").select("event_id", text.scrub_json(given).alias("once"), text.scrub_json(text.scrub_json(broken)).alias("scrubbed"))
    return rows.select("event_id", F.get_json_object(F.regexp_extract("once", r"^\[(\{[^}]*\})", 1), "$.k").alias("k"), "scrubbed")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def txt_unwrap(spark, sf_dir):
    given = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"result": '), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"result": {"data": '), "props", F.lit("}}")))
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object(text.unwrap_result(given), "$.k").alias("k"))


@query(f"SELECT {LINE}, CASE WHEN l_tax > 0.04 THEN 'a' || l_partkey WHEN l_quantity > 20 THEN 'b' || l_suppkey ELSE 'c' || l_linenumber END AS id FROM lineitem")
def boq_key_alias(spark, sf_dir):
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    return lines(spark, sf_dir).select(*KEYS, text.first_filled(F.when(F.col("l_tax") > 0.04, mark("a", "l_partkey")).otherwise(""), F.when(F.col("l_quantity") > 20, mark("b", "l_suppkey")), mark("c", "l_linenumber")).alias("id"))


HEADS = ("Item No.", "Description of Work", "Qty", "UOM", "Unit Price", "Total AED", "Remark")


@query(f"SELECT {LINE}, ['item_id', 'description', 'quantity', 'unit', 'unit', 'amount', 'unknown'][l_linenumber] AS kind, l_linenumber <= 5 AS header FROM lineitem")
def boq_column_kinds(spark, sf_dir):
    n = F.col("l_linenumber")
    head = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, HEADS)), n), F.lit(" "))
    cells = F.array(head, F.when(n <= 3, "Rate"), F.when(n == 4, F.lit("Sum")).otherwise(F.lit("Box")), F.lit("Tray"), F.when(n > 6, "x"))
    return lines(spark, sf_dir).select(*KEYS, text.column_kind(head).alias("kind"), text.is_header(cells).alias("header"))


@query(f"SELECT {LINE}, CASE WHEN l_linenumber IN (1, 2) THEN 'division' WHEN l_linenumber = 3 THEN 'grouping' WHEN l_linenumber IN (4, 5) THEN 'item' WHEN l_linenumber = 6 AND l_tax > 0.04 THEN 'item' ELSE 'other' END AS kind FROM lineitem")
def boq_row_kinds(spark, sf_dir):
    n = F.col("l_linenumber")
    first = F.when(n == 1, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).when(n == 2, "CIVIL WORKS").when(n == 3, "1.2 Doors").otherwise(F.col("l_partkey").cast("string"))
    quantity = F.when((n == 4) | (n == 5), F.col("l_quantity").cast("string")).when(n == 7, "n/a")
    described = F.when((n == 6) & (F.col("l_tax") > 0.04), "a pipe")
    cells = F.array(first, F.when(n > 2, "m"), F.when(n > 2, "z"), F.when(n > 3, "y"))
    return lines(spark, sf_dir).select(*KEYS, text.row_kind(cells, quantity, described).alias("kind"))


@query("SELECT l_orderkey AS doc, count(*) * 1000 || '.50' AS total FROM lineitem GROUP BY 1")
def boq_carried_total(spark, sf_dir):
    own = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("n"))
    shown = F.array(F.lit("Item | 7"), F.lit("Total - Carried to Bill Summary | 5"), F.concat(F.lit("TOTAL CARRIED TO BILL SUMMARY | AED | "), F.format_number(F.col("n") * 1000, 0), F.lit(".50 | ")), F.lit("carried to general summary: none"))
    return documents.carried_totals(own.select("doc", F.posexplode(shown).alias("line_no", "line")))


STATES = """WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line_no, CASE WHEN l_tax > 0.06 THEN 'D' || l_partkey END AS d, CASE WHEN l_tax <= 0.06 AND l_discount > 0.07 THEN 'G' || l_suppkey END AS g, CASE WHEN l_tax <= 0.06 AND l_discount BETWEEN 0.05 AND 0.07 THEN 'S' || l_suppkey END AS s FROM lineitem)
"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lines(spark, sf_dir).withColumns({"doc": F.col("l_orderkey"), "line_no": at})


@query("""SELECT doc, line_no, (SELECT first(d ORDER BY x.line_no DESC) FROM l x WHERE x.doc = l.doc AND x.line_no <= l.line_no AND d IS NOT NULL) AS division,
 (SELECT first(g ORDER BY x.line_no DESC) FROM l x WHERE x.doc = l.doc AND x.line_no <= l.line_no AND g IS NOT NULL AND x.line_no > coalesce((SELECT max(y.line_no) FROM l y WHERE y.doc = l.doc AND y.line_no <= l.line_no AND y.d IS NOT NULL), 0)) AS "grouping",
 (SELECT first(s ORDER BY x.line_no DESC) FROM l x WHERE x.doc = l.doc AND x.line_no <= l.line_no AND s IS NOT NULL AND x.line_no > coalesce((SELECT max(y.line_no) FROM l y WHERE y.doc = l.doc AND y.line_no <= l.line_no AND (y.d IS NOT NULL OR y.g IS NOT NULL)), 0)) AS sub_group, coalesce(d, g, s) IS NOT NULL AS header FROM l""", STATES)  # fmt: skip
def boq_state_machine(spark, sf_dir):
    high, off = F.col("l_tax") > 0.06, F.col("l_discount")
    mark = lambda m, c: F.concat(F.lit(m), F.col(c).cast("string"))
    out = documents.line_states(numbered(spark, sf_dir), F.when(high, mark("D", "l_partkey")), F.when(~high & (off > 0.07), mark("G", "l_suppkey")), F.when(~high & off.between(0.05, 0.07), mark("S", "l_suppkey")))
    return out.select("doc", "line_no", "division", "grouping", "sub_group", "header")


@query(", f AS (SELECT doc, line_no, d, d IS NULL AS lacking FROM l) SELECT doc, line_no, CASE WHEN lacking THEN printf('ITM-%04d', sum(lacking::INT) OVER (PARTITION BY doc ORDER BY line_no)) ELSE d END AS item_id FROM f", STATES)
def boq_item_ids(spark, sf_dir):
    given = numbered(spark, sf_dir).withColumn("item_id", F.when(F.col("l_tax") > 0.06, F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).when(F.col("line_no") % 2 == 0, " "))
    return documents.item_ids(given).select("doc", "line_no", "item_id")


@query("SELECT doc, d AS header, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY doc ORDER BY line_no), (SELECT max(line_no) + 1 FROM l x WHERE x.doc = h.doc)) AS stop FROM (SELECT * FROM l WHERE d IS NOT NULL) h", STATES)
def txt_segments(spark, sf_dir):
    given = numbered(spark, sf_dir).withColumn("line", F.when(F.col("l_tax") > 0.06, F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).otherwise("text"))
    return documents.segments(given, F.col("line").startswith("D"))


DOCS = "WITH d AS (SELECT source AS ctx, doc_id AS doc, doc_id AS ord, greatest(length(text) // 4, 1) AS tokens FROM documents) "


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("source").alias("ctx"), F.col("doc_id").alias("doc"), F.col("doc_id").alias("ord"), text.token_estimate(F.length("text")).alias("tokens"))


@query(DOCS + ", t AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx) - 2000 AS excess, floor(tokens * 0.8::DOUBLE)::BIGINT AS saving FROM d), b AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY ctx ORDER BY tokens DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t WHERE tokens >= 100) SELECT ctx, doc, tokens, saving FROM b WHERE excess > 0 AND before < excess")
def txt_plan_large(spark, sf_dir):
    return documents.plan_large(sized(spark, sf_dir), 2_000, 100)


@query(DOCS + ", t AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx) AS total, greatest(tokens - 12, 0) AS saving FROM d), b AS (SELECT *, total - coalesce(sum(saving) OVER (PARTITION BY ctx ORDER BY saving DESC, tokens DESC, ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM t) SELECT ctx, doc, saving FROM b WHERE rest > 3000 AND saving > 0")
def txt_greedy_truncate(spark, sf_dir):
    return documents.hard_cap(sized(spark, sf_dir), 3_000, 12)


@query(DOCS + ", b AS (SELECT *, sum(tokens) OVER (PARTITION BY ctx ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM d) SELECT ctx, doc, used FROM b WHERE used <= 15000")
def txt_fill_budget(spark, sf_dir):
    return documents.fill_budget(sized(spark, sf_dir), 15_000).select("ctx", "doc", "used")


@query()
def txt_batch_pack(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx"), F.col("turn").alias("ord"), F.col("turn").alias("doc"), text.token_estimate(F.length("text")).alias("tokens"))
    return documents.packed(rows, 60)


@query()
def txt_para_chunks(spark, sf_dir):
    return documents.paragraph_chunks(load(spark, sf_dir, "documents"), 2000)


@query("SELECT user_id AS \"user\", event_id, (SELECT sum(x.value::INT) FROM events x WHERE x.user_id = e.user_id AND epoch(x.ts)::BIGINT BETWEEN epoch(e.ts)::BIGINT - 86400 AND epoch(e.ts)::BIGINT)::BIGINT AS used FROM (SELECT *, epoch(ts) AS s FROM events) e".replace("epoch(x.ts)::BIGINT", "floor(epoch(x.ts))::BIGINT").replace("epoch(e.ts)::BIGINT", "floor(epoch(e.ts))::BIGINT"))
def txt_rolling_budget(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id", F.unix_timestamp("ts").alias("second"), F.rint("value").cast("int").alias("size"))
    return documents.within_window(rows, 86_400).select("user", "event_id", "used")


PARTS = """WITH parts AS (SELECT conv_id AS ctx, turn * 10 AS ord, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'inline' ELSE 'uri' END AS kind, text, length(text) * 7 AS bytes FROM conversations)
"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn") % 3
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx"), (F.col("turn") * 10).alias("ord"), F.when(n == 0, "text").when(n == 1, "inline").otherwise("uri").alias("kind"), "text", (F.length("text") * 7).alias("bytes"))


@query("SELECT ctx, count(*) AS total, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'uri') AS uri, count(*) FILTER (kind = 'inline') AS inline, coalesce(sum(bytes) FILTER (kind = 'inline'), 0)::BIGINT AS inline_bytes, sum(coalesce(CASE WHEN kind = 'inline' THEN (bytes + 2) // 3 * 4 ELSE strlen(text) END, 0))::BIGINT AS payload FROM parts GROUP BY 1", PARTS)
def part_counts(spark, sf_dir):
    return documents.part_counts(parts(spark, sf_dir))


@query("SELECT ctx, ord, bytes FROM parts WHERE kind = 'inline' AND bytes > 500", PARTS)
def part_offenders(spark, sf_dir):
    return documents.offenders(parts(spark, sf_dir), 500)


@query("SELECT ctx, sha256(string_agg(CASE kind WHEN 'text' THEN 'T|' || text WHEN 'uri' THEN 'U|' || text ELSE 'I|' || sha1(text) END, '' ORDER BY ord)) AS hash FROM parts GROUP BY 1", PARTS)
def part_hash(spark, sf_dir):
    return documents.content_hash(parts(spark, sf_dir))


@query("SELECT ctx, sha256(string_agg('k' || ord || '=' || bytes || ';', '' ORDER BY 'k' || ord || '=' || bytes || ';')) AS fingerprint FROM parts GROUP BY 1", PARTS)
def part_fingerprint(spark, sf_dir):
    return documents.source_fingerprint(parts(spark, sf_dir).select("ctx", F.concat(F.lit("k"), F.col("ord").cast("string")).alias("source_key"), F.col("bytes").cast("string").alias("version")))


@query("SELECT ctx AS doc, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM parts GROUP BY 1", PARTS)
def part_join(spark, sf_dir):
    return documents.joined_texts(parts(spark, sf_dir).withColumnRenamed("ctx", "doc"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a part of a document that every third turn opens and every sixth closes."""
    own = parts(spark, sf_dir).withColumn("kind", F.lit("text"))
    opens = own.filter("ord % 30 = 0").withColumns({"text": F.lit(" <Start of File: a.pdf> "), "ord": F.col("ord") - 1})
    closes = own.filter("ord % 60 = 30").withColumns({"text": F.lit("</End of File: a.pdf>"), "ord": F.col("ord") + 1})
    return own.unionByName(opens).unionByName(closes)


@query()
def part_documents(spark, sf_dir):
    return documents.parse_documents(tagged(spark, sf_dir)).select("ctx", "ord", "depth", "doc_at")


@query("SELECT ctx, greatest(count(*) FILTER (ord % 30 = 0), 1) AS documents FROM parts GROUP BY 1", PARTS)
def part_document_count(spark, sf_dir):
    return documents.document_count(tagged(spark, sf_dir))


@query(", m AS (SELECT *, CASE WHEN ord % 40 = 0 THEN 1 WHEN ord % 40 = 20 THEN 0 END AS mark FROM parts WHERE trim(text) <> ''), s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY ctx ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) AS inside FROM m) SELECT ctx, ord FROM s WHERE inside = 0 AND mark IS NULL", PARTS)
def part_drop_sections(spark, sf_dir):
    own = parts(spark, sf_dir).withColumn("kind", F.lit("text"))
    marked = own.withColumn("text", F.when(F.col("ord") % 40 == 0, F.lit("### BEGIN X")).when(F.col("ord") % 40 == 20, F.lit(" ### END X")).otherwise(F.col("text")))
    return documents.drop_sections(marked, "### BEGIN", "### END").filter("NOT text LIKE '%### END%'").select("ctx", "ord")


PAGES = "WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, sum(l_quantity)::BIGINT AS bytes, max(l_quantity) AS largest, count(*) AS images FROM lineitem GROUP BY ALL) "


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.sum("l_quantity").cast("long").alias("bytes"), F.count("*").alias("images"))


@query(PAGES + ", b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT doc, page, bytes FROM b WHERE before <= 60")
def page_until_budget(spark, sf_dir):
    return documents.until_budget(page_rows(spark, sf_dir), 60).select("doc", "page", "bytes")


@query("WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity AS area, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS largest FROM lineitem) SELECT doc, page FROM i WHERE area >= largest * 0.8::DOUBLE GROUP BY ALL HAVING count(*) >= 2")
def page_layered(spark, sf_dir):
    return documents.layered(lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("area")))


@query(PAGES + "SELECT doc, page FROM p WHERE bytes * 4 < 200 AND images >= 1")
def page_scanned(spark, sf_dir):
    return documents.scanned(page_rows(spark, sf_dir).withColumn("text", F.repeat(F.lit("x"), (F.col("bytes") * 4).cast("int"))))


@query("SELECT l_orderkey AS doc, md5(l_suppkey::VARCHAR) AS digest, min(l_linenumber) AS \"at\" FROM lineitem GROUP BY ALL")
def page_first_digests(spark, sf_dir):
    return documents.first_digests(lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.md5(F.col("l_suppkey").cast("string").cast("binary")).alias("digest"), F.col("l_linenumber").alias("at")))


@query("WITH n AS (SELECT source AS ctx, count(*) AS documents FROM documents GROUP BY 1) SELECT ctx, documents, 870000 AS target, greatest(50000, floor(870000 * greatest(0.15::DOUBLE, 0.4::DOUBLE / greatest(1.0::DOUBLE, documents / 10)))::BIGINT) AS per_document FROM n")
def ctx_dynamic_budget(spark, sf_dir):
    return documents.dynamic_budget(load(spark, sf_dir, "documents").groupBy(F.col("source").alias("ctx")).agg(F.count("*").alias("documents")), 900_000)


@query("WITH s AS (SELECT o_orderkey, 500000 AS chunk, 8000 AS summary, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 100000 END AS ceiling, greatest(0.05::DOUBLE, 1.0::DOUBLE / greatest(1.0::DOUBLE, o_totalprice / 100000) * pow(0.7::DOUBLE, o_orderkey % 4)) AS f FROM orders) SELECT o_orderkey, greatest(30000, floor(chunk * f)::BIGINT) AS chunk, greatest(3000, floor(summary * f)::BIGINT) AS summary, CASE WHEN ceiling > 0 THEN greatest(10000, floor(ceiling * f)::BIGINT) ELSE ceiling END AS ceiling FROM s")
def ctx_tighten(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.lit(500_000).alias("chunk"), F.lit(8_000).alias("summary"), F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise(100_000).alias("ceiling"), (F.col("o_orderkey") % 4 + 1).alias("step"), (F.col("o_totalprice") / 100_000).alias("overshoot"))
    return documents.tightened(rows).select("o_orderkey", "chunk", "summary", "ceiling")


@query("SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'cached' ELSE lang END AS text FROM documents")
def ctx_summaries(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") * 2).alias("key"), F.col("lang").alias("text"))
    return documents.summaries(own, own.filter("doc % 3 = 0").withColumn("summary", F.lit("new")), own.filter("doc % 5 = 0").withColumn("summary", F.lit("cached"))).select("doc", "text")


@query("SELECT o_orderkey AS source_key, CASE WHEN o_custkey % 3 <> 0 AND c_acctbal > 0 THEN c_name END AS summary FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def ctx_alias_lookup(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    contents = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("content_key"), F.col("c_name").alias("summary"))
    return documents.by_alias(orders.select(F.col("o_orderkey").alias("source_key")), orders.filter("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("source_key"), F.col("o_custkey").alias("content_key")), contents).select("source_key", "summary")


@query("SELECT l_orderkey AS doc, l_partkey AS part, min(CASE WHEN l_returnflag = 'A' THEN 'old' ELSE 'xnew' END) AS origin FROM lineitem GROUP BY ALL")
def ctx_append(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("part"), (F.col("l_returnflag") == "A").alias("old"))
    held = rows.filter("old").select("doc", "part").distinct().withColumn("origin", F.lit("old"))
    return documents.append_parts(held, rows.filter("NOT old").select("doc", "part").withColumn("origin", F.lit("xnew")))


@query("WITH f AS (SELECT l_orderkey AS folder, CASE l_linenumber WHEN 2 THEN 'My Template ' WHEN 3 THEN 'a boq ' WHEN 4 THEN 'pte ' ELSE 'file ' END || l_partkey AS name, l_linenumber * 100000 + l_partkey AS ord FROM lineitem) SELECT folder, first(name ORDER BY CASE WHEN name LIKE '%Template%' THEN 0 WHEN name LIKE '%boq%' THEN 1 ELSE 2 END, name) AS template, first(name ORDER BY ord) FILTER (contains(name, 'pte')) AS benchmark, min(name) AS first FROM f GROUP BY 1")
def src_pick_files(spark, sf_dir):
    n = F.col("l_linenumber")
    name = F.concat(F.when(n == 2, "My Template ").when(n == 3, "a boq ").when(n == 4, "pte ").otherwise("file "), F.col("l_partkey").cast("string"))
    return documents.pick_template(lines(spark, sf_dir).select(F.col("l_orderkey").alias("folder"), name.alias("name"), (n * 100000 + F.col("l_partkey")).alias("ord")))


@query("SELECT o_custkey % 20 AS doc, o_orderpriority AS sheet, o_orderkey AS line FROM orders QUALIFY dense_rank() OVER (PARTITION BY doc ORDER BY sheet) <= 3 AND row_number() OVER (PARTITION BY doc, sheet ORDER BY line) <= 40")
def src_sheet_caps(spark, sf_dir):
    return documents.best_tables(load(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("doc"), F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").alias("line")), 3, 40)


@query()
def fuzzy_token_sort(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    names = part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("a"), F.concat_ws(" ", "p_brand", F.lower("p_name"), "p_type").alias("b"))
    return names.select("p_partkey", fuzzy.token_sort_score("a", "b").alias("score"))


@query()
def fuzzy_nearest_name(spark, sf_dir):
    """Misspelt nations, one for each customer, against the nations."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("known"))
    typo = F.concat(F.substring("known", 1, 2), F.substring("known", 4, 99), F.lit(" "), F.col("c_mktsegment"))
    names = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.when(F.col("c_custkey") % 4 == 0, F.lower("known")).otherwise(typo).alias("name"))
    return fuzzy.nearest_names(names.distinct(), nation.select(F.col("known").alias("name")))


@query()
def fuzzy_passage_locate(spark, sf_dir):
    """Passages of the benchmark in the documents that share words with them."""
    passages = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return fuzzy.locate_passages(passages, load(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def fuzzy_nearest_part(spark, sf_dir):
    """Every customer's name and segment against the names of all parts."""
    names = load(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"))
    return fuzzy.nearest_names(names.distinct(), load(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Budget|technical' WHEN 1 THEN 'Budget|technical' WHEN 2 THEN 'Budget|technical' WHEN 3 THEN 'Budget|TECH' ELSE '' END AS keys, CASE WHEN c_custkey % 5 < 3 THEN c_mktsegment END AS value, c_custkey % 5 >= 3 AS failed FROM customer")
def fuzzy_promote_key(spark, sf_dir):
    """Maps with the key, with two misspelt ones, with one too far from it, and without any."""
    forms = F.array(*(F.create_map(F.lit(k), F.col("c_mktsegment"), F.lit("Budget"), F.lit("9")) for k in ("technical", "tehcnical", "TECHNICALS", "TECH")), F.create_map().cast("map<string,string>"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", fuzzy.promote_key(F.element_at(forms, (F.col("c_custkey") % 5 + 1).cast("int")), "technical").alias("p"))
    return rows.select("c_custkey", F.array_join(F.array_sort(F.map_keys("p.payload")), "|").alias("keys"), F.try_element_at("p.payload", F.lit("technical")).alias("value"), F.col("p.error").isNotNull().alias("failed"))
