"""Sheets cut by names, texts by budgets, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import budgets, documents, sections
from tallyspark.sources.tables import dealt, load

from .register import query


def order_sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A content sheet for each order, three lines for each of its items, headed in one of seven ways; and the names that
    a summary gives these divisions."""
    at = F.row_number().over(Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = dealt(load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc")
    own = rows.select("doc", at.alias("at"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"))
    say = lambda *parts: F.concat(*(F.col(x) if x in ("p", "s") else F.lit(x) for x in parts))
    pick = lambda *forms: reduce(lambda rest, k: F.when(F.col("n") == k, forms[k - 1]).otherwise(rest), range(6, 0, -1), forms[6])
    heads = pick(say("| Section C : Part ", "p", " of ", "s", " |"), say("Bill No. 2 – Works ", "p"), say("  doors ", "p", " | "), say("Section D: Roofs ", "p", " (CONT'D)"), say("Bill 7 : Part ", "p"), say("Masonry ", "p", " as it is told of in the long description of the works"), F.lit("Section E: all finishes"))
    names = pick(say("Section C: Part ", "p", " of ", "s"), say("works ", "p"), say(" Doors ", "p"), say("Roofs ", "p"), say("Part ", "p"), say("Masonry ", "p"), F.lit("Finishes"))
    shown = F.array(heads, say("Part ", "p", " | 7 | "), F.concat(F.lit("bill no "), F.col("n").cast("string"), F.lit(" (continued)")))
    lines = own.select("doc", "at", F.posexplode(shown).alias("k", "line")).select("doc", (F.col("at") * 3 + F.col("k")).alias("line_no"), "line")
    return lines, own.select("doc", F.col("at").alias("ord"), names.alias("name"))


SHEETS = r"""WITH o AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS pos, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
l AS (SELECT doc, pos * 3 + k AS line_no, CASE WHEN k = 1 THEN 'Part ' || p || ' | 7 | ' WHEN k = 2 THEN 'bill no ' || n || ' (continued)' ELSE CASE n WHEN 1 THEN '| Section C : Part ' || p || ' of ' || s || ' |' WHEN 2 THEN 'Bill No. 2 – Works ' || p WHEN 3 THEN '  doors ' || p || ' | ' WHEN 4 THEN 'Section D: Roofs ' || p || ' (CONT''D)' WHEN 5 THEN 'Bill 7 : Part ' || p WHEN 6 THEN 'Masonry ' || p || ' as it is told of in the long description of the works' ELSE 'Section E: all finishes' END END AS line FROM o, (VALUES (0), (1), (2)) AS x(k)),
m AS (SELECT doc, pos AS ord, CASE n WHEN 1 THEN 'Section C: Part ' || p || ' of ' || s WHEN 2 THEN 'works ' || p WHEN 3 THEN ' Doors ' || p WHEN 4 THEN 'Roofs ' || p WHEN 5 THEN 'Part ' || p WHEN 6 THEN 'Masonry ' || p ELSE 'Finishes' END AS name FROM o),
f AS (SELECT *, upper(trim(name)) AS whole, trim(split_part(upper(trim(name)), ':', -1)) AS own FROM m),
h AS (SELECT doc, line_no, trim(trim(trim(upper(line)), '|')) AS bare FROM l),
g AS (SELECT *, CASE WHEN regexp_matches(bare, '^SECTION\s+[A-Z]\s*:') THEN trim(regexp_replace(bare, '^SECTION\s+[A-Z]\s*:\s*', '')) END AS section, nullif(regexp_extract(bare, '^BILL\s*(?:NO\.?)?\s*\d+\s*[-–:]\s*(.+)$', 1), '') AS bill FROM h WHERE NOT (contains(bare, 'CONT''D') OR contains(bare, 'CONT)') OR contains(bare, '(CONTINUED)'))),
t AS (SELECT f.doc, f.ord, f.name, f.own, g.line_no, CASE WHEN contains(section, whole) OR contains(section, own) THEN 1 WHEN contains(bill, whole) OR contains(bill, own) THEN 2 WHEN (contains(bare, whole) OR contains(bare, own)) AND length(bare) < greatest(length(whole), length(own)) + 25 THEN 3 END AS tier FROM f JOIN g USING (doc)),
b AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, ord ORDER BY tier, line_no) = 1),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc, own ORDER BY ord) = 1),
r AS (SELECT doc, name, tier, line_no AS start, lead(line_no) OVER (PARTITION BY doc ORDER BY line_no, ord) AS stop FROM c QUALIFY count(*) OVER (PARTITION BY doc) > 1)
"""


@query(SHEETS + "SELECT r.doc, name, tier, start, stop, sha256(trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10))) AS digest FROM r JOIN l ON l.doc = r.doc AND l.line_no >= start AND l.line_no < coalesce(stop, 2000000000) GROUP BY ALL")
def boq_division_segments(spark, sf_dir):
    out = sections.division_segments(*order_sheets(spark, sf_dir))
    return out.select("doc", "name", "tier", "start", "stop", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, sha256(text) AS joined, strlen(text) AS bytes, true AS fits FROM documents")
def txt_budget_chunks(spark, sf_dir):
    """Whole texts in pieces of at most 700 bytes and 150 tokens, which join to them."""
    budgets.small_batches(spark)
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", budgets.cuts(F.col("text"), 700, 150).alias("cuts"))
    rows = rows.select("doc_id", F.transform("cuts", lambda c: budgets.piece(F.col("text"), c)).alias("pieces"))
    fits = F.forall("pieces", lambda p: (F.octet_length(p) <= 700) & (F.length(p) < 151 * 4) & (p != ""))
    joined = F.array_join("pieces", "")
    return rows.select("doc_id", F.sha2(joined, 256).alias("joined"), F.octet_length(joined).cast("long").alias("bytes"), fits.alias("fits"))


@query()
def txt_budget_chunk_cuts(spark, sf_dir):
    return budgets.budget_chunks(load(spark, sf_dir, "documents"), 700, 150).select("doc_id", "chunk", "start", "stop")


TURNS = "WITH RECURSIVE p AS (SELECT conv_id AS ctx, turn AS ord, row_number() OVER w AS pos, sum(length(text)) OVER w AS upto, length(text) AS own FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)), "


@query(TURNS + """c AS (SELECT DISTINCT ctx, 0::BIGINT AS start, -1 AS chunk, 0::HUGEINT AS used FROM p UNION ALL
 SELECT c.ctx, n.stop, c.chunk + 1, n.upto FROM c, LATERAL (SELECT max(pos) AS stop, max(upto) AS upto FROM p WHERE p.ctx = c.ctx AND pos > c.start AND (pos = c.start + 1 OR (p.upto - c.used) // 4 <= 150)) n WHERE n.stop IS NOT NULL),
 r AS (SELECT ctx, chunk, lag(start) OVER (PARTITION BY ctx ORDER BY chunk) AS low, start AS high FROM c) SELECT p.ctx, ord, chunk FROM r JOIN p ON p.ctx = r.ctx AND pos > low AND pos <= high""")  # fmt: skip
def txt_count_chunks(spark, sf_dir):
    """Turns of each conversation in the longest runs of at most 150 tokens."""
    return budgets.count_chunks(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx"), F.col("turn").alias("ord"), "text"), 150)


PLAN = """WITH RECURSIVE d AS (SELECT conv_id AS ctx, turn AS doc, greatest(length(text) // 4, 1) AS tokens, CASE WHEN turn % 5 = 4 THEN 7 END AS cached FROM conversations),
 e AS (SELECT *, sum(coalesce(cached, tokens)) OVER (PARTITION BY ctx) - 150 AS excess, tokens > 200 OR tokens >= 90 AS large FROM d),
 u AS (SELECT *, floor(CASE WHEN large THEN tokens * 0.8::DOUBLE ELSE 0 END)::BIGINT AS saves FROM e WHERE cached IS NULL AND excess > 0),
 v AS (SELECT *, coalesce(sum(saves) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(saves) OVER (PARTITION BY ctx) AS every, row_number() OVER (PARTITION BY ctx, large ORDER BY tokens DESC, doc) AS pos FROM u WINDOW w AS (PARTITION BY ctx ORDER BY tokens DESC, doc)),
 s AS (SELECT * FROM v WHERE NOT large AND every < excess),
 k AS (SELECT ctx, pos, doc, tokens, 0 AS batch, tokens AS used, excess - every AS lacking FROM s WHERE pos = 1 UNION ALL
  SELECT s.ctx, s.pos, s.doc, s.tokens, k.batch + CASE WHEN k.used + s.tokens > 100 THEN 1 ELSE 0 END, CASE WHEN k.used + s.tokens > 100 THEN s.tokens ELSE k.used + s.tokens END, k.lacking FROM k JOIN s ON s.ctx = k.ctx AND s.pos = k.pos + 1),
 b AS (SELECT ctx, batch, any_value(lacking) AS lacking, floor(sum(tokens) * 0.7::DOUBLE)::BIGINT AS saved FROM k GROUP BY ALL),
 o AS (SELECT * FROM b QUALIFY coalesce(sum(saved) OVER (PARTITION BY ctx ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < lacking)
 SELECT ctx, doc, tokens, CASE WHEN before < excess THEN 'single' ELSE 'forced' END AS kind, NULL::INT AS batch FROM v WHERE large AND (before < excess OR tokens > 200)
 UNION ALL SELECT k.ctx, doc, tokens, 'batch', k.batch FROM k JOIN o ON o.ctx = k.ctx AND o.batch = k.batch"""


@query(PLAN)
def txt_summary_plan(spark, sf_dir):
    """Turns as documents of their conversation, brought to 150 tokens; every fifth has a summary."""
    size = text.token_estimate(F.length("text"))
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx"), F.col("turn").alias("ord"), F.col("turn").alias("doc"), size.alias("tokens"), F.when(F.col("turn") % 5 == 4, 7).alias("cached"))
    return budgets.summary_plan(rows, 150, 90, ceiling=200, batch=100)


def shrinks_badly(tokens: Column, kind: Column, summary: Column) -> Column:
    """Summaries of long documents that save only a hundredth."""
    return F.when(tokens > 25_000, F.floor(tokens * 0.99).cast("long")).otherwise(budgets.summarised(tokens, kind, summary))


@query()
def ctx_squeezed(spark, sf_dir):
    """The lines of each order as documents of up to 50,000 tokens, brought to 40,000, or at least to 60,000."""
    rows = dealt(load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "ctx"), "ctx")
    at = F.row_number().over(Window.partitionBy("ctx").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    docs = rows.select("ctx", at.alias("ord"), (F.col("l_quantity").cast("int") * 1000 + F.col("l_partkey") % 7).alias("tokens")).withColumn("doc", F.col("ord"))
    return budgets.squeezed(docs, 40_000, 60_000, ceiling=30_000, shrink=shrinks_badly)


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as parts. In two of three the second turn begins the context and the fourth ends it; in one
    of three there is no mark. A conversation of one turn that begins a context holds the mark within its text."""
    turn, conv = F.col("turn"), F.col("conv_id")
    begin = F.when(conv % 3 == 0, budgets.BEGIN_MARKS[0]).when(conv % 3 == 1, budgets.BEGIN_MARKS[1])
    body = F.when((turn == 1) | (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) == 1), F.concat("text", F.coalesce(begin, F.lit("")))).when((turn == 3) & (conv % 3 < 2), F.concat(F.lit(budgets.END_MARK), "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "conversations").select(conv.alias("ctx"), turn.alias("ord"), F.when(turn == 2, "uri").otherwise("text").alias("kind"), body.alias("text"))


MARKED = """WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 m AS (SELECT conv_id AS ctx, turn AS ord, n, CASE WHEN turn = 2 THEN 'uri' ELSE 'text' END AS kind, CASE WHEN turn = 1 OR n = 1 THEN text || CASE conv_id % 3 WHEN 0 THEN '### BEGIN RFP-REFERENCE' WHEN 1 THEN '### BEGIN CONTRACTOR-SUBMISSION' ELSE '' END WHEN turn = 3 AND conv_id % 3 < 2 THEN '### END CONTRACTOR-SUBMISSION' || text ELSE text END AS text FROM t) """


@query(MARKED + """, o AS (SELECT *, ctx % 3 < 2 AND (n = 1 OR max(ord) OVER (PARTITION BY ctx) >= 1 AND n > 1) AS marked, row_number() OVER (PARTITION BY ctx ORDER BY ord) AS pos FROM m)
 SELECT ctx, ord, 0 AS piece, CASE WHEN marked AND n = 1 THEN 'prefix' WHEN marked AND ord < 1 THEN 'prefix' WHEN marked AND ord <= 3 THEN 'context' WHEN marked THEN 'suffix' WHEN pos = 1 THEN 'prefix' ELSE 'context' END AS region, CASE WHEN marked AND n = 1 THEN length(split_part(text, '### BEGIN', 1)) ELSE length(text) END AS chars FROM o
 UNION ALL SELECT ctx, ord, 1, 'context', length(text) - length(split_part(text, '### BEGIN', 1)) FROM o WHERE marked AND n = 1""")  # fmt: skip
def ctx_split_regions(spark, sf_dir):
    return budgets.split_regions(marked_turns(spark, sf_dir)).select("ctx", "ord", "piece", "region", F.length("text").cast("long").alias("chars"))


@query(MARKED + "SELECT ctx, sha256(string_agg(text, '' ORDER BY ord)) AS digest, count(*) + (any_value(n) = 1 AND any_value(ctx) % 3 < 2)::INT AS parts FROM m GROUP BY 1")
def ctx_reassembled(spark, sf_dir):
    """Conversations split and put together again: without documents inside, the parts are as they were."""
    back = budgets.reassembled(budgets.split_regions(marked_turns(spark, sf_dir)))
    joined = documents.joined_texts(back.select(F.col("ctx").alias("doc"), F.col("at").alias("ord"), "text"), "")
    return joined.join(back.groupBy(F.col("ctx").alias("doc")).agg(F.count(F.lit(1)).alias("parts")), "doc").select(F.col("doc").alias("ctx"), F.sha2("text", 256).alias("digest"), "parts")


@query("""SELECT o_orderkey AS doc, CASE o_orderkey % 8 WHEN 0 THEN 'Beta ' || o_orderkey WHEN 1 THEN 'Alpha works' WHEN 2 THEN 'Masonry and more' WHEN 3 THEN 'STONE & ROOF' WHEN 4 THEN 'GROUND FLOOR' WHEN 5 THEN 'Beta ' || o_orderkey WHEN 6 THEN 'Sheet ' || o_orderkey ELSE 'SITEWORK' END AS division,
 CASE o_orderkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 7 THEN 3 ELSE 6 END AS tier FROM orders""")  # fmt: skip
def boq_resolved_divisions(spark, sf_dir):
    """A sheet for each order, named in each of the six ways, two of them in two."""
    key = F.col("o_orderkey").cast("string")
    sheet = lambda text, given=None, name=None: F.struct((text if isinstance(text, Column) else F.lit(text).cast("string")).alias("text"), (given if given is not None else F.lit(None).cast("string")).alias("given"), (name if name is not None else F.lit("S")).alias("sheet_name"))
    forms = F.array(
        sheet("masonry", F.concat(F.lit(" beta "), key, F.lit(" "))), sheet("finishes and alpha works only", F.lit("bill 7")), sheet(F.concat(F.lit("ALPHA WORKS and beta "), key, F.lit(" then masonry"))),
        sheet("Bill No. 3 - stone & roof\n7"), sheet("7 x\nGROUND FLOOR\n8"), sheet("12", name=F.lit("beta")), sheet(None, name=F.concat(F.lit("Sheet "), key)), sheet("the siteworks", F.lit("#1-2")),
    )
    own = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.inline(F.array(F.element_at(forms, (F.col("o_orderkey") % 8 + 1).cast("int")))))
    names = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.array(F.lit("Alpha works"), F.concat(F.lit("Beta "), key), F.lit("Masonry and more"))).alias("ord", "name"))
    return sections.resolved_divisions(own, names)
