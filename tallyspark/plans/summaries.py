"""Summary sheets and evidence over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import summaries
from tallyspark.sources.tables import load

from .register import query


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary for each order: a line for each of its items, written in one of seven ways, and on some a sub-total."""
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    amount = F.format_number(F.col("l_quantity").cast("int") * 100, 0)
    line = F.when(n == 1, F.concat(F.lit("| Section B : Part "), part, F.lit(" | | "), amount, F.lit(".50 |"))).when(n == 2, F.concat(F.lit("Bill No. 2 - Works "), part, F.lit(" | "), amount)).when(n == 3, F.concat(F.lit("c | Doors of "), part, F.lit(" | | "), amount))
    line = line.when(n == 4, F.concat(F.lit("all finishes | "), amount)).when(n == 5, F.lit("Masonry | | 0.00")).when(n == 6, F.concat(F.lit("Sub-Total | "), amount)).otherwise(F.lit("| | 77 |"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (n * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("int")).alias("line_no"), line.alias("line"))


SHEETS = """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_linenumber * 100000000 + l_partkey * 100 + l_quantity::INT AS line_no, l_partkey AS part, (l_quantity::INT * 100)::VARCHAR AS amount FROM lineitem),
r AS (SELECT doc, line_no, n, CASE n WHEN 1 THEN 'Section B : Part ' || part WHEN 2 THEN 'Works ' || part WHEN 3 THEN 'Doors of ' || part WHEN 4 THEN 'FINISHES' WHEN 5 THEN 'MASONRY' END AS division, CASE n WHEN 1 THEN amount || '.50' WHEN 5 THEN '0' ELSE amount END AS total FROM l),
d AS (SELECT doc, division, last(total ORDER BY line_no) AS total FROM r WHERE n <= 5 GROUP BY ALL) """


@query(SHEETS + "SELECT * FROM d")
def boq_summary_divisions(spark, sf_dir):
    return summaries.division_totals(sheets(spark, sf_dir))


@query(SHEETS + ", s AS (SELECT doc, first(total ORDER BY line_no) AS stated FROM r WHERE n = 6 GROUP BY 1), m AS (SELECT doc, sum(total::DECIMAL(30, 2)) AS summed FROM d GROUP BY 1) SELECT doc, coalesce(stated, CASE WHEN summed > 0 THEN summed::DECIMAL(30, 2)::VARCHAR END) AS total FROM s FULL JOIN m USING (doc) WHERE coalesce(stated, CASE WHEN summed > 0 THEN '' END) IS NOT NULL")
def boq_summary_project(spark, sf_dir):
    return summaries.project_totals(sheets(spark, sf_dir))


@query(SHEETS + "SELECT DISTINCT doc, division FROM r WHERE n <= 2 UNION SELECT DISTINCT doc, division FROM r WHERE n IN (4, 5) AND doc NOT IN (SELECT doc FROM r WHERE n <= 2)")
def boq_division_names(spark, sf_dir):
    return summaries.division_names(sheets(spark, sf_dir))


@query("WITH s AS (SELECT o_orderkey, c_nationkey, CASE WHEN o_orderkey % 5 = 0 THEN 'zz' ELSE n_name END AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) SELECT o_orderkey, CASE WHEN name = 'zz' THEN 'zz' WHEN o_orderkey % 3 = 1 THEN 'b' || c_nationkey WHEN o_orderkey % 3 = 2 THEN 'c' || c_nationkey ELSE 'b' || c_nationkey END AS found FROM s")
def score_evidence_sources(spark, sf_dir):
    """Orders name their customer's nation, in other cases and with a letter lacking; three documents have each name."""
    nation = load(spark, sf_dir, "nation")
    files = nation.select(F.lit(1).alias("package"), F.concat("n_name", F.lit(".pdf")).alias("display"), F.col("n_nationkey").cast("string").alias("k"))
    kinds = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(c).alias("context"), F.lit(by).alias("contractor"), F.lit(m).alias("mark")) for o, c, by, m in ((0, "rfp", None, "a"), (1, "tender", "x", "b"), (2, "tender", "y", "c"))))
    docs = files.select("package", "display", "k", F.inline(kinds)).withColumn("url", F.concat("mark", "k"))
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    key = F.col("o_orderkey")
    source = F.when(key % 5 == 0, "zz").when(key % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(".DOCX"))).otherwise(F.concat(F.lit("_"), "n_name", F.lit(".pdf")))
    evidence = orders.select("o_orderkey", F.lit(1).alias("package"), F.element_at(F.array(F.lit("z"), F.lit("x"), F.lit("y")), (key % 3 + 1).cast("int")).alias("contractor"), source.alias("source"))
    return summaries.evidence_sources(evidence, docs).select("o_orderkey", "found")


@query("SELECT o_orderkey AS doc, CASE o_orderkey % 3 WHEN 0 THEN 'Quantities for Tower ' || o_orderkey WHEN 1 THEN 'Project  of the  north' ELSE 'roof details' END AS project FROM orders")
def boq_summary_project_name(spark, sf_dir):
    """A head, a title of three kinds, a division, and texts."""
    key = F.col("o_orderkey")
    title = F.when(key % 3 == 0, F.concat(F.lit("| Bill of Quantities for Tower "), key.cast("string"), F.lit(" |"))).when(key % 3 == 1, F.concat(F.lit("Project "), key.cast("string"), F.lit(" of the | north 5."))).otherwise("Section Z")
    shown = F.array(F.lit("Item_id | Description"), F.lit("7 |"), title, F.lit("Section A: Roof | 5"), F.lit("see section a: roof for more"), F.lit("roof details"), F.concat(F.lit("Second text "), F.col("o_custkey").cast("string")))
    return summaries.project_names(load(spark, sf_dir, "orders").select(key.alias("doc"), F.posexplode(shown).alias("line_no", "line")))
