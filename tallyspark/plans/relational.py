"""Clarifications, contracts, scores, jobs, projects and access over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import clarifications, contracts, jobs, scoring
from tallyspark.sources import tables
from tallyspark.sources.tables import dealt, exact_sum, load

from .register import query

PTC = """WITH raw AS (SELECT o_orderkey AS "at", 'K' || o_custkey % 40 AS contractor, 'Customer ' || o_custkey % 40 AS contractor_name, CASE WHEN o_orderkey % 3 <> 0 THEN 'P' || o_orderkey WHEN o_orderkey % 2 = 0 THEN '' END AS id,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS section, CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE ' Query about ' || o_orderkey % 50 || ' ' END AS question,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'Answer ' || o_orderstatus END AS answer, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'pending' END AS status,
  ['exclusions', 'deviations', 'pricing_anomalies', 'arithmetic_checks', 'other'][o_orderkey % 5 + 1] AS category, CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'C' || o_custkey % 9 END AS criterion, ['N/A', 'MISSING_INFO', 'INCOMPLETE', 'X'][o_orderkey % 4 + 1] AS ref_type FROM orders),
rows AS (SELECT "at", contractor, contractor_name, CASE WHEN id <> '' THEN id ELSE 'generated-' || "at" END AS id, coalesce(section, '') AS section, trim(question) AS question, coalesce(answer, '') AS answer, CASE WHEN status = 'closed' THEN 'closed' ELSE 'pending' END AS status,
  CASE WHEN category = 'other' THEN 'exclusions' ELSE category END AS category, criterion, ref_type FROM raw WHERE trim(question) <> '')
"""


def one_of(values: tuple[str, ...], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    question = F.when(key % 11 == 0, "  ").when(key % 13 == 0, None).when(key % 19 == 0, "n/a").otherwise(F.concat(F.lit(" Query about "), (key % 50).cast("string"), F.lit(" ")))
    return load(spark, sf_dir, "orders").select(
        key.alias("at"), F.concat(F.lit("K"), (who % 40).cast("string")).alias("contractor"), F.concat(F.lit("Customer "), (who % 40).cast("string")).alias("contractor_name"),
        F.when(key % 3 != 0, F.concat(F.lit("P"), key.cast("string"))).when(key % 2 == 0, "").alias("id"), F.when(key % 17 != 0, F.col("o_orderpriority")).alias("section"), question.alias("question"),
        F.when(key % 5 != 0, F.concat(F.lit("Answer "), "o_orderstatus")).alias("answer"), F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "pending").alias("status"),
        one_of((*clarifications.CATEGORIES, "other"), key % 5).alias("category"), F.when(key % 23 == 0, " ").otherwise(F.concat(F.lit("C"), (who % 9).cast("string"))).alias("criterion"), one_of((*clarifications.REF_TYPES, "X"), key % 4).alias("ref_type"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clarifications.normalized(raw_items(spark, sf_dir))


@query("SELECT * FROM rows", PTC)
def ptc_flatten(spark, sf_dir):
    return items(spark, sf_dir)


@query("SELECT count(*) AS total, count(*) FILTER (status <> 'closed') AS pending, count(*) FILTER (status = 'closed') AS closed, floor(count(*) FILTER (status = 'closed') / count(*) * 100 + 0.5)::BIGINT AS completion_pct, count(*) FILTER (category = 'exclusions') AS exclusions, count(*) FILTER (category = 'deviations') AS deviations, count(*) FILTER (category = 'pricing_anomalies') AS pricing_anomalies, count(*) FILTER (category = 'arithmetic_checks') AS arithmetic_checks FROM rows", PTC)
def ptc_stats(spark, sf_dir):
    return clarifications.stats(items(spark, sf_dir), "category", clarifications.CATEGORIES)


@query("SELECT count(*) AS total, count(*) FILTER (status <> 'closed') AS pending, count(*) FILTER (status = 'closed') AS closed, floor(count(*) FILTER (status = 'closed') / count(*) * 100 + 0.5)::BIGINT AS completion_pct, count(*) FILTER (ref_type = 'N/A') AS na, count(*) FILTER (ref_type = 'MISSING_INFO') AS missing_info, count(*) FILTER (ref_type = 'INCOMPLETE') AS incomplete FROM rows", PTC)
def ptc_stats_technical(spark, sf_dir):
    return clarifications.stats(items(spark, sf_dir), "ref_type", clarifications.REF_TYPES)


@query("SELECT contractor, contractor_name, count(*) AS total, count(*) FILTER (status <> 'closed') AS pending, count(*) FILTER (status = 'closed') AS closed FROM rows GROUP BY ALL", PTC)
def ptc_by_contractor(spark, sf_dir):
    return clarifications.by_contractor(items(spark, sf_dir))


@query("SELECT \"at\", id FROM rows WHERE category = 'deviations' AND status = 'closed' AND (contains(lower(contractor_name), 'r 7') OR contains(lower(section), 'r 7') OR contains(lower(question), 'r 7') OR contains(lower(answer), 'r 7'))", PTC)
def ptc_filter(spark, sf_dir):
    return clarifications.select(items(spark, sf_dir), " R 7", ("contractor_name", "section", "question", "answer"), contractor="all", category="deviations", status="closed").select("at", "id")


@query("SELECT \"at\", id FROM rows WHERE ref_type = 'INCOMPLETE' AND (contains(lower(contractor_name), 'c7') OR contains(lower(criterion), 'c7') OR contains(lower(question), 'c7') OR contains(lower(answer), 'c7'))", PTC)
def ptc_filter_technical(spark, sf_dir):
    return clarifications.select(items(spark, sf_dir), "C7", ("contractor_name", "criterion", "question", "answer"), contractor="all", ref_type="INCOMPLETE").select("at", "id")


@query(", valid AS (SELECT \"at\", contractor, trim(criterion) AS criterion, ref_type, trim(question) AS question FROM raw WHERE trim(question) <> '' AND upper(trim(question)) <> 'N/A' AND ref_type <> 'X' AND trim(criterion) <> '') SELECT contractor, criterion, ref_type, question, min(\"at\") AS \"at\" FROM valid v WHERE NOT EXISTS (FROM valid k WHERE k.\"at\" % 10 = 0 AND (k.contractor, k.criterion, k.ref_type, k.question) = (v.contractor, v.criterion, v.ref_type, v.question)) GROUP BY ALL", PTC)
def ptc_dedup(spark, sf_dir):
    rows = raw_items(spark, sf_dir)
    known = rows.filter("at % 10 = 0 AND ref_type <> 'X' AND trim(question) <> '' AND upper(trim(question)) <> 'N/A'").withColumns({"question": F.trim("question"), "criterion": F.trim("criterion")})
    return clarifications.new_only(rows, known)


CONTRACTORS = [f"K{i}" for i in range(6)]


@query("SELECT criterion, " + ", ".join(f"first(CASE WHEN trim(question) <> '' THEN question ELSE 'N/A' END ORDER BY \"at\") FILTER (contractor = '{c}') AS {c}" for c in CONTRACTORS) + " FROM raw GROUP BY criterion", PTC)
def score_ptc_pivot(spark, sf_dir):
    return clarifications.pivot(raw_items(spark, sf_dir), CONTRACTORS)


@query("SELECT \"at\", contractor, CASE WHEN \"at\" % 2 = 0 THEN section END AS section FROM raw", PTC)
def ptc_union_all(spark, sf_dir):
    rows = raw_items(spark, sf_dir)
    return clarifications.union_all([rows.filter("at % 2 = 0").select("at", "contractor", "section"), rows.filter("at % 2 = 1").select("contractor", "at")])


REVIEWS = """WITH reviews AS (SELECT l_orderkey AS review, list({'id': 'c' || l_partkey} ORDER BY l_partkey) FILTER (l_linenumber % 4 = 0) AS high, list({'id': 'c' || l_suppkey} ORDER BY l_suppkey) FILTER (l_linenumber % 4 = 1) AS modified,
  list({'id': CASE WHEN l_tax > 0.06 THEN ' ' ELSE 'a' || l_partkey END} ORDER BY l_partkey) FILTER (l_linenumber % 4 = 2) AS ambiguous, count(DISTINCT l_suppkey) FILTER (l_linenumber % 4 = 3) AS contradictions, list({'id': 'd' || l_suppkey} ORDER BY l_suppkey) FILTER (l_discount > 0.08) AS duplicates,
  list(DISTINCT 'x' || l_suppkey) FILTER (l_linenumber % 4 = 3) AS xs FROM lineitem GROUP BY 1)
"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 4

    def listed(when, value):
        ids = F.collect_list(F.when(when, F.struct(value.alias("id"))))
        return F.when(F.size(ids) > 0, ids)

    tagged = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    against = F.collect_set(F.when(line == 3, tagged("x", "l_suppkey")))
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("review")).agg(
        listed(line == 0, tagged("c", "l_partkey")).alias("high_risk"), listed(line == 1, tagged("c", "l_suppkey")).alias("modified"),
        listed(line == 2, F.when(F.col("l_tax") > 0.06, " ").otherwise(tagged("a", "l_partkey"))).alias("ambiguous"), F.map_from_entries(F.transform(against, lambda k: F.struct(k, F.lit("y")))).alias("contradictions"), listed(F.col("l_discount") > 0.08, tagged("d", "l_suppkey")).alias("duplicates"),
    )


@query("SELECT review, (coalesce(len(high), 0) + coalesce(len(modified), 0))::INT AS risk_number, (coalesce(len(ambiguous), 0) + contradictions)::INT AS ambiguous_number, coalesce(len(duplicates), 0)::INT AS duplicates_number FROM reviews", REVIEWS)
def clause_metrics(spark, sf_dir):
    return contracts.metrics(reviews(spark, sf_dir))


@query("SELECT DISTINCT review, clause FROM (SELECT review, unnest(list_concat(list_transform(coalesce(high, []), lambda x: x.id), list_transform(coalesce(modified, []), lambda x: x.id), list_transform(coalesce(ambiguous, []), lambda x: x.id), list_transform(coalesce(duplicates, []), lambda x: x.id), coalesce(xs, []))) AS clause FROM reviews) WHERE trim(clause) <> ''", REVIEWS)
def clause_ids_union(spark, sf_dir):
    return contracts.clause_ids(reviews(spark, sf_dir))


RESPONSES = """WITH raw AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS "at", min(l_partkey % 50) AS main, min(l_suppkey % 7) AS other, min(l_returnflag) AS impact FROM lineitem GROUP BY 1),
named AS (SELECT main, CASE WHEN other < 3 THEN 'm' || main ELSE 'r' || other END AS clause, "at", impact FROM raw),
impacts AS (SELECT main, clause, first(impact ORDER BY "at" DESC) AS impact FROM named GROUP BY ALL)
"""


@query("SELECT 'm' || main AS id, first('s' || \"at\" ORDER BY \"at\") AS summary, first('r' || other ORDER BY \"at\" DESC) FILTER (other >= 3) AS related, (SELECT string_agg(clause || '=' || impact, ',' ORDER BY clause) FROM impacts i WHERE i.main = r.main) AS impacts FROM raw r GROUP BY main", RESPONSES)
def clause_consolidate(spark, sf_dir):
    at = (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("at")
    lines = dealt(load(spark, sf_dir, "lineitem").select(at, "l_partkey", "l_suppkey", "l_returnflag"), "at")
    raw = lines.groupBy("at").agg(F.min(F.col("l_partkey") % 50).alias("main"), F.min(F.col("l_suppkey") % 7).alias("other"), F.min("l_returnflag").alias("impact"))
    clause = lambda mark, c: F.struct(F.concat(F.lit(mark), F.col(c).cast("string")).alias("id"), F.concat(F.lit("s"), F.col("at").cast("string")).alias("summary"))
    responses = raw.select("at", F.when(F.col("other") < 3, F.array(clause("m", "main"))).otherwise(F.array(clause("m", "main"), clause("r", "other"))).alias("clauses"), "impact")
    out = contracts.consolidate(responses)
    pairs = F.transform(F.array_sort(F.map_entries("impact")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("id", "summary", F.col("related")[0]["id"].alias("related"), F.array_join(pairs, ",").alias("impacts"))


@query("SELECT o_orderkey AS review, CASE WHEN o_orderkey % 3 = 0 THEN 'left' ELSE 'right' END AS days, CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey WHEN 1 THEN 'p' || o_custkey || ', q' || o_custkey ELSE 'q' || o_custkey END AS source FROM orders")
def clause_merge_sources(spark, sf_dir):
    key = F.col("o_orderkey")
    source = lambda mark: F.concat(F.lit(mark), F.col("o_custkey").cast("string"))
    left = F.when(key % 3 != 2, F.create_map(F.lit("days"), F.lit("left"), F.lit("source"), source("p")))
    right = F.when(key % 3 != 0, F.create_map(F.lit("days"), F.lit("right"), F.lit("source"), source("q")))
    fused = contracts.fuse_terms(load(spark, sf_dir, "orders").select(key.alias("review"), left.alias("left"), right.alias("right")))
    return fused.select("review", F.element_at("terms", "days").alias("days"), F.element_at("terms", "Source").alias("source"))


@query("SELECT o_orderkey AS clause, (SELECT first(l_shipdate::VARCHAR || '#' || l_partkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_shipdate DESC) FROM lineitem WHERE l_orderkey = o_orderkey) AS source FROM orders")
def clause_sources(spark, sf_dir):
    source = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), F.lit("#"), F.col("l_partkey").cast("string"))
    sources = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clause"), source.alias("source"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("at"))
    return contracts.with_sources(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clause")), sources)


SCORES = """WITH scores AS (SELECT 'V' || l_suppkey % 20 AS contractor, p_brand AS scope, p_size % 10 AS criterion, (p_size % 10 + 1)::DOUBLE AS weight, max(CASE WHEN l_tax < 0.07 THEN round(l_discount * 1000) END) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an answer of one of 20 contractors; some criteria have no score."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size") % 10
    return rows.groupBy(F.concat(F.lit("V"), (F.col("l_suppkey") % 20).cast("string")).alias("contractor"), F.col("p_brand").alias("scope"), size.alias("criterion"), (size + 1).cast("double").alias("weight")).agg(F.max(F.when(F.col("l_tax") < 0.07, F.round(F.col("l_discount") * 1000))).alias("score"))


@query("SELECT contractor, sum((coalesce(score, 0) * weight / 100)::DECIMAL(18,4))::DOUBLE AS total FROM scores GROUP BY 1", SCORES)
def score_weighted_total(spark, sf_dir):
    return scoring.weighted_totals(graded(spark, sf_dir))


@query("SELECT scope, sum((weight / 2)::DECIMAL(18,4))::DOUBLE AS weight FROM scores GROUP BY 1", SCORES)
def score_scope_weights(spark, sf_dir):
    shown = F.concat(F.replace((F.col("weight") / 2).cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    return scoring.scope_weights(graded(spark, sf_dir).withColumn("weight", shown))


@query("SELECT contractor, count(score) AS done, count(*) AS total, count(score) / count(*) AS ratio FROM scores GROUP BY 1", SCORES)
def score_progress(spark, sf_dir):
    return scoring.progress(graded(spark, sf_dir))


@query("SELECT DISTINCT scope, criterion, weight, (dense_rank() OVER (PARTITION BY scope ORDER BY criterion) - 1)::INT AS ord FROM scores", SCORES)
def score_flatten_criteria(spark, sf_dir):
    nested = graded(spark, sf_dir).groupBy("scope").agg(F.array_sort(F.collect_set(F.struct(F.col("criterion").alias("name"), "weight"))).alias("criteria"))
    return scoring.flatten_criteria(nested)


@query("""WITH r AS (SELECT p_brand AS scope, CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE 'c' || (p_partkey // 2) END AS criterion, CASE WHEN p_brand LIKE '%1' THEN p_size ELSE 0.5 END::DOUBLE AS weight FROM part WHERE p_brand NOT LIKE '%3' OR p_partkey % 2 = 0),
 g AS (SELECT scope, count(*) AS n, count(DISTINCT criterion) AS names, count(*) FILTER (trim(criterion) = '') AS unnamed, count(*) FILTER (weight <= 0) AS bad, sum(weight::DECIMAL(18,4))::DOUBLE AS s FROM r GROUP BY 1)
 SELECT scope, CASE WHEN unnamed > 0 THEN 'unnamed criterion' WHEN bad > 0 THEN 'weight not positive' WHEN n <> names THEN 'criterion twice' WHEN abs(s - 100) > 0.01 THEN 'weights not 100' END AS error, error IS NULL AS valid FROM g""")  # fmt: skip
def score_rubric_errors(spark, sf_dir):
    part = load(spark, sf_dir, "part").filter("p_brand NOT LIKE '%3' OR p_partkey % 2 = 0")
    name = F.when(F.col("p_partkey") % 97 == 0, " ").otherwise(F.concat(F.lit("c"), F.floor(F.col("p_partkey") / 2).cast("string")))
    return scoring.rubric_errors(part.select(F.col("p_brand").alias("scope"), name.alias("criterion"), F.when(F.col("p_brand").endswith("1"), F.col("p_size")).otherwise(0.5).cast("double").alias("weight")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'grade' WHEN l_quantity > 45 THEN 'score' WHEN l_linenumber = 1 THEN 'reasoning' WHEN l_tax > 0.07 THEN 'source' END AS error FROM lineitem")
def score_answer_errors(spark, sf_dir):
    reason = F.struct(F.lit("because").alias("text"), F.when(F.col("l_tax") <= 0.07, F.lit("page 1")).alias("source"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "11").when(F.col("l_returnflag") == "A", "Good Confidence").otherwise("9 - x").alias("grade"), (F.col("l_quantity") + 55).alias("score"), F.when(F.col("l_linenumber") > 1, F.array(reason)).alias("reasoning"))
    return scoring.answer_errors(rows).drop("grade", "score", "reasoning")


@query("WITH c AS (SELECT conv_id AS \"table\", turn AS \"at\", text AS criterion, CASE WHEN turn % 4 = 2 THEN role ELSE ' ' END AS scope FROM conversations) SELECT \"table\", \"at\", criterion, coalesce(last_value(nullif(trim(scope), '') IGNORE NULLS) OVER (PARTITION BY \"table\" ORDER BY \"at\" ROWS UNBOUNDED PRECEDING), 'Unscoped') AS scope FROM c")
def score_group_by_scope(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table"), F.col("turn").alias("at"), F.col("text").alias("criterion"), F.when(F.col("turn") % 4 == 2, F.col("role")).otherwise(" ").alias("scope"))
    return scoring.by_scope(rows)


@query("SELECT p_brand || p_size AS key, first(p_partkey ORDER BY p_partkey DESC) AS value FROM part GROUP BY 1")
def score_merge_scopes(spark, sf_dir):
    return scoring.last_wins(load(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("key"), F.col("p_partkey").alias("value")), "key", "value", "value")


@query("SELECT o_orderkey AS item, coalesce((SELECT string_agg('V' || l_suppkey || ': ' || l_returnflag, '; ' ORDER BY l_suppkey, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 3), '') AS message FROM orders")
def score_document_errors(spark, sf_dir):
    errors = load(spark, sf_dir, "lineitem").filter("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_list(F.struct("l_suppkey", "l_returnflag"))).alias("e"))
    errors = errors.select("item", F.transform("e", lambda x: F.struct(F.concat(F.lit("V"), x["l_suppkey"].cast("string")).alias("contractor"), x["l_returnflag"].alias("error"))).alias("errors"))
    return scoring.document_errors(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")).join(errors, "item", "left"))


@query("SELECT lower(p_type) || ' ' || p_size AS key, min(p_partkey) AS contractor FROM part GROUP BY 1")
def score_contractor_match(spark, sf_dir):
    name = F.concat(F.lit("  "), "p_type", F.lit("   "), F.col("p_size").cast("string"))
    return scoring.first_by_name(load(spark, sf_dir, "part").select(name.alias("name"), F.col("p_partkey").alias("contractor"), F.col("p_partkey").alias("at")))


GRADES = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 12 AS n, (l_suppkey % 8)::INT AS kind, ['major concerns', 'serious concerns', 'high concerns', 'minor-moderate concerns', 'moderate confidence', 'sound confidence', 'good confidence', 'very good confidence', 'excellent confidence', 'outstanding'] AS names FROM lineitem),
levels AS (SELECT *, CASE WHEN kind = 0 OR kind = 1 OR kind = 6 THEN CASE WHEN n BETWEEN 1 AND 10 THEN n END WHEN kind IN (2, 3) THEN CASE WHEN n BETWEEN 1 AND 10 THEN n END END AS level FROM g)
"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades as numbers, numbers with text, labels in other cases and with other marks, three digits, and binary ones."""
    n, kind = F.col("l_partkey") % 12, F.col("l_suppkey") % 8
    name = F.coalesce(F.get(F.array(*map(F.lit, scoring.GRADES)), n - 1), F.lit("nothing"))
    shown = F.when(kind == 0, n.cast("string")).when(kind == 1, F.concat(n.cast("string"), F.lit(" – fine"))).when(kind == 2, F.upper(F.translate(name, "-", "–"))).when(kind == 3, F.concat(F.lit(" "), name, F.lit(".!"))).when(kind == 4, F.lpad(n.cast("string"), 3, "0")).when(kind == 5, "Compliant").when(kind == 6, F.lpad(n.cast("string"), 2, "0")).otherwise("non-compliant")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("grade"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE kind WHEN 5 THEN 100 WHEN 7 THEN 0 ELSE level * 10 END::INT AS points FROM levels", GRADES)
def score_grade_map(spark, sf_dir):
    rows = grades(spark, sf_dir)
    return rows.withColumn("points", scoring.grade_score(F.col("grade"))).drop("grade")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(names[level + 1]) AS next FROM levels", GRADES)
def score_next_grade(spark, sf_dir):
    return grades(spark, sf_dir).withColumn("next", F.lower(scoring.next_grade(F.col("grade")))).drop("grade")


WEIGHTS = "WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_suppkey % 6)::INT AS kind, round(l_discount * 1000 + l_quantity, 1) AS v FROM lineitem) "


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, kind = F.round(F.col("l_discount") * 1000 + F.col("l_quantity"), 1), F.col("l_suppkey") % 6
    shown = value.cast("string")
    arabic = F.translate(shown, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    texts = F.when(kind == 0, shown).when(kind == 1, F.concat(F.replace(shown, F.lit("."), F.lit(",")), F.lit("%"))).when(kind == 2, F.concat(F.lit("-"), shown)).when(kind == 3, F.concat(arabic, F.lit("%"))).when(kind == 4, F.concat(F.lit("- "), shown, F.lit(" points"))).otherwise("none")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", texts.alias("weight"))


@query(WEIGHTS + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE kind WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN -v WHEN 4 THEN v END AS weight FROM w")
def score_coerce_weight(spark, sf_dir):
    return weights(spark, sf_dir).withColumn("weight", F.when(F.col("l_suppkey") % 6 != 3, scoring.coerce_weight(F.col("weight"))))


@query(WEIGHTS + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE kind WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN -v WHEN 4 THEN -v ELSE 0 END AS weight FROM w")
def score_report_weight(spark, sf_dir):
    return weights(spark, sf_dir).withColumn("weight", F.when(F.col("l_suppkey") % 6 != 3, scoring.report_weight(F.col("weight"))).otherwise(0.0))


@query(WEIGHTS + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE kind WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN -v WHEN 3 THEN v WHEN 4 THEN -v END AS value, CASE WHEN kind IN (1, 3) THEN value WHEN value <= 1 THEN value * 100 WHEN value = 200 THEN 2 WHEN value > 100 AND value % 100 = 0 THEN value / 100 ELSE value END AS percent FROM w")
def score_parsed_weight(spark, sf_dir):
    rows = weights(spark, sf_dir).withColumn("w", scoring.parsed_weight(F.col("weight")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("w.value").alias("value"), scoring.to_percent(F.col("w.value"), F.col("w.percent")).alias("percent"))


SCALED = """WITH s AS (SELECT p_brand AS rubric, p_partkey AS criterion, p_size / sum(p_size) OVER (PARTITION BY p_brand) * CASE WHEN p_brand LIKE '%1' THEN 100 WHEN p_brand LIKE '%2' THEN 1 WHEN p_brand LIKE '%3' THEN 10000 ELSE 37 END AS weight FROM part)
"""


@query("SELECT rubric, criterion, round(CASE WHEN rubric LIKE '%1' THEN weight WHEN rubric LIKE '%2' THEN weight * 100 WHEN rubric LIKE '%3' THEN weight * 0.01::DOUBLE WHEN weight <= 1 THEN weight * 100 ELSE weight END, 6) AS percent FROM s", SCALED)
def score_scale_mode(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    sums = part.groupBy("p_brand").agg(F.sum("p_size").alias("sum"))
    factor = F.when(F.col("p_brand").endswith("1"), 100).when(F.col("p_brand").endswith("2"), 1).when(F.col("p_brand").endswith("3"), 10000).otherwise(37)
    rows = part.join(sums, "p_brand").select(F.col("p_brand").alias("rubric"), F.col("p_partkey").alias("criterion"), (F.col("p_size") / F.col("sum") * factor).alias("weight"))
    return scoring.scale_weights(rows, "rubric").drop("weight")


@query()
def score_normalize_weights(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("rubric")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("weights"))
    return scoring.normalized_rubrics(rows)


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 1000 - 100 < 0 THEN 0 WHEN o_totalprice / 1000 - 100 > 100 THEN 100 ELSE o_totalprice / 1000 - 100 END AS score FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 7 = 0")
def score_clamp(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1000 - 100)
    return load(spark, sf_dir, "orders").select("o_orderkey", numbers.clamp_percent(value).alias("score"))


JOBS = """WITH jobs AS (SELECT o_orderkey AS job_id, o_orderpriority AS type, o_custkey AS user_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 50 END AS asset, o_custkey % 9 AS package FROM orders),
runs AS (SELECT l_orderkey AS job_id, l_linenumber AS attempt_no, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'in_progress' END AS status, l_shipdate AS created_at, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS artifact FROM lineitem),
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_no DESC, created_at DESC, part, supp) = 1)
"""


def queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own, runs = tables.job_tables(spark, sf_dir)
    return own.withColumns({"asset": F.when(F.col("job_id") % 3 != 0, F.col("user_id") % 50), "package": F.col("user_id") % 9}), runs


@query("SELECT job_id, type FROM jobs WHERE package = 3 AND type = '1-URGENT' ORDER BY created_at DESC, job_id DESC LIMIT 40", JOBS)
def job_by_package(spark, sf_dir):
    return jobs.select_jobs(queue(spark, sf_dir)[0], 40, package=3, type="1-URGENT", user_id=None).select("job_id", "type")


@query("SELECT attempt_no, status, part, supp FROM runs WHERE job_id = (SELECT max(job_id) FROM runs)", JOBS)
def job_runs(spark, sf_dir):
    runs = queue(spark, sf_dir)[1]
    last = runs.agg(F.max("job_id")).first()[0]
    return jobs.runs_of(runs, last).select("attempt_no", "status", "part", "supp")


@query("SELECT job_id, coalesce(max(attempt_no), 0) + 1 AS next_number FROM jobs LEFT JOIN runs USING (job_id) GROUP BY 1", JOBS)
def eval_latest_round(spark, sf_dir):
    own, runs = queue(spark, sf_dir)
    return jobs.next_numbers(runs, own, "job_id", "attempt_no")


@query("SELECT job_id, attempt_no, part, supp, 'completed' AS status, (status <> 'in_progress') AS was_started FROM runs", JOBS)
def job_transitions(spark, sf_dir):
    runs = queue(spark, sf_dir)[1].withColumns({"now": F.col("created_at"), "started_at": F.when(F.col("status") != "in_progress", F.col("created_at")), "completed_at": F.lit(None).cast("timestamp")})
    return jobs.transition(runs, "completed").filter("completed_at = now").select("job_id", "attempt_no", "part", "supp", "status", F.col("started_at").isNotNull().alias("was_started"))


@query("SELECT job_id, CASE status WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'error' WHEN 'in_progress' THEN 'in progress' ELSE 'pending' END AS state, status IS NULL OR status = 'in_progress' AS poll, CASE status WHEN 'completed' THEN 100 WHEN 'in_progress' THEN 50 ELSE 0 END AS progress FROM jobs LEFT JOIN (SELECT job_id, status FROM latest) USING (job_id)", JOBS)
def job_status_response(spark, sf_dir):
    return jobs.responses(jobs.job_list(*queue(spark, sf_dir)))


@query(", held AS (SELECT * FROM jobs WHERE asset = 7 OR (asset IS NULL AND package = 7) ORDER BY created_at DESC, job_id DESC LIMIT 200), done AS (SELECT * FROM runs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY attempt_no DESC, created_at DESC, part, supp) = 1) SELECT held.job_id, artifact FROM held JOIN done USING (job_id) ORDER BY held.created_at DESC, held.job_id DESC LIMIT 1", JOBS)
def job_result_for_asset(spark, sf_dir):
    return jobs.result_for_asset(*queue(spark, sf_dir), 7, 7).select("job_id", "artifact")


@query(", a AS (SELECT job_id, artifact FROM latest WHERE status = 'completed'), b AS (SELECT job_id, max(artifact) AS artifact FROM runs WHERE status = 'failed' GROUP BY 1) SELECT job_id, coalesce(a.artifact, b.artifact) AS artifact FROM a FULL JOIN b USING (job_id)", JOBS)
def job_result_fallback(spark, sf_dir):
    runs = queue(spark, sf_dir)[1]
    return jobs.first_of(jobs.completed_latest(runs), runs.filter("status = 'failed'").groupBy("job_id").agg(F.max("artifact").alias("artifact")), "job_id", "artifact")


@query("SELECT job_id, coalesce(asset, CASE WHEN type = '5-LOW' THEN -1 END) AS asset FROM jobs", JOBS)
def job_update_where_null(spark, sf_dir):
    return jobs.set_where_null(queue(spark, sf_dir)[0], "asset", F.lit(-1), F.col("type") == "5-LOW").select("job_id", "asset")


@query("SELECT job_id, attempt_no, part, supp FROM runs WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE package = 2)", JOBS)
def job_delete_cascade(spark, sf_dir):
    own, runs = queue(spark, sf_dir)
    return jobs.delete_cascade(own.filter("package = 2"), "job_id", runs)[0].select("job_id", "attempt_no", "part", "supp")


@query("SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 0 FROM customer WHERE c_custkey % 2 = 0")
def doc_insert_ignore(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    new = rows.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1000000).otherwise(0)).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    return jobs.insert_ignore(rows, new.unionByName(new), "c_custkey")


ROLES = """WITH given AS (SELECT l_suppkey % 200 AS "user", l_orderkey % 100 AS package, CASE l_returnflag WHEN 'A' THEN 'owner' ELSE 'member' END AS org_role, ['package_lead', 'commercial_team', 'technical_team', NULL, NULL][(l_partkey % 5 + 1)::INT] AS package_role, ['project_lead', 'commercial_lead', 'technical_lead', NULL][(l_linenumber % 4 + 1)::INT] AS project_role, l_tax > 0.07 AS creator, l_extendedprice AS price, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
resolved AS (SELECT *, CASE WHEN org_role = 'owner' OR creator OR package_role = 'package_lead' THEN 'full' WHEN package_role = 'commercial_team' THEN 'commercial' WHEN package_role = 'technical_team' THEN 'technical' WHEN project_role = 'project_lead' THEN 'full' WHEN project_role = 'commercial_lead' THEN 'commercial' WHEN project_role = 'technical_lead' THEN 'technical' ELSE 'none' END AS access FROM given)
"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = F.get(F.array(*map(F.lit, ("package_lead", "commercial_team", "technical_team"))), F.col("l_partkey") % 5)
    project = F.get(F.array(*map(F.lit, ("project_lead", "commercial_lead", "technical_lead"))), F.col("l_linenumber") % 4)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", "owner").otherwise("member").alias("org_role"), package.alias("package_role"), project.alias("project_role"), (F.col("l_tax") > 0.07).alias("creator"), F.col("l_extendedprice").alias("price")
    )


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, access FROM resolved", ROLES)
def pkg_access(spark, sf_dir):
    return jobs.package_access(roles(spark, sf_dir)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "access")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN access IN ('full', 'commercial') THEN price END AS price FROM resolved", ROLES)
def pkg_masked(spark, sf_dir):
    return jobs.masked(jobs.package_access(roles(spark, sf_dir)), "access", "price").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "price")


@query("SELECT c_custkey AS project FROM customer WHERE c_nationkey = 3 OR EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = 3)")
def proj_visible(spark, sf_dir):
    projects = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("creator"))
    members = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), (F.col("o_orderkey") % 25).alias("user"))
    return jobs.visible_projects(projects, members, 3).select("project")


@query("WITH m AS (SELECT c_custkey AS \"user\", c_nationkey AS org, CASE WHEN c_acctbal > 9000 THEN 'owner' ELSE 'member' END AS role FROM customer) SELECT \"user\", org, role <> 'owner' OR count(*) FILTER (role = 'owner') OVER (PARTITION BY org) > 1 AS may_leave FROM m")
def member_may_leave(spark, sf_dir):
    members = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("org"), F.when(F.col("c_acctbal") > 9000, "owner").otherwise("member").alias("role"))
    return jobs.may_leave(members).select("user", "org", "may_leave")


@query("SELECT o_orderkey, o_custkey AS \"user\", c_name AS name, c_name IS NULL AS pending FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def member_invitations(spark, sf_dir):
    users = load(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    return jobs.invitations(load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user")), users)


@query("WITH e AS (SELECT l_orderkey AS child, max(l_linenumber) AS round FROM lineitem GROUP BY 1), n AS (SELECT o_custkey AS parent, string_agg(o_orderkey || ':' || coalesce(round::VARCHAR, '-'), ',' ORDER BY o_orderkey) AS children FROM orders LEFT JOIN e ON child = o_orderkey GROUP BY 1) SELECT c_custkey AS parent, coalesce(children, '') AS children FROM customer LEFT JOIN n ON parent = c_custkey")
def pkg_latest_nested(spark, sf_dir):
    evaluations = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("round"), F.col("l_linestatus").alias("state"))
    nested = jobs.latest_nested(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent")), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child")), evaluations)
    shown = F.transform("children", lambda c: F.concat(c["child"].cast("string"), F.lit(":"), F.coalesce(c["latest"]["round"].cast("string"), F.lit("-"))))
    return nested.select("parent", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("children"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'no access' WHEN o_orderstatus <> 'F' THEN 'review incomplete' WHEN o_totalprice < 100000 THEN 'no eligible contractor' END AS reason, reason IS NULL AS may_award FROM orders")
def pkg_award_eligibility(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "full").otherwise("none").alias("access"), (F.col("o_orderstatus") == "F").alias("reviewed"), F.floor(F.col("o_totalprice") / 100000).alias("eligible"))
    return jobs.award_eligibility(rows).select("o_orderkey", "reason", "may_award")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def score_eligible_both(spark, sf_dir):
    rows = load(spark, sf_dir, "orders")
    return rows.filter("o_orderstatus = 'F'").select("o_custkey").intersect(rows.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000000 THEN printf('%.2fM', o_totalprice / 1000000) WHEN o_totalprice >= 1000 THEN floor(o_totalprice / 1000 + 0.5)::BIGINT || 'K' ELSE floor(o_totalprice + 0.5)::BIGINT::VARCHAR END AS short, CASE WHEN o_totalprice * 20 < 1024 THEN (o_totalprice * 20)::BIGINT || ' B' WHEN floor(o_totalprice * 20) < 1048576 THEN printf('%.1f KB', floor(o_totalprice * 20) / 1024) ELSE printf('%.1f MB', floor(o_totalprice * 20) / 1048576) END AS bytes, ((floor(o_totalprice)::BIGINT + 2) // 3 * 4) AS base64 FROM orders")
def fmt_numbers(spark, sf_dir):
    price = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", numbers.compact(price).alias("short"), numbers.byte_size(F.floor(price * 20)).alias("bytes"), numbers.base64_size(F.floor(price)).alias("base64"))


@query("SELECT o_orderkey, round_even(o_totalprice / 7, 0)::BIGINT || 's' AS took FROM orders")
def fmt_duration(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", numbers.duration(F.col("o_totalprice") / 7).alias("took"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0.05 AND l_partkey <> 0 THEN l_partkey::VARCHAR ELSE '2' END AS last FROM lineitem")
def boq_last_number(spark, sf_dir):
    line = F.concat(F.lit("Bill "), F.col("l_quantity").cast("int").cast("string"), F.lit(".5 m2, sum "), F.when(F.col("l_tax") > 0.05, F.format_number("l_partkey", 0)).otherwise("0.00"), F.lit(" 0"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.last_number(line).alias("last"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey % 12 IN (0, 1, 2, 3, 4, 5, 9, 10, 11) AS subtotal FROM lineitem")
def boq_filter_subtotals(spark, sf_dir):
    price, n = F.format_number("l_extendedprice", 2), F.col("l_suppkey") % 12
    label = F.when(n == 0, F.concat(F.lit("B/Fwd "), price)).when(n == 1, F.concat(F.lit(" sub  total: "), price)).when(n == 2, F.concat(F.lit("Amount carried to summary AED "), price)).when(n == 3, "CFWD").when(n == 4, F.concat(F.lit("carried to bill aed: "), price)).when(n == 5, F.lit("Page Total:")).when(n == 6, F.concat(F.lit("Total for section "), F.col("l_linenumber").cast("string"))).when(n == 7, F.concat(F.lit("Page total of "), price)).when(n == 9, F.concat(F.lit("TOTAL  CARRIED "), price)).when(n == 10, F.concat(F.lit("Total-Brought "), F.col("l_linenumber").cast("string"))).when(n == 11, F.concat(F.lit("total - carried  AED: "), price)).otherwise(F.concat(F.lit("Excavation "), price))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.is_subtotal(label).alias("subtotal"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT (l_linenumber <= 2 OR l_linenumber IN (3, 4) OR (l_linenumber = 5 AND l_tax > 0.02)) AS junk FROM lineitem")
def boq_filter_junk(spark, sf_dir):
    line = F.col("l_linenumber")
    rows = load(spark, sf_dir, "lineitem")
    junk = text.is_junk(F.when((line == 4) | (line == 6), "pipe").when((line == 5) & (F.col("l_tax") > 0.02), "duct").otherwise(" "), F.when((line == 2) | (line == 3) | (line == 4), 1.0), F.when((line == 2) | (line == 3), 2.0), F.when(line == 1, 3.0), F.when((line == 5) | (line == 7), "Included"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", junk.alias("junk"))
