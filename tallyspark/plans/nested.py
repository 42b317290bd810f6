"""Nested documents, their parts and criteria, and what a conversation hasn't seen, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators import criteria, scoring
from tallyspark.sources import json_documents
from tallyspark.sources.tables import load
from tallyspark.streaming.unseen import unseen

from .register import query


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order with their place in it."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), at.alias("pos"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("p"), F.col("l_suppkey").cast("string").alias("s"), F.col("l_quantity").cast("int").cast("string").alias("q"))


NUMBERED = "WITH o AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_linenumber AS n, l_partkey::VARCHAR AS p, l_suppkey AS s, l_quantity::INT AS q FROM lineitem) "


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation criteria of each order: a criterion with a description, a group of two, or a plain one for each line."""
    say = lambda *parts: F.concat(*(F.col(x).cast("string") if x in ("pos", "s", "q") else F.lit(x) for x in parts))
    one = say('"Lot ', "pos", '": {"weight": ', "q", ', "description": " by ', "s", '"}')
    two = say('"Group ', "pos", '": {"Part": ', "q", ', "Price": {"weight": "', "q", '%"}, "none": null, "list": [1]}')
    rows = numbered(spark, sf_dir).select("doc", "pos", F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(say('"Item ', "pos", '": "', "q", '"')).alias("field"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field"))), lambda x: x["field"]), ", ")
    return rows.groupBy(F.col("doc").alias("id")).agg(F.concat(F.lit('{"Scope": {'), joined, F.lit("}}")).alias("text"))


@query(NUMBERED + "SELECT doc AS id, 'EVALUATION CRITERIA (preserve information relevant to these areas)' || chr(10) || 'Scope: Scope' || chr(10) || string_agg(CASE n WHEN 1 THEN '  - Lot ' || pos || chr(10) || '    by ' || s WHEN 2 THEN '  Category: Group ' || pos || chr(10) || '    - Part' || chr(10) || '    - Price' ELSE '  - Item ' || pos END, chr(10) ORDER BY pos) AS outline FROM o GROUP BY 1")
def crit_outline(spark, sf_dir):
    return criteria.outline(structures(spark, sf_dir))


@query(NUMBERED + """, c AS (SELECT doc AS id, pos, 'Lot ' || pos AS shown, q::DOUBLE AS weight, 'by ' || s AS description FROM o WHERE n = 1 UNION ALL SELECT doc, pos, 'Part', q, NULL FROM o WHERE n = 2 UNION ALL SELECT doc, pos, 'Price', q, NULL FROM o WHERE n = 2 UNION ALL SELECT doc, pos, 'Item ' || pos, q, NULL FROM o WHERE n > 2)
 SELECT id, lower(shown) AS name, last(shown ORDER BY pos) AS shown, last(weight ORDER BY pos) AS weight, any_value(description) AS description FROM c GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2"))  # fmt: skip
def crit_weights(spark, sf_dir):
    return criteria.criteria(structures(spark, sf_dir), scoring.coerce_weight(F.col("raw")).cast("double"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document for each order, its lines as parts; some of the stored texts are cut, of another type or missing, some
    tell names that weren't processed, and some documents were never processed."""
    rows = numbered(spark, sf_dir)
    part = F.struct(F.when(F.col("n") == 2, "uri").otherwise("text").alias("kind"), F.concat("p", F.lit(' "'), "q", F.lit('"\n')).alias("text"))
    held = rows.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    kind, told = F.col("doc") % 10, F.when(F.col("doc") % 10 == 4, F.array(F.lit("x.pdf"), F.lit(" ")))
    whole = F.to_json(F.struct("parts", told.alias("submitted_but_not_processed_files"), F.lit(7).alias("other")))
    text = F.when(kind == 1, F.substring(whole, F.lit(1), F.length(whole) - 9)).when(kind == 2, '{"parts": 5}').otherwise(whole)
    file = F.concat(F.lit("f"), F.col("doc").cast("string"))
    metas = held.select(F.floor(F.col("doc") / 16).alias("source_key"), F.concat(F.lit("n"), F.col("doc").cast("string")).alias("name"), F.when(kind != 5, file).alias("file"))
    texts = held.filter(kind != 3).select(file.alias("file"), text.alias("text"))
    return metas, json_documents.parsed(texts, json_documents.PARTS_SCHEMA)


@query(NUMBERED + "SELECT doc // 16 AS source_key, 'n' || doc AS name, (pos - 1)::INT AS ord, CASE n WHEN 2 THEN 'uri' ELSE 'text' END AS kind, p || ' \"' || q || '\"' || chr(10) AS text FROM o WHERE doc % 10 NOT IN (1, 2, 3, 5)")
def src_load_parts(spark, sf_dir):
    return json_documents.parts_of(*stored(spark, sf_dir))


@query("SELECT l_orderkey // 16 AS source_key, list_sort(list(DISTINCT CASE l_orderkey % 10 WHEN 4 THEN 'x.pdf' ELSE 'n' || l_orderkey END)) AS names FROM lineitem WHERE l_orderkey % 10 IN (1, 2, 3, 4) GROUP BY 1")
def src_not_processed(spark, sf_dir):
    return json_documents.not_processed(*stored(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 5 > 2 THEN json_extract(props, '$.k')::BIGINT END AS k, CASE event_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not of the schema' WHEN 2 THEN 'empty' END AS problem FROM events")
def src_parsed_json(spark, sf_dir):
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.concat("props", F.lit("}"))).when(n == 1, '{"k": "x"}').when(n == 2, F.lit(" ")).otherwise(F.col("props"))
    return json_documents.parsed(load(spark, sf_dir, "events").select("event_id", text.alias("text")), "k long")


@query("SELECT l_suppkey AS conversation, l_partkey::VARCHAR AS source_key, min(l_shipdate) AS at FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL")
def ctx_unseen(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("conversation"), F.col("l_partkey").cast("string").alias("source_key"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return unseen(rows, rows.filter("l_linenumber = 1")).select("conversation", "source_key", "at")
