"""Clarification rows (contractor, contractor_name, section, question, answer, status, category, criterion, ref_type) and
the relations built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories, the kinds of reference, and the statuses of a clarification.
CATEGORIES = ("exclusions", "deviations", "pricing_anomalies", "arithmetic_checks")
REF_TYPES = ("N/A", "MISSING_INFO", "INCOMPLETE")
STATUSES = ("pending", "closed")


def normalized(items: DataFrame) -> DataFrame:
    """Raw items with their defaults: rows without a question go, missing ids are generated from the place (`at`),
    missing texts are empty; what isn't a known status or category is pending and the first category."""
    question = F.trim("question")
    rows = items.filter(F.coalesce(question != "", F.lit(False))).withColumn("question", question)
    return rows.withColumns({
        "id": F.when(F.coalesce(F.col("id") != "", F.lit(False)), F.col("id")).otherwise(F.concat(F.lit("generated-"), F.col("at").cast("string"))),
        "section": F.coalesce("section", F.lit("")),
        "answer": F.coalesce("answer", F.lit("")),
        "status": F.when(F.col("status") == "closed", "closed").otherwise("pending"),
        "category": F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise(CATEGORIES[0]),
    })


def select(rows: DataFrame, search: str, columns: tuple[str, ...], **wanted: str) -> DataFrame:
    """Rows with the wanted values ("all": any) and the text in one of the columns, whatever its case."""
    for column, value in wanted.items():
        if value != "all":
            rows = rows.filter(F.col(column) == value)
    text = search.strip().lower()
    if not text:
        return rows
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(text)), F.lit(False))
    return rows.filter(found)


def stats(rows: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """One row: totals, whole percent closed (halves up), and the rows of each value of `by`."""
    closed = F.count_if(F.col("status") == "closed")
    percent = F.coalesce(F.floor(closed / F.nullif(F.count("*"), F.lit(0)) * 100 + 0.5).cast("long"), F.lit(0))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "closed").alias("pending"), closed.alias("closed"), percent.alias("completion_pct"), *(F.count_if(F.col(by) == v).alias(v.lower().replace("/", "")) for v in values))


def by_contractor(rows: DataFrame) -> DataFrame:
    return rows.groupBy("contractor", "contractor_name").agg(F.count("*").alias("total"), F.count_if(F.col("status") != "closed").alias("pending"), F.count_if(F.col("status") == "closed").alias("closed"))


def new_only(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Valid new clarifications, the first of each contractor, criterion, kind and question, less those known before."""
    key = ["contractor", "criterion", "ref_type", "question"]
    question = F.trim("question")
    valid = rows.withColumn("question", question).withColumn("criterion", F.trim("criterion")).filter((F.col("question") != "") & (F.upper("question") != "N/A") & F.col("ref_type").isin(*REF_TYPES) & (F.col("criterion") != ""))
    return valid.groupBy(*key).agg(F.min("at").alias("at")).join(known.select(*key), key, "left_anti")


def pivot(rows: DataFrame, contractors: list[str]) -> DataFrame:
    """Criterion by contractor: the first text by place; a missing one is null, an invalid one N/A."""
    text = F.when(F.coalesce(F.trim("question") != "", F.lit(False)), F.col("question")).otherwise("N/A")
    return rows.groupBy("criterion").pivot("contractor", sorted(contractors)).agg(F.min_by(text, "at"))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Contractors' tables one after the other, by column name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def category_of(warning: Column) -> Column:
    """The category of a comparison's warning."""
    return F.when(warning == "missing_item", CATEGORIES[0]).when(warning == "total_mismatch", CATEGORIES[3]).otherwise(CATEGORIES[2])
