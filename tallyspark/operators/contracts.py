"""Clauses of contract reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(reviews: DataFrame) -> DataFrame:
    """Reviews (high_risk, modified, ambiguous, duplicates: arrays; contradictions: map) -> their numbers; what is null
    counts 0."""
    size = {c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("high_risk", "modified", "ambiguous", "contradictions", "duplicates")}
    return reviews.select("review", (size["high_risk"] + size["modified"]).alias("risk_number"), (size["ambiguous"] + size["contradictions"]).alias("ambiguous_number"), size["duplicates"].alias("duplicates_number"))


def consolidate(responses: DataFrame) -> DataFrame:
    """Responses (at, clauses: array of id and summary, impact) by their first clause: the first response's summary, the
    related clauses of the last response that has any, and each clause's impact, of which the last one counts. A
    response about its main clause alone gives that one's impact."""
    rows = responses.filter(F.size("clauses") > 0).withColumn("main", F.col("clauses")[0])
    related = F.slice("clauses", 2, F.greatest(F.size("clauses") - 1, F.lit(1)))
    several = F.size("clauses") > 1
    heads = rows.groupBy(F.col("main.id").alias("id")).agg(F.min_by("main.summary", "at").alias("summary"), F.max_by(F.when(several, related), F.when(several, F.col("at"))).alias("related"))
    named = rows.select(F.col("main.id").alias("id"), F.explode(F.when(several, F.transform(related, lambda c: c["id"])).otherwise(F.array("main.id"))).alias("clause"), "at", "impact")
    last = named.groupBy("id", "clause").agg(F.max_by("impact", "at").alias("impact")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clause", "impact")))).alias("impact"))
    return heads.join(last, "id")


def clause_ids(reviews: DataFrame) -> DataFrame:
    """The distinct ids of the clauses that a review names in any of its lists."""
    lists = [F.transform(c, lambda x: x["id"]) for c in ("high_risk", "modified", "ambiguous", "duplicates")]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists), F.coalesce(F.map_keys("contradictions"), F.array().cast("array<string>")))
    return reviews.select("review", F.explode(every).alias("clause")).filter(F.coalesce(F.trim("clause") != "", F.lit(False))).distinct()


def fuse_terms(terms: DataFrame) -> DataFrame:
    """Two maps of payment terms in one: the right one's entries count but for `source`; sources are joined."""
    left, right = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("left", "right"))
    kept = F.map_filter(right, lambda k, v: k != "source")
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(kept, k)), kept)
    sources = F.filter(F.array(F.element_at(left, "source"), F.element_at(right, "source")), lambda s: F.coalesce(s != "", F.lit(False)))
    return terms.select("review", F.when(F.size(sources) > 0, F.map_concat(merged, F.create_map(F.lit("Source"), F.array_join(sources, ", ")))).otherwise(merged).alias("terms"))


def with_sources(clauses: DataFrame, sources: DataFrame) -> DataFrame:
    """Clauses with the last source of their number; null without one."""
    last = sources.groupBy("clause").agg(F.max_by("source", "at").alias("source"))
    return clauses.join(last, "clause", "left")
