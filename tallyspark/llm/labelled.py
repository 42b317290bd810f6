"""What the two classifiers share: the bounded sample of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder



def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """mark, doc_id, text, label (0/1), part (0-9, dealt by id) of at most `most` labelled rows that aren't held out:
    the first ones by (mark, doc_id), where `mark` is a hash of the id. Rows without id, text or label are left out, and
    an id's repeated rows count once. The order of (mark, doc_id) is the one to learn in; the rows come in any."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = marked.filter(id_remainder("doc_id", modulus) != held_out).withColumn("mark", F.xxhash64("doc_id"))
    chosen = known.orderBy("mark", "doc_id").limit(most)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "label", "mark").agg(F.min("text").alias("text"))
    return once.select("mark", F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"), F.pmod(F.shiftright("mark", 7), F.lit(10)).cast("int").alias("part"))


def held_out_flag(modulus: int, held_out: int):
    return F.coalesce(id_remainder("doc_id", modulus) == held_out, F.lit(False))
