"""Filter interaction audit: what each of several filters removes in any order of applying them, by aggregating edges of
the lattice of applied sets.

A document fails some of the filters; it contributes to an edge (filters already applied, filter applied next) by that
set alone. Documents are counted by their failures first (32 sets for five filters), the counts are summed into the 80
edges, and the 600 steps of the 120 orders join the edges that they walk along, so the work on documents doesn't depend
on the number of orders.

Rows: null and empty texts are equal texts without words; a null lang is the part ''; repeated rows count each. A null
doc_id is neither smaller nor larger than another, so such a row fails no test of repetition and no label meets it; an
id's repeated labels count by their largest values, null labels not at all. Texts of any length are read whole, in slices.
An empty table gives no rows. Of the tables only doc_id, text, lang, and doc_id, quality, toxic are read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, small_batches, word_slices

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = re.compile(rb"[#$%&*|]")


def text_failures(text: str, data: bytes) -> int:
    """The set of the filters A to D that a text fails, as bits."""
    words, distinct = 0, set()
    for part in word_slices(data):
        words += len(part)
        distinct.update(part)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * capitals > 3 * len(text)) << 2 | bool(SYMBOLS.search(data)) << 3


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (A to D as bits), digest (of the text) of each row."""
    small_batches(docs.sparkSession)

    def make():
        def each(columns):
            texts = columns["text"].to_pylist()
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            failed = np.fromiter(map(text_failures, texts, data), np.int32, len(texts))
            return {c: columns[c] for c in ("doc_id", "part")} | {"failed": failed, "digest": pa.array([hashlib.sha256(d).digest() for d in data], pa.binary())}

        return each

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(given, "doc_id long, part string, failed int, digest binary", make)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (A to E), good, toxic, n: documents by the set of filters that they fail, and by their labels.

    Equal rows of one id, then equal texts of one part and label are counted before they meet, so copies of one text are
    a few rows wherever they are gathered."""
    each = failures(docs).groupBy("doc_id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("times"))
    marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    each = each.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "times"))).alias("first")
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("nameless")
    texts = each.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("times").alias("n"), first, nameless)
    texts = texts.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("digest")))
    fresh = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.times")).otherwise(0)
    split = F.array(F.struct(F.col("failed"), fresh.alias("n")), F.struct(F.col("failed").bitwiseOR(REPEATED).alias("failed"), (F.col("n") - fresh).alias("n")))
    rows = texts.select("part", "good", "toxic", F.inline(split))
    return rows.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def edges() -> list[tuple[int, int, int]]:
    """(applied, next, orders) of each edge: the filters already applied and the next one as bits, and how many orders
    walk along it."""
    out, size = [], len(FILTERS)
    for f in range(size):
        others = [1 << g for g in range(size) if g != f]
        out += [(sum(s), 1 << f, factorial(k) * factorial(size - 1 - k)) for k in range(size) for s in combinations(others, k)]
    return out


def edge_sums(counts: DataFrame) -> DataFrame:
    """part, applied, next and an edge's sums; the filter's share over all orders is in `shapley`."""
    every = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges()])
    rows = counts.select("*", F.inline(every))
    fails, before = F.col("failed").bitwiseAND(F.col("next")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    removed = fails & ~before
    sums = {"kept": ~fails & ~before, "removed": removed, "redundant": fails & before, "unique_fails": F.col("failed") == F.col("next"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic")}
    by_edge = rows.groupBy("part", "applied", "next", "orders").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in sums.items()])
    return by_edge.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "next")))


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, applied, next) of each step of each order."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in permutations(FILTERS) for k in range(len(order))]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = edge_sums(failure_counts(docs, labels))
    walk = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    return sums.join(F.broadcast(walk), ["applied", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
