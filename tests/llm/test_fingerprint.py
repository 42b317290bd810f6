import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fingerprint as fp


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    out = [(i * 3 + 1, " ".join(rng.choices(words, k=rng.randint(0, 120)))) for i in range(150)]
    return out + [(900, ""), (901, None), (902, "One two"), (903, "ONE Two"), (904, "Ünï\U0001f600 ça va"), (10**12, "far " * 700), (905, "\t\n ")]


def test_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as next_text", "2 as sketch", "3 as _range")
    got = {r.doc_id: r for r in fp.fingerprint_digests(docs.repartition(5)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r.near_edited == pytest.approx(jaccard(t, edited), abs=0.25 if len(shingles(t) | shingles(edited)) > 64 else 1e-9)
        assert r.near_next == pytest.approx(jaccard(t, following), abs=0.2 if len(shingles(t) | shingles(following)) > 64 else 1e-9)
        assert (r.fingerprint == r.edited_fingerprint) == (shingles(t) == shingles(edited)) or len(shingles(t)) > 64
    assert got[902].fingerprint == got[903].fingerprint != ""


def test_ties_and_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z"), (None, "null id"), (5, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fp.fingerprint_digests(docs).count() == 5
    assert fp.fingerprint_digests(docs.limit(0)).collect() == []
    one = fp.fingerprint_digests(docs.filter("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_parts_merge(spark):
    rng = random.Random(2)
    parts = [(g, " ".join(rng.choices("abcdefghij", k=300))) for g in (1, 1, 1, 2)]
    df = spark.createDataFrame(parts, "g long, text string").withColumn("s", fp.sketch(F.col("text")))
    merged = {r.g: r.s for r in fp.merge_groups(df, ["g"], "s").collect()}
    for g in (1, 2):
        every = sorted({h for r in df.filter(F.col("g") == g).collect() for h in r.s})[:64]
        assert merged[g] == every


def test_estimates(spark):
    a, b = " ".join(f"x{i}" for i in range(3004)), " ".join(f"x{i}" for i in range(1504))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a"), 512).alias("a"), fp.sketch(F.col("b"), 512).alias("b"))
    r = df.select(fp.distinct_shingles(F.col("a"), 512).alias("n"), fp.containment(F.col("b"), F.col("a"), 512).alias("c"), fp.resemblance(F.col("a"), F.col("b"), 512).alias("j")).first()
    assert r.n == pytest.approx(3000, rel=0.15) and r.c > 0.85 and r.j == pytest.approx(0.5, abs=0.08)


def test_far_and_repeated_ids_fill_no_range(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(i, f"text {i}") for i in range(1500)] + [(7, f"same id {i}") for i in range(1500)] + [(low, "first"), (high, "last"), (None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    point = F.struct(F.col("doc_id").isNotNull().cast("int").alias("f"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text").alias("t"))
    cuts = fp.cut_points(docs.select(point.alias("p")).select("p.*"), 55, len(rows))
    sizes = [r["count"] for r in docs.groupBy(fp.range_of(point, cuts).alias("r")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < len(rows) / 8
    got = {r.text: r.next_text for r in fp.with_next(docs, "doc_id", "text", {}).collect()}
    assert len(got) == len(rows) and got["null"] == "first" and got["last"] == "null" and got["text 8"] == "text 9" and got["text 1499"] == "last"
    same = [t for i, t in rows if i == 7]
    assert sum(got[t] in same for t in same) == len(same) - 1  # each id's rows follow each other
    assert fp.fingerprint_digests(docs).count() == len(rows)
