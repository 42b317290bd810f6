"""Bottom-k fingerprints of word shingles, with DataFrame functions only.

A text's shingles are its runs of five words (a shorter text is one shingle, an empty one has none); words are
`[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. The fingerprint is the `k` smallest distinct 64-bit shingle hashes,
ascending. Fingerprints of parts merge into the fingerprint of the whole, and two of them estimate resemblance,
containment and distinct shingle counts.

Rows: a null text counts as empty, with an empty fingerprint; two empty fingerprints have resemblance 1, an empty and
another one 0. Null ids sort first; rows with equal ids are ordered by a hash of their text; repeated rows stay. Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 5
SIZE = 64
#: The range of a signed 64-bit hash, for the distinct-count estimate.
HASHES = 2.0**64


def let(value: Column, body) -> Column:
    """Bind `value` once for `body`, so that it isn't evaluated at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """The bottom-`size` fingerprint of a text: array<bigint>, ascending."""

    def shingles(words: Column) -> Column:
        count = F.size(words)
        many = F.transform(F.slice(words, 1, F.greatest(count - (width - 1), F.lit(0))), lambda first, i: F.xxhash64(first, *(F.get(words, i + j) for j in range(1, width))))
        return F.when(count >= width, many).when(count > 0, F.array(F.xxhash64(F.lit(width), words))).otherwise(F.array().cast("array<bigint>"))

    return bottom(let(word_hashes(text), shingles), size)


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The fingerprint of two parts' shingles together."""
    return bottom(F.concat(a, b), size)


def merge_groups(df: DataFrame, keys: list[str], fingerprint: str, size: int = SIZE) -> DataFrame:
    """One fingerprint per group. Hashes are made distinct before the shuffle, and only the smallest stay of each of
    many slices, so a group of any size passes as at most 256 x `size` hashes."""
    slices = df.select(*keys, F.explode(fingerprint).alias("hash")).distinct().withColumn("slice", F.pmod(F.col("hash"), F.lit(256)))
    rank = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy("hash"))
    kept = slices.withColumn("rank", rank).filter(F.col("rank") <= size)
    return kept.groupBy(*keys).agg(bottom(F.collect_list("hash"), size).alias(fingerprint))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of the union's smallest hashes that both have: an estimate of the sets' Jaccard similarity."""
    union = bottom(F.concat(a, b), size)
    estimate = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Exact below `size` hashes; else (size - 1) over the share of the hash range that the sketch spans."""
    spanned = (F.element_at(a, -1).cast("double") + HASHES / 2) / HASHES
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / spanned)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of a's shingles that b has too."""
    shared = resemblance(a, b, size) * distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def as_text(fingerprint: Column) -> Column:
    return F.concat_ws("", F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 16, "0")))


#: Sampled rows behind each cut point.
SAMPLED = 8


def cut_points(points: DataFrame, ranges: int, rows: int) -> list[tuple[int, int, int]]:
    """Points (f, k, t) that cut the rows into about `ranges` ranges of equal numbers, from a sample by hash: about
    SAMPLED rows for each range reach the driver."""
    every = max(1, rows // (SAMPLED * ranges))
    sampled = points.filter(F.pmod(F.xxhash64("f", "k", "t"), F.lit(every)) == 0).distinct().orderBy("f", "k", "t").collect()
    return [tuple(r) for r in sampled[SAMPLED - 1 :: SAMPLED]]


def range_of(point: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted cut points aren't after a row's point, by binary search."""
    if not cuts:
        return F.lit(0)
    held = F.expr("array(" + ", ".join(f"named_struct('f', {f}, 'k', bigint('{k}'), 't', bigint('{t}'))" for f, k, t in cuts) + ")")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(held, found + step - 1) <= point, found + step).otherwise(found))


def with_next(df: DataFrame, key: str, value: str, derived: dict[str, Column]) -> DataFrame:
    """Add the derived columns, and next_<column> for `value` and each derived one: those of the row with the next
    key (after the last: the first); equal keys are ordered by a hash of `value`, then by it.

    Rows fall into about sqrt(rows) ranges of nearly equal numbers, cut by (key, hash of the value), so neither far-apart
    nor repeated keys fill one range. One window per range finds the next row, and a range's last row takes the first row
    of the next range that has any; of the ranges, only their numbers meet in one task. The join to those first rows
    keeps the windows' partitioning, so the texts are shuffled once.
    """
    rows = df.count()
    point = F.struct(F.col(key).isNotNull().cast("int").alias("f"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.xxhash64(value).alias("t"))
    cuts = cut_points(df.select(point.alias("p")).select("p.*"), max(1, round(rows**0.5)), rows)
    dealt = df.withColumn("_range", range_of(point, cuts))
    order = Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(), F.xxhash64(value), value)
    columns = [value, *derived]
    inside = dealt.withColumns(derived)
    inside = inside.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {"_last": F.lead(F.lit(False), 1, True).over(order)})
    firsts = dealt.withColumn("_row", F.row_number().over(order)).filter("_row = 1").select("_range", value)
    firsts = materialize(firsts, "range-starts")
    lowest = firsts.agg(F.min("_range").alias("_lowest"))
    following = firsts.select("_range", F.lead("_range").over(Window.orderBy("_range")).alias("_after")).crossJoin(lowest).select("_range", F.coalesce("_after", "_lowest").alias("_after"))
    starts = firsts.withColumns(derived).select(F.col("_range").alias("_after"), *(F.col(c).alias(f"_start_{c}") for c in columns))
    joined = inside.join(following.join(starts, "_after"), "_range", "left")
    return joined.select(*df.columns, *derived, *(F.when(F.col("_last"), F.col(f"_start_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in columns))


def fingerprint_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, text, edited, next text's and both own fingerprints: the operator's own outputs."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(own, "doc_id", "text", {"sketch": sketch(F.col("text"), size)})
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    return paired.select("doc_id", chars.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch").withColumn("edited_sketch", sketch(F.col("edited"), size))


def fingerprint_digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    own = fingerprint_documents(docs, size)
    a, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        resemblance(a, edited, size).alias("near_edited"),
        resemblance(a, following, size).alias("near_next"),
    )
