"""Phrase collocations: 1- to `max_n`-grams exploded into rows and counted per language by hash aggregation, each cut
scored from the counts of its two parts in decimals, phrases that a one-word extension explains taken out by an anti
join, and the rest ranked by windows.

A candidate's parts occur at least as often as it does, so grams are exploded level by level and only where their parts
may be frequent: words first; then pairs of frequent words by 64-bit keys, which sieve out most pairs before any phrase is
built; then phrases of 2 to `max_n` words whose pairs all passed, counted exactly. What is frequent is known to the tasks
as a Bloom filter of at most `FILTER_BITS` bits; it answers yes for all that is frequent, so no occurrence of a candidate
is missed, and equal keys or a filter that is too small only let more rows through. A task counts its grams before they
are exploded into rows, `BLOCK` words at a time.

A longer candidate that holds a phrase as often as the phrase occurs has parts of every length between that do so too, so
looking at extensions by one word is enough.

Rows: null and empty texts have no words; a null lang is `und`; every row counts, repeated ones too; ids are not read, so
they may be null or tied; texts of any length are cut into blocks between pieces only. Without candidates, or on an empty
table, there are no rows. Only `text` and `lang` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, discard, materialize, mix64, small_batches

MAX_N = 5
LEAST = 100
PERCENT = 100
TOP = 2_000
FILTER_BITS = 1 << 26
#: Words that a task holds, as 4-byte numbers, before it counts and emits them; distinct words that it names by numbers.
BLOCK, NAMES = 3_000_000, 500_000
#: Bytes of text that are split into words at once.
SLICE = 4_000_000
#: Languages whose totals are broadcast; more are joined.
LANGS = 10_000

# The characters between pieces, and the letters that are lower-cased.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(PIECE_ENDS))


class Names(dict):
    """Word -> number; 0 stands for the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def numbers(self, folded: bytes) -> np.ndarray:
        words = folded.replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def slices(folded: bytes) -> Iterator[bytes]:
    """A text in parts of about SLICE bytes, cut at ends of pieces."""
    start = 0
    while start < len(folded):
        end = folded.find(b".", start + SLICE)
        end = len(folded) if end < 0 else end + 1
        yield folded[start:end]
        start = end


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(bits - 1), keys >> np.uint64(32) & np.uint64(bits - 1)


def holds(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the Bloom filter holds the keys."""
    bit = lambda at: slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
    one, two = probes(keys, 64 * len(slots))
    return (bit(one) & bit(two)).astype(bool)


def bloom(keys: DataFrame) -> np.ndarray:
    """The filter's 64-bit slots for the column `key`, gathered by hash aggregation: at most FILTER_BITS bits reach the
    driver."""
    bits, rows = 1 << 16, keys.count()
    while bits < min(16 * rows, FILTER_BITS):
        bits *= 2
    key = F.col("key")
    both = keys.select(F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1))).alias("bit"))
    slots = both.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[slots.column("slot").to_numpy()] = slots.column("set").to_numpy().view(np.uint64)
    return out


def word_rows(lang: bytes, a: np.ndarray, names: list[bytes], filters: list[np.ndarray], max_n: int) -> Iterator[list[pa.Array]]:
    """words, phrase, f of one language's word numbers; its number of words as a row of 0 words without phrase."""
    total = np.bincount(a, minlength=len(names))
    seen = np.flatnonzero(total[1:]) + 1
    yield [pa.array([0], pa.int32()), pa.nulls(1, pa.string()), pa.array([total[1:].sum()])]
    yield [pa.array(np.ones(len(seen), np.int32)), pa.array(names, pa.binary()).take(pa.array(seen)).cast(pa.string()), pa.array(total[seen])]


def pairs(lang: bytes, a: np.ndarray, names: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of frequent words start, and their keys."""
    seen = np.unique(a)
    seen = seen[seen > 0]
    keys, known = np.zeros(len(names), np.uint64), np.zeros(len(names), bool)
    keys[seen] = np.fromiter((xxhash.xxh64_intdigest(lang + b" " + names[i], 42) for i in seen), np.uint64, len(seen))
    known[seen] = holds(words, keys[seen])
    known = known[a]
    at = np.flatnonzero(known[:-1] & known[1:])
    return at, mix64(keys[a[at]] * np.uint64(0x9E3779B97F4A7C15) + keys[a[at + 1]])


def pair_rows(lang: bytes, a: np.ndarray, names: list[bytes], filters: list[np.ndarray], max_n: int) -> Iterator[list[pa.Array]]:
    """key, f of the pairs of frequent words."""
    keys, times = np.unique(pairs(lang, a, names, filters[0])[1], return_counts=True)
    yield [pa.array(keys.view(np.int64)), pa.array(times.astype(np.int64))]


def phrase_rows(lang: bytes, a: np.ndarray, names: list[bytes], filters: list[np.ndarray], max_n: int) -> Iterator[list[pa.Array]]:
    """words, phrase, f of the phrases of 2 words or more whose pairs are all frequent."""
    at, keys = pairs(lang, a, names, filters[0])
    at = at[holds(filters[1], keys)]  # where a phrase of n words starts
    start = np.zeros(len(a) + 1, bool)
    start[at] = True
    table = pa.array(names, pa.binary())
    phrases, place = table, a[at].astype(np.int64)
    for n in range(2, max_n + 1):
        if n > 2:
            good = start[at + n - 2]
            at, place = at[good], place[good]
        codes, place, times = np.unique(place << 32 | a[at + n - 1], return_inverse=True, return_counts=True)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(codes >> 32)), table.take(pa.array(codes & 0xFFFFFFFF)), b" ")
        yield [pa.array(np.full(len(codes), n, np.int32)), phrases.cast(pa.string()), pa.array(times.astype(np.int64))]


def exploded(docs: DataFrame, columns: str, rows, filters: list[np.ndarray], max_n: int) -> DataFrame:
    """lang and the given columns: what `rows` makes of each task's words, a language and a block at a time."""
    small_batches(docs.sparkSession)
    ddl = f"lang string, {columns}"
    schema = arrow_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # FILTER_BITS at most each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = Names(), {}
        full = lambda: len(names) >= NAMES or sum(len(p) for parts in held.values() for p in parts) >= BLOCK

        def emit() -> Iterator[pa.RecordBatch]:
            words = list(names)
            for lang, parts in held.items():
                a = np.concatenate(parts)
                parts.clear()
                for out in rows(lang.encode(), a, words, shared.value, max_n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(out[0]), np.int64))), *out], schema=schema)
            names.__init__()
            held.clear()

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting = texts.setdefault(lang, [])
                for part in slices(text.encode("utf-8", "surrogatepass").translate(FOLD)):
                    waiting.append(part)
                    if len(part) >= SLICE or sum(map(len, waiting)) >= SLICE:
                        held.setdefault(lang, []).append(names.numbers(b".".join(waiting) + b"."))
                        waiting.clear()
                        if full():
                            yield from emit()
            for lang, waiting in texts.items():
                held.setdefault(lang, []).append(names.numbers(b".".join(waiting) + b"."))
            if full():
                yield from emit()
        yield from emit()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ddl)


def frequent_phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, words, phrase, f of all phrases of 1 to max_n words that occur `least` times in their language, and lang, n."""
    often = F.col("f") >= least
    counted = lambda rows, *by: rows.groupBy(*by).agg(F.sum("f").alias("f"))
    first = counted(exploded(docs, "words int, phrase string, f long", word_rows, [], max_n), "lang", "words", "phrase")
    first = materialize(first.filter(often | F.col("phrase").isNull()), "words")
    words = first.filter(F.col("phrase").isNotNull())
    filters = [bloom(words.select(F.xxhash64(F.concat_ws(" ", "lang", "phrase")).alias("key")))]
    keys = materialize(counted(exploded(docs, "key long, f long", pair_rows, filters, max_n), "key").filter(often), "pairs")
    filters.append(bloom(keys))
    longer = counted(exploded(docs, "words int, phrase string, f long", phrase_rows, filters, max_n), "lang", "words", "phrase")
    out = materialize(words.unionByName(longer.filter(often)), "frequent")
    totals = materialize(first.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")), "totals")
    discard(first)
    discard(keys)
    return out, totals


def unexplained(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The phrases that no candidate one word longer holds in `percent` of their occurrences or more."""
    shorter = F.expr("explode(array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words)))").alias("phrase")
    longer = phrases.filter("words > 2").select("lang", shorter, "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = (phrases["lang"] == longer["lang"]) & (phrases["phrase"] == longer["phrase"]) & (100 * longer["longer"] >= percent * phrases["f"])
    return phrases.join(longer, held, "left_anti")


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate's lowest cut."""
    if totals.count() <= LANGS:
        totals = F.broadcast(totals)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    firsts, rests = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0)))")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score and count, both descending,
    then by the phrase's bytes. The result is a written table of at most `top` rows a language, the caller's to delete."""
    counts, totals = frequent_phrases(docs, max_n, least)
    found = scored(unexplained(counts.filter("words > 1"), percent), counts, totals)
    # a language's phrases are dealt over buckets, whose first rows hold its first rows
    deal = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("bucket")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    best = found.select("*", deal).withColumn("place", place).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = materialize(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts)
    discard(totals)
    return out
