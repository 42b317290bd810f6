"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct word shingles; two texts link when 100 * |intersection| >= percent * |union|. Equal
sets form a class, and only classes are joined.

Each shingle flips one bit of a sketch, so the Hamming distance of two sketches is a lower bound of the sets'
symmetric difference, which for linked sets of at most U shingles is at most d = 2U(100 - percent)/(100 + percent).
Sets are joined in size bands; in a band the sketch has m > d segments, of which linked sets share all but d. Taking
segments in one order for everyone (fullest first, then by hash), linked sets share one among their first d + 1
(pigeonhole), so those are the join keys: full segments are selective, and near-empty ones are left out.

Members of a bucket of equal keys are compared by their whole parity sketches (two to four bits per shingle), whose
distance rules out nearly every pair that doesn't link; what it can't rule out is verified on the whole sets, so the
links are exact. First each member is verified against the smallest one it may link with, then once more against the
smallest of another component, and last all pairs that may link and are of different components: a group of copies
costs about one verification each, and every pair ends up ruled out, compared, or connected already. Large buckets are
compared in blocks of bounded size; members of a bucket's largest component aren't compared with each other again.

Rows: a null text, or one without words, has an empty set and links with nothing; shorter texts than a shingle are one
shingle; repeated rows and equal ids are linked by their texts like any others; a null id never names a component
unless all its ids are null. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashCache, discard, free_name, materialize, mix64, shingle_hashes, small_batches, words_of
from .components import connected_components

#: Ratio of neighbouring size bands.
BAND = 1.5
#: Segments per segment that must be taken.
SPARE = 1.25
#: Bits of one segment of a sketch.
SEGMENT_BITS = 16
#: Members of a bucket that one task holds for one comparison, on either side.
BLOCK = 1024
#: Names of sets that a task remembers, so as to give their keys once.
SEEN = 1_000_000
#: Row names that may be broadcast (16 bytes each); beyond that they are joined.
BROADCAST_ROWS = 1_000_000


@lru_cache(None)
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(smallest size that joins, end of sizes, keys taken, segments) of each band with anything to find."""
    out, low = [], 1
    while low < 1 << 40:
        end = max(low + 1, int(low * BAND))
        most = 2 * (end - 1) * (100 - percent) // (100 + percent)
        if most:
            out.append((-(-low * percent // 100), end, most + 1, int(np.ceil(SPARE * (most + 1)))))
        low = end
    return out


def segment_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set of shingle hashes."""
    n, keys = len(shingles), []
    for low, end, taken, segments in bands(percent):
        if low > n:
            break
        if n >= end:
            continue
        mixed = mix64(shingles)
        bits = np.sort((mixed % np.uint64(segments)) << np.uint64(SEGMENT_BITS) | (mixed >> np.uint64(64 - SEGMENT_BITS)))
        if (bits[1:] == bits[:-1]).any():  # flipped twice: back at 0
            bits, times = np.unique(bits, return_counts=True)
            bits = bits[times % 2 == 1]
        segment = (bits >> np.uint64(SEGMENT_BITS)).astype(np.int64)
        full, starts, counts = np.unique(segment, return_index=True, return_counts=True)
        marks, fill = np.zeros(segments, np.uint64), np.zeros(segments, np.int64)
        if len(full):
            marks[full], fill[full] = np.bitwise_xor.reduceat(mix64(bits + np.uint64(1)), starts), counts
        key = mix64(marks ^ mix64(np.arange(segments, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(end)))
        keys.append(key[np.lexsort((key, -fill))[:taken]])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def class_of(shingles: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Each shingle flips one of 2..4 bits per shingle; a power of two, so that a longer sketch folds to a shorter."""
    size = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    bits = (mix64(shingles ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


PROFILE = "row binary, doc_id long, n_shingles long, class long, keys array<long>"


def profile_in_task(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row's set: its size, its name and its join keys; a task gives an equal set's keys once."""
    cache, seen = HashCache(), set()
    for batch in batches:
        sizes, classes, keys = [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingle_hashes(cache.hashes(words_of(text)), width)
            own = class_of(shingles)
            sizes.append(len(shingles))
            classes.append(own)
            keys.append(None if own is None or own in seen else segment_keys(shingles, percent).view(np.int64))
            seen.add(own)
            if len(seen) > SEEN:
                seen.clear()
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "n_shingles", "class", "keys"])


def sketches_in_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in batches:
        sets = [shingle_hashes(cache.hashes(words_of(t)), width) for t in batch.column("text").to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_sketch(s) for s in sets], pa.binary())], names=["class", "n", "sketch"])


def sets_in_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    cache = HashCache()
    for batch in batches:
        sets = [shingle_hashes(cache.hashes(words_of(t)), width) for t in batch.column("text").to_pylist()]
        if sets:
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles"])


def shared_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, class) sorted by both -> those of keys that several classes have, once each. A key's rows stream
    through; only its first class is held."""
    key = first = last = given = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, classes = batch.column("key").to_numpy(), batch.column("class").to_numpy()
        fresh = np.empty(len(keys), bool)
        fresh[0] = keys[0] != key
        fresh[1:] = keys[1:] != keys[:-1]
        firsts = np.concatenate([[first if first is not None else 0], classes[fresh]])[np.cumsum(fresh)]
        new = np.empty(len(keys), bool)
        new[0] = fresh[0] or classes[0] != last
        new[1:] = fresh[1:] | (classes[1:] != classes[:-1])
        member = new & (firsts != classes)
        key, first, last = keys[-1], firsts[-1], classes[-1]
        if member.any():
            shared, at = np.unique(keys[member], return_index=True)
            heads = firsts[member][at]
            open_before = shared != given if given is not None else np.ones(len(shared), bool)
            given = keys[member][-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shared[open_before], keys[member]])), pa.array(np.concatenate([heads[open_before], classes[member]]))], names=["key", "class"])


def may_link(left: list[tuple], right: list[tuple], percent: int, every: bool, same: bool) -> set[tuple[int, int]]:
    """Pairs of (class, own, n, sketch) of different components that sizes and sketches don't rule out: all of them, or
    for each member only the one with the smallest other class."""
    size = min(len(m[3]) for side in (left, right) for m in side)

    def arrays(side):
        data = [np.frombuffer(m[3], np.uint64) for m in side]
        bits = np.stack([d if len(m[3]) == size else np.bitwise_xor.reduce(d.reshape(-1, size // 8), axis=0) for d, m in zip(data, side)])
        return bits, *(np.array([m[k] for m in side], np.int64) for k in range(3))

    a = arrays(left)
    b = a if same else arrays(right)
    out: set[tuple[int, int]] = set()
    least: dict[int, int] = {}
    for bits, own_class, component, n in zip(*a):
        fits = (b[2] != component) & (100 * np.minimum(b[3], n) >= percent * np.maximum(b[3], n))
        if same:
            fits &= b[1] > own_class
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        far = np.bitwise_count(b[0][at] ^ bits).sum(1, dtype=np.int64)
        at = at[far * (100 + percent) <= (100 - percent) * (b[3][at] + n)]
        for other in b[1][at].tolist():
            low, high = sorted((int(own_class), other))
            if every:
                out.add((low, high))
            else:
                least[high] = min(low, least.get(high, low))
    return out if every else {(low, high) for high, low in least.items()}


def compare_in_task(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Members sorted by (key, i, j), the blocks to compare -> pairs that may link, once per task."""
    group, held, given, out = None, [], set(), []

    def compare():
        i, j = group[1:]
        left = [m for b, m in held if b == i]
        right = left if i == j else [m for b, m in held if b == j]
        if len(left) > (i == j) and right:
            for pair in may_link(left, right, percent, every, i == j):
                if pair not in given:
                    given.add(pair)
                    out.append(pair)
            if len(given) > SEEN:
                given.clear()

    def batch_of():
        columns = [pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    for batch in batches:
        for key, i, j, block, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "block", "class", "own", "n", "sketch"))):
            if (key, i, j) != group:
                if held:
                    compare()
                group, held = (key, i, j), []
            held.append((block, member))
            if len(out) > 50_000:
                yield batch_of()
    if held:
        compare()
    if out:
        yield batch_of()


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def with_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, text."""
    return docs.select(row_name(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def row_name(docs: DataFrame) -> Column:
    """A 128-bit hash of id and text: what names a row even where ids are null or repeat."""
    return F.unhex(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit(":"), docs["text"]), F.lit("-"))).cast("binary")))


class Linker:
    """Verifies pairs of classes on their whole shingle sets."""

    def __init__(self, docs: DataFrame, profile: DataFrame, width: int, percent: int):
        self.docs, self.profile, self.width, self.percent = docs, profile, width, percent

    def texts(self, classes: DataFrame) -> DataFrame:
        """Rows of `docs` with a text of each of the classes."""
        rows = materialize(self.profile.join(classes, "class", "left_semi").groupBy("class").agg(F.min("row").alias("row")).select("row").distinct(), "rows")
        return self.docs.join(F.broadcast(rows) if few(rows) else rows, "row", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b), a written table."""
        pairs = materialize(pairs, "to-verify")
        named = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        sets = self.texts(named).select("text").mapInArrow(partial(sets_in_task, width=self.width), "class long, shingles array<long>").dropDuplicates(["class"])
        sets = materialize(sets, "sets")
        whole = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        out = materialize(whole.filter(100 * common >= self.percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
        discard(sets)
        discard(pairs)
        return out


def labelled(members: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    named = labels.select(F.col("node").alias(column), F.col("component").alias(name))
    return members.join(named, column, "left").withColumn(name, F.coalesce(name, column))


def compared(members: DataFrame, sketches: DataFrame, labels: DataFrame | None, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of classes of different components in a bucket that may link, a written table."""
    if labels is None:
        sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
        dealt = members.withColumn("own", F.col("class")).join(sizes, "key", "left")
        block = F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / BLOCK))).cast("int")
        grouped = dealt.select("key", "class", "own", block.alias("block")).withColumns({"i": F.col("block"), "j": F.col("block")})
    else:
        marked = labelled(members, labels, "class", "own")
        parts = marked.groupBy("key", "own").agg(F.count("*").alias("rows"))
        opened = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("rows").alias("all"), F.max(F.struct("rows", "own")).alias("most")).filter("parts > 1")
        opened = opened.select("key", F.col("most.own").alias("main"), F.ceil(F.col("most.rows") / BLOCK).cast("int").alias("p"), F.ceil((F.col("all") - F.col("most.rows")) / BLOCK).cast("int").alias("q"))
        within = F.when(F.col("own") == F.col("main"), F.pmod(F.xxhash64("class"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("class"), F.col("q"))).cast("int")
        dealt = marked.join(opened, "key").withColumn("block", within)
        # blocks 0..p-1 hold the largest component, p..p+q-1 the others; pairs within the first kind are left out
        lower = F.transform(F.sequence(F.lit(0), F.col("block")), lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
        rest = F.when(F.col("block") + 1 < F.col("p") + F.col("q"), F.sequence(F.greatest("p", F.col("block") + 1), F.col("p") + F.col("q") - 1)).otherwise(F.array().cast("array<int>"))
        higher = F.transform(rest, lambda x: F.struct(F.col("block").alias("i"), x.alias("j")))
        pairs = F.when(F.col("block") < F.col("p"), higher).otherwise(F.concat(lower, higher))
        grouped = dealt.select("key", "class", "own", "block", F.inline(pairs))
    rows = grouped.join(sketches, "class").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class")
    return materialize(rows.mapInArrow(partial(compare_in_task, percent=percent, every=every), "a long, b long").distinct(), "pairs")


def class_components(docs: DataFrame, profile: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component over classes that have a link to another class."""
    linker = Linker(docs, profile, width, percent)
    keys = profile.select("class", F.explode("keys").alias("key")).select("key", "class")
    dealt = keys.repartition("key").sortWithinPartitions("key", "class")
    members = materialize(dealt.mapInArrow(shared_in_task, "key long, class long"), "members")
    texts = linker.texts(members.select("class").distinct())
    sketches = materialize(texts.select("text").mapInArrow(partial(sketches_in_task, width=width), "class long, n long, sketch binary").dropDuplicates(["class"]), "sketches")
    tested = links = labels = None
    written = [members, sketches]
    for every in (False, False, True):
        pairs = compared(members, sketches, labels, percent, every)
        written.append(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        found = linker.links(pairs)
        written.append(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if labels is None or found.limit(1).count():
            labels = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    for table in written:
        discard(table)
    return labels


def similarity_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """row, doc_id, n_shingles, component_id (the smallest doc_id that links reach), class_id."""
    small_batches(docs.sparkSession)
    docs = with_rows(docs)
    profile = materialize(docs.mapInArrow(partial(profile_in_task, width=width, percent=percent), PROFILE), "profile")
    labels = class_components(docs, profile, width, percent)
    smallest = profile.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    grouped = labelled(smallest, labels, "class", "component")
    named = grouped.join(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("class", "component", "component_id")
    joined = profile.drop("keys").join(materialize(named, "components"), "class", "left")
    return joined.select("row", "doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("class").isNull(), F.col("doc_id"))).alias("component_id"), F.coalesce("component", "class").alias("class_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The columns and rows of `docs`, less all but one row of each group of linked texts: the one with the smallest
    id (then the smallest row hash) stays. Rows with an empty set stay; of rows equal in id and text one stays."""
    found = materialize(similarity_components(docs, width, percent), "groups")
    chosen = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("class_id", F.col("first.row").alias("kept"))
    dropped = materialize(found.filter("class_id IS NOT NULL").join(chosen, "class_id").filter("row <> kept").select("row").distinct(), "dropped")
    repeated = materialize(found.filter("class_id IS NOT NULL").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row"), "repeated")
    discard(found)
    name = free_name(docs, "row")
    named = docs.withColumn(name, row_name(docs))
    gone, twice = ((F.broadcast(x) if few(x) else x).withColumnRenamed("row", name) for x in (dropped, repeated))
    kept = named.join(gone, name, "left_anti")
    single = kept.join(twice, name, "left_anti")
    several = kept.join(twice, name, "left_semi").dropDuplicates([name])
    return single.unionByName(several).select(*docs.columns)
