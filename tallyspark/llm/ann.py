"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids, codebooks and the share of the lists that a query probes are fitted on a bounded sample (`FIT_ROWS`): one half
of it trains, and on the other half the share is taken at which `COVERED` of the true neighbours lie in the probed lists.
Every vector is indexed. A query probes the lists whose centroids have the largest inner products with it, ranks their
members by asymmetric distance tables, and the best are ranked again by the exact double-precision inner product on the
original vectors. An exact check follows: how far a vector lies from what its codes say bounds its product, and so do a
list's radius and longest vector those of the list. Members and lists that these bounds don't rule out are compared with
the query too, so no row is missed, whatever the rows are; the sample only decides how much is left to the check.

Neighbouring lists are gathered into blocks of at most `BLOCK_ROWS` members, and a longer list is dealt over several
blocks; queries are dealt over parts of about `GROUP_QUERIES`. A task's group is one block of members and one part of
the queries that probe it, so no group grows with the table. Members are sent once for each part of the queries.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part; neither do null ids. Of
repeated rows (equal id and vector) one counts; an id with different vectors keeps each, and a query never finds its
own id. Inner products need equal lengths: vectors of another length than the most frequent one take no part. Ties go to
the smaller id. A query with fewer than `k` candidates gets them all. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

FIT_ROWS = 40_000
SUBSPACES = 16
CODES = 256
#: Most lists, and the rows of the training half that each should have.
LISTS = 1024
LIST_ROWS = 16
#: The share of true neighbours that the probed lists hold, as measured on the sample with so many of its rows as queries.
COVERED = 0.955
MEASURED = 512
#: A query's lists hold at least so many rows.
LEAST_ROWS = 800
#: How many of a block's candidates are ranked exactly, per query, before the others are held against the last of them.
RERANK = 200
#: What single-precision sums may be off, as a part of the lengths, and pairs whose products are taken at once.
SLACK, PAIRS = 1e-5, 65_536
BLOCK_ROWS = 8_192
#: Queries of one group, and of one slice of it for which distance tables are held.
GROUP_QUERIES = 8_192
SLICE = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        centers[count > 0] = sums[count > 0] / count[count > 0, None]
        empty = np.flatnonzero(count == 0)
        centers[empty] = x[rng.choice(len(x), len(empty))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids, residual codebooks and the share to probe: a few hundred KB."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        train, held = (sample[::2], sample[1::2]) if len(sample) > 2 * LEAST_ROWS else (sample, sample[:0])
        lists = int(min(LISTS, max(1, round(4 * rows**0.5)), max(1, len(train) // LIST_ROWS)))
        centers = kmeans(train, lists)
        # lists of one neighbourhood get neighbouring numbers
        self.centers = centers[np.argsort(nearest(centers, kmeans(centers, max(1, lists // 16))), kind="stable")]
        residual = train - self.centers[nearest(train, self.centers)]
        parts = min(SUBSPACES, sample.shape[1])
        self.edges = np.linspace(0, sample.shape[1], parts + 1).astype(int)
        codes = min(CODES, len(train))
        self.books = [kmeans(np.ascontiguousarray(residual[:, a:b]), codes, 6) for a, b in zip(self.edges, self.edges[1:])]
        self.reach = float(np.sqrt((self.centers**2).sum(1)).max(initial=0) + np.sqrt(sum((b**2).sum(1).max(initial=0) for b in self.books)))
        self.share = self.measure(held, k)

    def measure(self, held: np.ndarray, k: int) -> float:
        """The share of the rows in the lists of the best inner products that hold COVERED of the true neighbours, for
        queries and members that the centroids weren't trained on; 1 where there are too few."""
        if len(held) <= max(k, LEAST_ROWS):
            return 1.0
        at = nearest(held, self.centers)
        rows = np.bincount(at, minlength=len(self.centers))
        reached = []
        for lo in range(0, min(MEASURED, len(held)), 64):
            q = held[lo : min(lo + 64, MEASURED)]
            near = q @ held.T
            near[np.arange(len(q)), lo + np.arange(len(q))] = -np.inf
            true = np.argpartition(-near, k, 1)[:, :k]
            order = np.argsort(-(q @ self.centers.T), 1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(self.centers))[None], 1)
            upto = np.cumsum(rows[order], 1)
            reached.append(np.take_along_axis(upto, np.take_along_axis(place, at[true], 1), 1).ravel())
        return float(np.quantile(np.concatenate(reached), COVERED) / len(held))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list and codes, its distance from the list's centroid, and from what list and codes say."""
        at = nearest(x, self.centers)
        residual = x - self.centers[at]
        codes = np.stack([nearest(residual[:, a:b], book) for book, a, b in zip(self.books, self.edges, self.edges[1:])], 1).astype(np.uint8)
        left = residual - np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], 1)
        return at, codes, lengths(residual), lengths(left)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of each query's parts with each code."""
        return [(q[:, a:b] @ book.T).astype(np.float32) for book, a, b in zip(self.books, self.edges, self.edges[1:])]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id IS NOT NULL").filter(whole).filter(F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def stacked(column, dtype) -> np.ndarray:
    """Binary values of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def deal_queries(probed: DataFrame, queries: int, most: int) -> tuple[DataFrame, int]:
    """A column `part` that deals the queries over parts of about `most`, and the number of those parts."""
    parts = max(1, -(-queries // most))
    return probed.withColumn("part", F.pmod(F.xxhash64("query_id", "q"), parts).cast("int")), parts


def lay_out(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each list's first block, and its number of blocks: short lists share a block of at most `most` rows."""
    first, number, block, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
    for at, n in enumerate(counts.tolist()):
        if n > most:
            first[at], number[at] = block + 1, -(-n // most)
            block, room = block + int(number[at]), 0
            continue
        if n > room or block < 0:
            block, room = block + 1, most
        first[at], room = block, room - n
    return first, number


def approximate(index: Index, ids: np.ndarray, v: np.ndarray, lists: np.ndarray, codes: np.ndarray, off: np.ndarray, q: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """Which of a block's open members (sorted by list) may be among each query's `k` best, by distance tables: the exact
    products of those that look best rule out all whose bound is lower."""
    names, starts = np.unique(lists, return_index=True)
    near = np.full((len(q), len(v)), -np.inf, np.float32)
    tables, coarse = index.tables(q), (q @ index.centers[names].T).astype(np.float32)
    for at, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(v)])):
        rows = np.flatnonzero(open_[:, lo:hi].any(1))
        if len(rows):
            score = np.repeat(coarse[rows, at, None], hi - lo, 1)
            for j, table in enumerate(tables):
                score += table[rows][:, codes[lo:hi, j]]
            near[rows, lo:hi] = score
    near[~open_] = -np.inf
    if len(v) <= max(RERANK, k) or len(np.unique(ids)) < len(ids):  # an id with several vectors counts once among k
        return open_
    best = np.argpartition(-near, RERANK - 1, 1)[:, : max(RERANK, k)]
    every = np.arange(len(q))[:, None]
    exact = np.where(open_[every, best], np.einsum("bd,brd->br", q, v[best]), -np.inf)
    edge = -np.partition(-exact, k - 1, 1)[:, k - 1]
    length = lengths(q)[:, None]
    return open_ & ~(near + length * (off + SLACK * (index.reach + off)) < edge[:, None])


def best_of_block(ids: np.ndarray, v: np.ndarray, own: np.ndarray, q: np.ndarray, open_: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, member and exact product of each query's `k` best open members of a block, but for those below `least`."""
    need = np.flatnonzero(open_.any(0))
    ids, v, open_ = ids[need], v[need], open_[:, need]
    product = np.where(open_, q @ v.T, -np.inf)
    edge = least.copy()
    if len(ids) > k and len(np.unique(ids)) == len(ids):
        edge = np.maximum(edge, -np.partition(-product, k - 1, 1)[:, k - 1])
    # a matrix product rounds by its place, so equal vectors are told apart only by sums that don't
    slack = 1e-12 * lengths(q) * lengths(v).max(initial=0)
    at, member = np.nonzero(open_ & ~(product < (edge - slack)[:, None]))
    exact = np.concatenate([np.einsum("pd,pd->p", q[at[lo : lo + PAIRS]], v[member[lo : lo + PAIRS]]) for lo in range(0, len(at), PAIRS)] or [np.empty(0)])
    order = np.lexsort((-exact, ids[member], at))
    at, found, exact = at[order], ids[member[order]], exact[order]
    once = np.ones(len(at), bool)
    once[1:] = (at[1:] != at[:-1]) | (found[1:] != found[:-1])
    at, found, exact = at[once], found[once], exact[once]
    order = np.lexsort((found, -exact, at))
    at, found, exact = at[order], found[order], exact[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    good = (place < k) & (exact >= least[at])
    return own[at[good]], found[good], exact[good]


def search(vectors: DataFrame, modulus: int = 20, k: int = 20, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `modulus`, its `k` nearest."""
    spark = vectors.sparkSession
    every = usable(vectors)
    sizes = every.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = every.filter(F.size("v") == sizes[0]["size"]).distinct()
    chosen = every.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(FIT_ROWS).select(F.col("v").cast("array<float>").alias("v"))
    shared = spark.sparkContext.broadcast(Index(matrix(chosen.toArrow().column("v")).astype(np.float64), sizes[0]["n"], k))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                at, codes, far, off = shared.value.encode(v)
                columns = [pa.array([x.tobytes() for x in v], pa.binary()), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(far), pa.array(lengths(v))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], names=["vec_id", "v", "list", "codes", "off", "far", "length"])

    indexed = materialize(every.mapInArrow(encode, "vec_id long, v binary, list int, codes binary, off double, far double, length double"), "index")
    filled = {r["list"]: r for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("length").alias("length")).collect()}  # at most LISTS rows
    counts, radius, longest = (np.array([filled[i][c] if i in filled else 0 for i in range(len(shared.value.centers))]) for c in ("n", "far", "length"))
    first, number = lay_out(counts, block_rows)
    wanted = max(LEAST_ROWS + 20 * k, int(np.ceil(shared.value.share * counts.sum())))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each block that holds lists to probe, with those lists: the nearest ones, or where there is
        a least product, the others that it doesn't rule out."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q, least = stacked(batch.column("v").to_pylist(), np.float64), batch.column("least").to_numpy(zero_copy_only=False)
            score = q @ shared.value.centers.T
            order = np.argsort(-score, 1, kind="stable")
            before = np.cumsum(counts[order], 1) - counts[order]
            taken = np.empty(order.shape, bool)
            np.put_along_axis(taken, order, before < wanted, 1)
            length = lengths(q)[:, None]
            bound = np.minimum(score + length * radius, length * longest) + SLACK * length * (shared.value.reach + longest)
            taken = np.where(np.isnan(least)[:, None], taken, ~taken & ~(bound < least[:, None])) & (counts > 0)
            probes = []
            for row in taken:
                lists = np.flatnonzero(row)
                at, start = np.unique(first[lists], return_index=True)
                groups = zip(at.tolist(), np.split(lists.astype(np.int32), start[1:]))
                probes.append([{"block": b, "lists": own.tobytes()} for a, own in groups for b in range(a, a + int(number[own[0]]))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "least")), pa.array(probes, pa.list_(pa.struct([("block", pa.int32()), ("lists", pa.binary())])))], names=["query_id", "q", "least", "probes"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members with their block; a list of several is dealt over them by the ids."""
        for batch in batches:
            at = batch.column("list").to_numpy()
            block = first[at] + (batch.column("mark").to_numpy() % number[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "list", "codes", "off")), pa.array(block.astype(np.int32))], names=["vec_id", "v", "list", "codes", "off", "block"])

    queries = indexed.filter(F.col("vec_id") % modulus == 0).select("vec_id", "v")
    asked = queries.count()
    members = indexed.withColumn("mark", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))).mapInArrow(place, "vec_id long, v binary, list int, codes binary, off double, block int")

    def matching(checks: bool):
        def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """A block's members against a part of the queries that probe it."""
            out = []
            if len(left) and len(right):
                right = right.sort_values(["list", "vec_id"], kind="stable")
                ids, lists = right["vec_id"].to_numpy(), right["list"].to_numpy()
                v, codes, off = stacked(right["v"], np.float64), stacked(right["codes"], np.uint8), right["off"].to_numpy()
                names, which = np.unique(lists, return_inverse=True)
                own, q, least = left["query_id"].to_numpy(), stacked(left["q"], np.float64), left["least"].fillna(-np.inf).to_numpy()
                probes = np.stack([np.isin(names, np.frombuffer(x, np.int32)) for x in left["lists"]])
                for lo in range(0, len(own), SLICE):
                    at = slice(lo, lo + SLICE)
                    open_ = probes[at][:, which] & (own[at, None] != ids[None, :])
                    if not checks:
                        open_ = approximate(shared.value, ids, v, lists, codes, off, q[at], open_, k)
                    out.append(best_of_block(ids, v, own[at], q[at], open_, least[at], k))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

        return match

    def matched(queries: DataFrame, checks: bool) -> DataFrame:
        probed = queries.mapInArrow(probe, "query_id long, q binary, least double, probes array<struct<block:int,lists:binary>>").select("query_id", "q", "least", F.inline("probes"))
        probed, parts = deal_queries(probed, asked, group_queries)
        dealt = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return probed.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInPandas(matching(checks), "query_id long, vec_id long, score double")

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    best = materialize(ranked(matched(queries.withColumn("least", F.lit(None).cast("double")), False)), "found")
    if wanted < counts.sum():
        # lists that weren't probed, against the least product that still counts
        last = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        left = queries.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        probed, best = best, materialize(ranked(best.select("query_id", "vec_id", "score").unionByName(matched(left, True))), "found")
        discard(probed)
    discard(indexed)
    return best.select("query_id", "rank", "vec_id", "score")
