"""Indel similarity of strings, in Arrow-batched UDFs over small sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tallyspark.functions import passages as passages_in
from tallyspark.functions.text import normalize_name


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per character of `a`, updated for each of `b`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a window of the longer, shorter windows at the edges included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@pandas_udf(DoubleType())
def token_sort_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b)])


#: Known names that go to every task at once, or belong to one group; of a list without groups more make more blocks.
MOST_NAMES = 10_000


def name_score(a: str, b: str) -> float:
    """How alike two folded names are: the best of three ratios."""
    return 100.0 if a == b else max(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b))


#: Pairs of names that are compared at once, names that are looked up at once, and bytes of one table of bits.
PAIRS, NAMES_AT_ONCE, TABLE = 4_000, 2_000, 16_000_000
#: By how much a computed bound may be too low.
SLACK = 1e-9


class Strings:
    """Strings as rows of character numbers, 0 beyond their ends and for characters outside of the alphabet."""

    def __init__(self, texts: list[str], alphabet: dict[str, int]):
        self.length = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), int(self.length.max(initial=0)) + 1), np.int32)
        for row, text in zip(self.codes, texts):
            row[: len(text)] = [alphabet.get(c, 0) for c in text]


def bits_of(codes: np.ndarray, limbs: int, kinds: int) -> np.ndarray:
    """By limb, string and character, where the character stands in the string."""
    out = np.zeros((limbs, len(codes), kinds), np.uint64)
    for i in range(codes.shape[1] - 1):
        rows = np.flatnonzero(codes[:, i])
        out[i // passages_in.BITS, rows, codes[rows, i]] |= np.uint64(1 << (i % passages_in.BITS))
    return out


def pair_pieces(a: Strings, x: np.ndarray, kinds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs in pieces of few enough different strings of `a`: their places, the bits of those strings, and by pair
    which of them is its own."""
    limbs = max(1, -(-(a.codes.shape[1] - 1) // passages_in.BITS))
    order, most = np.argsort(x, kind="stable"), max(1, TABLE // (8 * limbs * kinds))
    own, at = np.unique(x, return_inverse=True)
    for k in range(0, len(own), most):
        part = order[np.searchsorted(at[order], k) : np.searchsorted(at[order], k + most)]
        table = bits_of(a.codes[own[k : k + most]], limbs, kinds)
        for p in range(0, len(part), PAIRS):
            yield part[p : p + PAIRS], table, at[part[p : p + PAIRS]] - k


def scan(table: np.ndarray, which: np.ndarray, length: np.ndarray, codes: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray, each=None) -> np.ndarray:
    """LCS of strings, as bits, with `size` characters of others from `start` on; `each` gets it after each character."""
    limbs, bits = len(table), passages_in.BITS
    rows = np.full((limbs, len(which)), passages_in.FULL)
    own = np.clip(length - bits * np.arange(limbs)[:, None], 0, bits).astype(np.uint64)
    mask = (np.uint64(1) << own) - np.uint64(1)
    counted = lambda: np.bitwise_count(~rows & mask).sum(axis=0, dtype=np.int64)
    for j in range(int(size.max(initial=0))):
        at = np.minimum(start + j, codes.shape[1] - 1)
        hit = table[:, which, np.where(j < size, codes[row, at], 0)] & rows
        total = rows + hit
        for k in range(1, limbs):
            total[k] += total[k - 1] >> np.uint64(bits)
        rows = ((rows ^ hit) | total) & passages_in.FULL
        if each:
            each(j + 1, counted)
    return counted()


def pair_ratios(a: Strings, x: np.ndarray, b: Strings, y: np.ndarray, kinds: int) -> np.ndarray:
    """ratio of each pair."""
    out = np.empty(len(x))
    for part, table, which in pair_pieces(a, x, kinds):
        m, s = a.length[x[part]], b.length[y[part]]
        found = scan(table, which, m, b.codes, y[part], np.zeros(len(part), np.int64), s)
        out[part] = np.where(m + s > 0, 200.0 * found / np.maximum(m + s, 1), 100.0)
    return out


def pair_partial_ratios(a: Strings, x: np.ndarray, b: Strings, y: np.ndarray, kinds: int) -> np.ndarray:
    """partial_ratio of each pair, none of `a` longer than that of `b`: all windows are scanned side by side, those that
    begin before the longer as the beginnings of its first one."""
    out = np.empty(len(x))
    for part, table, which in pair_pieces(a, x, kinds):
        m, s = a.length[x[part]], b.length[y[part]]
        best = np.where((m == 0) & (s == 0), 100.0, 0.0)
        begins = np.arange(len(part))

        def beginning(n: int, counted) -> None:
            now = 200.0 * counted() / np.maximum(m + n, 1)
            best[:] = np.where(n <= m, np.maximum(best, now), best)

        scan(table, which, m, b.codes, y[part], np.zeros(len(part), np.int64), m, beginning)
        windows = np.where(m > 0, s, 0)
        pair = np.repeat(begins, windows)
        start = np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows)
        for k in range(0, len(pair), 8 * PAIRS):
            p, at = pair[k : k + 8 * PAIRS], start[k : k + 8 * PAIRS]
            size = np.minimum(m[p], s[p] - at)
            np.maximum.at(best, p, 200.0 * scan(table, which[p], m[p], b.codes, y[part][p], at, size) / (m[p] + size))
        out[part] = best
    return out


class NameList:
    """Known names, prepared so that few of them are compared with a name: the characters that two names share bound each
    of the three ratios, names are compared by falling bounds, and the search ends where the bound is below the best. Many
    names are looked up at once, the pairs as numpy vectors."""

    def __init__(self, keys: list[str], names: list[str]):
        self.keys, self.names = keys, names
        self.numbers = {c: i + 1 for i, c in enumerate(sorted(set("".join(keys))))}
        self.kinds = len(self.numbers) + 1
        self.plain, self.sorted = Strings(keys, self.numbers), Strings([" ".join(sorted(k.split())) for k in keys], self.numbers)
        self.counts = self.counted(self.plain)
        self.place = np.empty(len(names), np.int64)  # of equal scores the last name counts
        self.place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        self.by_place = np.argsort(self.place)

    def counted(self, strings: Strings) -> np.ndarray:
        out = np.zeros((self.kinds, len(strings.codes)), np.int32)
        for column in strings.codes.T:
            np.add.at(out, (column, np.arange(len(column))), 1)
        return out[1:]

    def bounds(self, plain: Strings, tokens: Strings) -> np.ndarray:
        """By name and known name, what their score is at most."""
        own = self.counted(plain)
        shared = np.zeros((len(plain.codes), len(self.keys)), np.int64)
        for c in np.flatnonzero(own.any(axis=1)):
            shared += np.minimum(own[c][:, None], self.counts[c][None, :])
        over = lambda top, under: np.where(under > 0, 200.0 * top / np.maximum(under, 1), 100.0)
        a, b = plain.length[:, None], self.plain.length[None, :]
        short = np.minimum(a, b)
        inside = np.minimum(shared, short)
        # a window of the longer may be cut at its edges down to the characters that are shared
        return np.maximum.reduce([over(shared, a + b), over(inside, short + inside), over(shared, tokens.length[:, None] + self.sorted.length[None, :])])

    def scores(self, plain: Strings, tokens: Strings, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """name_score of pairs of names that aren't equal."""
        out = np.maximum(pair_ratios(self.plain, k, plain, x, self.kinds), pair_ratios(self.sorted, k, tokens, x, self.kinds))
        longer = plain.length[x] > self.plain.length[k]  # of equal ones the windows are the known name's
        for which, part in ((longer, (self.plain, k, plain, x)), (~longer, (plain, x, self.plain, k))):
            at = np.flatnonzero(which)
            if len(at):
                a, i, b, j = part
                out[at] = np.maximum(out[at], pair_partial_ratios(a, i[at], b, j[at], self.kinds))
        return out

    def best(self, name: str) -> tuple[float, str | None]:
        """The score of the most similar known name; of equal ones the last by name."""
        return self.best_of([name])[0]

    def best_of(self, names: list[str]) -> list[tuple[float, str | None]]:
        if not self.keys:
            return [(0.0, None)] * len(names)
        size = max(1, min(NAMES_AT_ONCE, 2_000_000 // len(self.keys)))
        return [b for k in range(0, len(names), size) for b in self.best_of_few(names[k : k + size])]

    def best_of_few(self, names: list[str]) -> list[tuple[float, str | None]]:
        plain, tokens = Strings(names, self.numbers), Strings([" ".join(sorted(n.split())) for n in names], self.numbers)
        bound = self.bounds(plain, tokens)
        order = np.argsort(-bound, axis=1, kind="stable")
        score, place = np.full(len(names), -1.0), np.full(len(names), -1, np.int64)
        left, at, step = np.arange(len(names)), 0, 1
        equal: dict[str, int] = {}
        for k in sorted(range(len(self.keys)), key=self.place.__getitem__):
            equal[self.keys[k]] = k
        for i, name in enumerate(names):
            if name in equal:
                score[i], place[i] = 100.0, self.place[equal[name]]
        while len(left) and at < len(self.keys):
            known = order[left, at : at + step]
            x, k = np.repeat(left, known.shape[1]), known.ravel()
            keep = bound[x, k] >= score[x] - SLACK
            x, k = x[keep], k[keep]
            if len(x):
                found = self.scores(plain, tokens, x, k)
                ranked = np.lexsort((self.place[k], found, x))
                last = ranked[np.flatnonzero(np.append(x[ranked][1:] != x[ranked][:-1], True))]
                better = (found[last] > score[x[last]]) | (found[last] == score[x[last]]) & (self.place[k[last]] > place[x[last]])
                last = last[better]
                score[x[last]], place[x[last]] = found[last], self.place[k[last]]
            at, step = at + step, min(2 * step, 64)
            if at < len(self.keys):
                left = left[bound[left, order[left, at]] >= score[left] - SLACK]
        return [(float(s), self.names[self.by_place[p]]) for s, p in zip(score, place)]


def nearest_names(names: DataFrame, known: DataFrame, accept: float = 70.0, doubtful: float = 50.0, by: str | None = None) -> DataFrame:
    """name, best, score, confidence (high, low or none): the known name most like each name, of equal ones the last by
    name. Names alike but for case, quotes and spaces are found by a join; the rest is compared with the known names of
    the same `by` (then a column of the result too), of which one value may have MOST_NAMES, or with all of them, which go
    to the tasks in blocks of MOST_NAMES. A null name is like nothing."""
    keep = [by] if by else []
    listed = known.filter("name IS NOT NULL").select(*keep, normalize_name(F.col("name")).alias("_key"), "name").distinct()
    equal = listed.groupBy(*keep, "_key").agg(F.max("name").alias("_equal"))
    joined = names.select(*keep, "name", F.coalesce(normalize_name(F.col("name")), F.lit("")).alias("_key")).join(equal, [*keep, "_key"], "left")
    exact = joined.filter("_equal IS NOT NULL").select(*keep, "name", F.col("_equal").alias("best"), F.lit(100.0).alias("score"))
    rest = joined.filter("_equal IS NULL").select(*keep, "name", "_key")
    scored = nearest_in_groups(rest, listed, by) if by else nearest_in_blocks(rest, listed)
    kind = F.when(F.col("score") >= accept, "high").when(F.col("score") >= doubtful, "low").otherwise("none")
    return exact.unionByName(scored).select(*keep, "name", F.when(kind != "none", F.col("best")).alias("best"), "score", kind.alias("confidence"))


def nearest_in_blocks(rest: DataFrame, listed: DataFrame) -> DataFrame:
    """name, best, score over all known names, a block at a time: each sends MOST_NAMES names to the tasks, and its best
    are kept if they are better than those before. A name is compared once, however often it occurs."""
    order = Window.orderBy("name")
    blocks = listed.withColumn("_block", F.floor((F.row_number().over(order) - 1) / MOST_NAMES))
    session = rest.sparkSession
    out = rest.select("_key").distinct().repartition(int(session.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_key")).withColumn("b", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("best")))
    for (block,) in blocks.select("_block").distinct().orderBy("_block").collect():
        rows = blocks.filter(F.col("_block") == block).select("_key", "name").collect()
        shared = session.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        out = out.withColumn("b", F.greatest("b", best_of(shared)("_key")))
    return rest.join(out, "_key").select("name", "b.best", "b.score")


def best_of(shared):
    @pandas_udf("score double, best string")
    def found(keys: pd.Series) -> pd.DataFrame:
        listed = NameList(*shared.value)
        own = sorted(set(keys))
        distinct = dict(zip(own, listed.best_of(own)))
        return pd.DataFrame([distinct[k] for k in keys], columns=["score", "best"])

    return found


def nearest_in_groups(rest: DataFrame, listed: DataFrame, by: str) -> DataFrame:
    """by, name, best, score over the known names of the same group."""
    sized = listed.groupBy(by).agg(F.when(F.count(F.lit(1)) > MOST_NAMES, F.raise_error(F.lit(f"more than {MOST_NAMES} known names of one group"))).otherwise(F.sort_array(F.collect_list(F.struct("_key", "name")))).alias("_known"))
    kinds = dict(rest.dtypes)

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, listed = object(), None
        for frame in frames:
            for value, rows in frame.groupby(by, sort=False, dropna=False):
                if listed is None or value != group:
                    known = rows["_known"].iloc[0]
                    group, listed = value, NameList([k["_key"] for k in known], [k["name"] for k in known])
                found = listed.best_of(list(rows["_key"]))
                yield pd.DataFrame({by: rows[by].values, "name": rows["name"].values, "best": [b for _, b in found], "score": [s for s, _ in found]})

    # a name is compared once in its group; groups of many names are dealt over tasks, each group's rows side by side
    once = rest.select(by, "_key").distinct().withColumn("name", F.col("_key")).repartition(by, F.pmod(F.xxhash64("_key"), F.lit(16))).sortWithinPartitions(by)
    best = once.join(sized, by).mapInPandas(found, f"`{by}` {kinds[by]}, name string, best string, score double").select(by, F.col("name").alias("_key"), "best", "score")
    return rest.join(best, [by, "_key"], "left").select(by, "name", "best", F.coalesce("score", F.lit(0.0)).alias("score"))


def promote_key(payload: Column, canonical: str, accept: float = 70.0) -> Column:
    """A struct (payload, error): a map that has the key as it is; else with the key most like it, whatever their case,
    under that name, from a ratio of `accept` on; else as it is, with an error that tells the best ratio. Of equally
    similar keys the first counts."""

    @pandas_udf("keys array<string>, ratio double")
    def renamed(keys: pd.Series) -> pd.DataFrame:
        rows = []
        for own in keys:
            own = [] if own is None else list(own)
            scores = [ratio(k.lower(), canonical.lower()) for k in own]
            best = max(scores, default=0.0)
            if canonical not in own and best >= accept:
                own[scores.index(best)] = canonical
            rows.append((own, best))
        return pd.DataFrame(rows, columns=["keys", "ratio"])

    found = renamed(F.map_keys(payload))
    held = F.map_from_arrays(found["keys"], F.map_values(payload))
    message = F.concat(F.lit(f"no key like {canonical}, at best "), F.round(found["ratio"], 1).cast("string"))
    return F.struct(held.alias("payload"), F.when(~F.array_contains(found["keys"], canonical), message).alias("error"))


def best_window(passage: str, words: list[str]) -> tuple[float, int, int]:
    """The ratio of the run of words most like a passage, and where it lies; of equal ones the first."""
    n, best = len(passage.split()), (0.0, 0, 0)
    shown = lambda ws: " ".join(w for w in map(passages_in.fold, ws) if w)
    for i in range(len(words) - n + 1):
        score = ratio(shown(words[i : i + n]), shown(passage.split()))
        if score > best[0]:
            best = (score, i, i + n)
    return best


#: Characters of passages that go to every task at once; more passages make more passes over the documents. Characters of
#: documents that a task holds at once in the first pass and in the second, where more of them make fuller vectors.
BLOCK_CHARS, LOOK_CHARS, FIND_CHARS = 4_000_000, 1_000_000, 2_000_000


def held_texts(frames: Iterator[pd.DataFrame], chars: int, alphabet: passages_in.Alphabet | None = None) -> Iterator[tuple[list, passages_in.Texts]]:
    """Documents' ids and texts, about `chars` characters at a time."""
    for ids, texts in passages_in.batches(((i, t) for frame in frames for i, t in zip(frame["doc_id"], frame["text"])), chars):
        ranks = {d: k for k, d in enumerate(sorted(set(ids)))}
        yield ids, passages_in.Texts(texts, alphabet, [ranks[d] for d in ids])


def locate_passages(passages: DataFrame, docs: DataFrame, accept: float = 70.0) -> DataFrame:
    """passage_id, doc_id, score, start, stop (words): the document that holds each passage's most similar run of as many
    words, without punctuation and whatever the case, from a ratio of `accept` on; of equal ones the smallest id's first.

    Passages are the queries: they go to the documents in blocks of BLOCK_CHARS characters, and each task returns its best
    run of each. A first pass finds every run that equals a passage, which nothing exceeds, and of the others what a few runs
    that share words with it reach at least. Where no run equals a passage, a second pass counts every run of the different
    texts, see functions.passages. Documents are dealt over all tasks. Null and empty passages, and documents shorter than a passage,
    have none; a null doc_id isn't found."""
    if accept <= 0:
        raise ValueError("a ratio above 0")
    kind = {"p": dict(passages.dtypes)["passage_id"], "d": dict(docs.dtypes)["doc_id"]}
    sizes = passages.select("passage_id", "passage", F.length(F.coalesce("passage", F.lit(""))).alias("_chars")).filter("_chars > 0 AND passage_id IS NOT NULL")
    blocks = sizes.withColumn("_block", F.floor((F.sum("_chars").over(Window.orderBy("passage_id", "passage").rowsBetween(Window.unboundedPreceding, 0)) - 1) / BLOCK_CHARS))
    fields = f"passage_id {kind['p']}, doc_id {kind['d']}, score double, start int, stop int"
    session = docs.sparkSession
    whole, tasks = docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    given = whole.repartition(tasks)
    copied_once = whole.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text").repartition(tasks)
    out = None
    for (block,) in blocks.select("_block").distinct().orderBy("_block").collect():
        rows = blocks.filter(F.col("_block") == block).select("passage_id", "passage").collect()
        shared = session.sparkContext.broadcast([tuple(r) for r in rows])

        def first_look(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = [text for _, text in shared.value]
            places, ready = passages_in.places_of(passages), passages_in.prepare(passages)[1]
            reached: dict[int, float] = {}
            equal: dict[int, tuple] = {}
            for ids, texts in held_texts(frames, LOOK_CHARS):
                for k, (d, a) in passages_in.equal_runs(places, ready, texts).items():
                    equal[k] = min(equal.get(k, (ids[d], a)), (ids[d], a))
                    reached[k] = 100.0
                for k, score in passages_in.guessed(places, ready, texts, ratio, reached).items():
                    reached[k] = max(reached.get(k, 0.0), score)
            yield pd.DataFrame([(k, s, *equal.get(k, (None, None))) for k, s in reached.items()], columns=["k", "score", "doc_id", "start"]).astype({"doc_id": object, "start": "Int32"})

        looked = given.mapInPandas(first_look, f"k int, score double, doc_id {kind['d']}, start int").groupBy("k")
        seen = {r.k: r for r in looked.agg(F.max("score").alias("score"), F.min(F.when(F.col("start").isNotNull(), F.struct("doc_id", "start"))).alias("equal")).collect()}
        ends = {k: r.equal.start + len(rows[k].passage.split()) for k, r in seen.items() if r.equal and accept <= 100.0}
        reached = {k: r.score for k, r in seen.items()}
        part = session.createDataFrame([(rows[k].passage_id, seen[k].equal.doc_id, 100.0, seen[k].equal.start, end) for k, end in ends.items()], fields)

        # without a word character a passage is like nothing
        rest = [k for k, r in enumerate(rows) if k not in ends and any(map(passages_in.fold, r.passage.split()))]

        def found(frames: Iterator[pd.DataFrame], shared=shared, reached=reached, rest=rest) -> Iterator[pd.DataFrame]:
            alphabet, ready = passages_in.prepare([text for _, text in shared.value])
            rest = sorted(rest, key=lambda k: ready[k].n)
            best: dict[int, tuple] = {}
            for ids, texts in held_texts(frames, FIND_CHARS, alphabet):
                for k in rest:
                    least = max(accept, reached.get(k, 0.0), best[k][0] if k in best else 0.0)
                    hit = passages_in.most_like(ready[k], texts, least)
                    if hit:
                        hit = (hit[0], ids[hit[1]], hit[2], hit[2] + ready[k].n)
                        best[k] = min(best.get(k, hit), hit, key=lambda h: (-h[0], h[1], h[2]))
            yield pd.DataFrame([(shared.value[k][0], d, s, a, b) for k, (s, d, a, b) in best.items()], columns=["passage_id", "doc_id", "score", "start", "stop"])

        if rest:
            part = part.unionByName(copied_once.mapInPandas(found, fields))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = session.createDataFrame([], fields)
    best = out.groupBy("passage_id").agg(F.min_by(F.struct("doc_id", "score", "start", "stop"), F.struct(-F.col("score"), "doc_id", "start")).alias("b"))
    return best.select("passage_id", "b.*")
