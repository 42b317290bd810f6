"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon (a short fixed list, and words and word beginnings that the training labels mark),
how near its words stand to second-person words, rates of capitals, punctuation, obfuscated and stretched words.
All of it is learned from a bounded sample of training rows (`FIT_ROWS`) by cross-fitting, so that few labels go as far
as they can: a row's features come from the lexicon of the other folds, the trees learn from these, and the calibration
from margins of trees that haven't seen the row's fold; the lexicon that scores is that of all folds. Every document is
scored over its whole text.

Rows: a null or empty text has all features 0 and is scored like any other; a null id isn't held out; repeated rows are
scored each; without training rows of both labels every score is the share of label 1 (0 if there is none). Only
`doc_id` and `text` are read, so clashing names don't matter.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl_of, discard, free_name, map_rows, materialize, small_batches
from .labelled import held_out_flag, training_rows

FIT_ROWS = 20_000
#: Most terms of a learned lexicon.
LEXICON = 500
#: Folds of the cross-fitting, and standard errors by which a term's log-odds must differ from 0.
FOLDS, SURE = 5, 2.0
THRESHOLD = 0.7
CACHE = 200_000

# Insults that need no labels to be told, and words that address the reader.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile cretin bastard jerk vermin idiota imbécil estúpido estúpida basura dumm dummkopf trottel abschaum connard crétin débile ordure".split()
SECOND_PERSON = "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros os tus".split()

STRONG, MILD, PERSON = 1, 2, 4
WORD = re.compile(r"[^\W_]+").findall
OBFUSCATED = re.compile(r"(?<![^\W_])[^\W\d_]+[0-9@$*!][0-9@$*!]*[^\W\d_][\w@$*!]*").findall
STRETCHED = re.compile(r"([^\W\d_])\1{2,}").findall
PLAIN = str.maketrans("013457@$!", "oieastasi")
PREFIXES = (4, 5, 6)
#: Words on either side within which a second-person word counts as near.
NEAR = 6

FEATURES = ("strong", "strong_share", "mild", "mild_share", "near_person", "person", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits", "obfuscated", "obfuscated_hits", "stretched", "log_words")


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings (marked with a hyphen)."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def learn_lexicons(rows: DataFrame, most: int = LEXICON) -> list[dict[str, int]]:
    """Terms that stand in far more documents of label 1, STRONG or MILD by log-odds: for each fold those of all other
    folds, and last those of all rows. One count per document; a term must be told from chance (`SURE` standard errors)."""

    def make():
        def each(columns):
            terms = [sorted({t for w in set(WORD(text.lower())) if len(w) > 2 for t in terms_of(w)}) for text in columns["text"].to_pylist()]
            return {"label": columns["label"], "fold": columns["fold"], "terms": terms}

        return each

    lexicons = [dict.fromkeys(INSULTS, STRONG) for _ in range(FOLDS + 1)]
    totals = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    views = []
    for left_out in range(FOLDS + 1):
        views.append(tuple(sum(n for (fold, label), n in totals.items() if fold != left_out and label == which) for which in (1, 0)))
    if not all(ones and zeros for ones, zeros in views):
        return lexicons
    counted = map_rows(rows.select("text", "label", "fold"), "label int, fold int, terms array<string>", make).select("label", "fold", F.explode("terms").alias("term"))
    per_fold = [F.sum(F.when(F.col("fold") == k, which).otherwise(0)).alias(f"{name}{k}") for k in range(FOLDS) for name, which in (("ones", F.col("label")), ("all", F.lit(1)))]
    counted = counted.groupBy("term").agg(F.sum("label").alias("ones"), F.count("*").alias("all"), *per_fold).filter("ones > 1")

    def view(left_out: int):
        """(fold left out, ones, zeros of the others)"""
        ones, every = (F.col(c) if left_out == FOLDS else F.col(c) - F.col(f"{c}{left_out}") for c in ("ones", "all"))
        return F.struct(F.lit(left_out).alias("left_out"), ones.alias("one"), (every - ones).alias("zero"), F.lit(views[left_out][0]).alias("ones"), F.lit(views[left_out][1]).alias("zeros"))

    seen = counted.select("term", F.explode(F.array(*map(view, range(FOLDS + 1)))).alias("v")).select("term", "v.*")
    odds = F.log((F.col("one") + 0.5) / (F.col("ones") + 1.0)) - F.log((F.col("zero") + 0.5) / (F.col("zeros") + 1.0))
    error = F.sqrt(1 / (F.col("one") + 0.5) + 1 / (F.col("zero") + 0.5))
    found = seen.filter((F.col("one") > 1) & (F.col("one") * 100 >= F.col("ones"))).withColumn("odds", odds).filter((F.col("odds") > 1.5) & (F.col("odds") > SURE * error))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("left_out").orderBy(F.desc(F.col("odds") / error), "term"))).filter(F.col("rank") <= most)
    for r in best.select("left_out", "term", "odds").collect():  # at most `most` for each lexicon
        lexicons[r["left_out"]][r["term"]] = STRONG if r["odds"] > 3.5 else MILD
    return lexicons


class Featurizer(dict):
    """Remembers each word's classes; turns texts into feature rows."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon, self.person = lexicon, frozenset(SECOND_PERSON)

    def __missing__(self, word: str) -> int:
        flags = PERSON if word in self.person else 0
        for term in terms_of(word):
            flags |= self.lexicon.get(term, 0)
        if len(self) >= CACHE:
            self.clear()
        self[word] = flags
        return flags

    def row(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        words = WORD(text.lower())
        n = len(words)
        flags = np.fromiter(map(self.__getitem__, words), np.uint8, n)
        strong, mild, person = (np.flatnonzero(flags & bit) for bit in (STRONG, MILD, PERSON))
        near = 0
        if len(strong) and len(person):
            at = np.searchsorted(person, strong)
            before, after = person[np.maximum(at - 1, 0)], person[np.minimum(at, len(person) - 1)]
            near = int((np.minimum(abs(strong - before), abs(after - strong)) <= NEAR).sum())
        data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        letters = data[65:91].sum() + data[97:123].sum()
        size, per = max(len(text), 1), max(n, 1)
        hidden = OBFUSCATED(text) if data[48:58].sum() + data[64] + data[36] + data[42] + data[33] else []
        found = sum(1 for w in hidden if self[w.rstrip("!*$@").lower().translate(PLAIN)] & STRONG)
        shouted = sum(map(str.isupper, text.split()))
        out[:] = (
            np.log1p(len(strong)), len(strong) / per, np.log1p(len(mild)), len(mild) / per, np.log1p(near), len(person) / per,
            data[65:91].sum() / max(letters, 1), shouted / per, data[33] / size, data[63] / size,
            (data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum()) / size, data[48:58].sum() / size,
            len(hidden) / per, np.log1p(found), len(STRETCHED(text)) / per, np.log1p(n),
        )
        return out


class Boosted:
    """Regression trees on binned features, boosted on logistic loss with second-order leaf values."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0):
        self.count, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self.binned(x)
        self.trees, margin = [], np.full(len(y), self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self.rate * self.walk(tree, binned)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def grow(self, binned, g, h) -> list[tuple[int, int, float]]:
        """Nodes in heap order: (feature or -1, last bin of the left side, leaf value)."""
        nodes = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for node in range(len(nodes)):
            if node not in rows:
                continue
            at = rows.pop(node)
            gs, hs = g[at].sum(), h[at].sum()
            best = (1e-6, -1, 0)
            if node < 2**self.depth - 1:
                for j in range(binned.shape[1]):
                    n = len(self.edges[j]) + 1
                    if n == 1:
                        continue
                    column = binned[at, j]
                    gl, hl = (np.cumsum(np.bincount(column, v[at], n))[:-1] for v in (g, h))
                    fits = (hl >= self.least) & (hs - hl >= self.least)
                    gain = np.where(fits, gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            nodes[node] = (best[1], best[2], float(-gs / (hs + self.ridge)))
            if best[1] >= 0:
                left = binned[at, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return nodes

    def walk(self, tree, binned) -> np.ndarray:
        feature, split, value = (np.array(v) for v in zip(*tree))
        node = np.zeros(len(binned), np.int64)
        every = np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[node]
            step = 2 * node + 1 + (binned[every, np.maximum(f, 0)] > split[node])
            node = np.where(f >= 0, step, node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return self.base + self.rate * sum(self.walk(t, binned) for t in self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) between which scores are interpolated. Rows of one margin
    are one pool from the start. A tenth of a row, half of it of label 1, is added to each pool, so none claims
    certainty."""
    at, back, times = np.unique(margin, return_inverse=True, return_counts=True)
    pools: list[list[float]] = []  # [sum of labels, rows, sum of margins]
    for m, label, n in zip(at, np.bincount(back, y, len(at)), times):
        pools.append([float(label), float(n), float(m * n)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    ones, rows, sums = np.array(pools).T
    return sums / rows, np.maximum.accumulate((ones + 0.05) / (rows + 0.1))


class Toxicity:
    """A fitted model; it is small and goes to the tasks with their code."""

    def __init__(self, lexicon: dict[str, int], trees: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.prior)
        margin = self.trees.margin(x)
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most: int = FIT_ROWS) -> Toxicity:
    rows = training_rows(docs, labels, "toxic", modulus, held_out, most).withColumn("fold", (F.col("part") % FOLDS).cast("int"))
    rows = materialize(rows.drop("part"), "toxicity-rows")
    lexicons = learn_lexicons(rows)

    def make():
        own = [Featurizer(lexicon) for lexicon in lexicons[:FOLDS]]

        def each(columns):
            x = [own[fold].row(t).tolist() for t, fold in zip(columns["text"].to_pylist(), columns["fold"].to_pylist())]
            return {c: columns[c] for c in ("mark", "doc_id", "label", "fold")} | {"x": x}

        return each

    # at most `most` rows of features
    got = map_rows(rows.select("mark", "doc_id", "text", "label", "fold"), "mark long, doc_id long, label int, fold int, x array<double>", make).toArrow()
    discard(rows)
    got = got.sort_by([("mark", "ascending"), ("doc_id", "ascending")])
    y, fold = got.column("label").to_numpy().astype(float), got.column("fold").to_numpy()
    x = np.array(got.column("x").to_pylist()).reshape(len(y), len(FEATURES))
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y)) < 2:
        return Toxicity(lexicons[-1], None, None, prior)
    trees, margin = Boosted().fit(x, y), np.zeros(len(y))
    for k in sorted(set(fold.tolist())):
        others = fold != k
        margin[~others] = (Boosted().fit(x[others], y[others]) if others.any() else trees).margin(x[~others])
    return Toxicity(lexicons[-1], trees, isotonic(margin, y), prior)


def scorer(model: Toxicity, score: str):
    def make():
        own = Featurizer(model.lexicon)

        def each(columns):
            x = np.array([own.row(t) for t in columns["text"].to_pylist()]).reshape(-1, len(FEATURES))
            return {**columns, score: model.scores(x)}

        return each

    return make


def score_documents(docs: DataFrame, model: Toxicity, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long"), "text", held_out_flag(modulus, held_out).alias("held_out"))
    return map_rows(given, "doc_id long, held_out boolean, score double", scorer(model, "score")).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of `docs` whose score is below the threshold."""
    small_batches(docs.sparkSession)
    score = free_name(docs, "score")
    return map_rows(docs, f"{ddl_of(docs)}, {score} double", scorer(model, score)).filter(F.col(score) < threshold).drop(score)
