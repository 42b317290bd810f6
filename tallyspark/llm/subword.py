"""Quality by supervised subword embeddings: hashed word, character n-gram and word-pair vectors, averaged over the
document, with a softmax on top, trained by stochastic gradient descent in numpy.

The model is fitted on a bounded sample of labelled training rows (`FIT_ROWS`, `FIT_FEATURES`); every document is scored over its
whole text. Case and punctuation stay, as they tell prose from debris. Training goes over the rows in the order of
their ids' hashes, so a model doesn't depend on how the tables are partitioned.

Rows: an empty or null text has no features and gets the softmax of the bias; a null id isn't held out; repeated rows
are scored each; without training rows of both labels every score is the share of label 1 (0 if there is none). Only
`doc_id` and `text` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl_of, discard, free_name, map_rows, materialize, mix64, small_batches
from .labelled import held_out_flag, training_rows

FIT_ROWS = 5_000
#: Features of all training rows together, 6 bytes each; the row that crosses the bound is the last one.
FIT_FEATURES = 40_000_000
BUCKETS = 1 << 15
WIDTH = 12
NGRAMS = (3, 4)
EPOCHS = 6
BATCH = 32
RATE = 0.4
THRESHOLD = 0.7
#: Documents that score at most this, the mirror of THRESHOLD, are rejected.
REJECTED = 0.3
CACHE = 200_000
#: A word after itself is one feature, whatever the word.
REPEAT = np.uint64(0x7E9EA7)


def grams(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    data = ("<" + word + ">").encode("utf-8", "surrogatepass")
    digest = xxhash.xxh32_intdigest
    return [digest(data) % BUCKETS, *(digest(data[i : i + n]) % BUCKETS for n in NGRAMS for i in range(len(data) - n + 1))]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words."""
    a, b = hashes[:-1], hashes[1:]
    return (np.where(a == b, REPEAT, mix64(a * np.uint64(31) ^ mix64(b))) % np.uint64(BUCKETS)).astype(np.int64)


class Words(dict):
    """Word -> row of arrays that hold its hash and, for a fitted model, its features' summed scores and number."""

    def __init__(self, scores: np.ndarray | None = None):
        super().__init__()
        self.scores = scores
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hash = np.zeros(1024, np.uint64)
        self.total, self.count = np.zeros(1024), np.zeros(1024)
        self.grams: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hash):
            self.hash, self.total, self.count = (np.concatenate([v, np.zeros_like(v)]) for v in (self.hash, self.total, self.count))
        own = grams(word)
        self.hash[at] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if self.scores is None:
            self.grams.append(np.array(own, np.uint16))
        else:
            self.total[at], self.count[at] = self.scores[own].sum(), len(own)
        self[word] = at
        return at

    def rows(self, text: str | None) -> np.ndarray:
        words = text.split() if text else []
        if len(self) + len(words) > CACHE and len(self) > len(words):
            self.reset()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Subword:
    """A fitted model. Averages are linear, so a bucket's vector times the output weights is one number per bucket."""

    def __init__(self, scores: np.ndarray | None, bias: float, prior: float):
        self.scores, self.bias, self.prior = scores, bias, prior

    def scorer(self):
        words = Words(self.scores)

        def score(text: str | None) -> float:
            if self.scores is None:
                return self.prior
            at = words.rows(text)
            total, count = words.total[at].sum(), words.count[at].sum()
            if len(at) > 1:
                pairs = pair_buckets(words.hash[at])
                total, count = total + self.scores[pairs].sum(), count + len(pairs)
            return float(1 / (1 + np.exp(-(total / max(count, 1) + self.bias))))

        return score


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """rows: (buckets, weights that sum to 1). Returns a score per bucket and a bias, as a difference of the two
    classes' softmax inputs. Steps are scaled per bucket by the gradients it has seen (AdaGrad)."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.log(np.array([(1 - y).mean(), y.mean()]) + 1e-3)
    seen, seen_out, seen_bias = np.full((BUCKETS, 1), 1e-8), np.full((WIDTH, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            sizes = np.array([len(rows[i][0]) for i in part])
            ids, weights = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            hidden = np.stack([np.bincount(doc, weights * vectors[ids, j], len(part)) for j in range(WIDTH)], 1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part].astype(int)] -= 1
            back = p @ out.T
            touched, place = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(place, weights * back[doc, j], len(touched)) for j in range(WIDTH)], 1)
            seen[touched] += (step**2).mean(1, keepdims=True)
            vectors[touched] -= RATE * 0.25 * step / np.sqrt(seen[touched])
            g = hidden.T @ p / len(part)
            seen_out += g**2
            out -= RATE * g / np.sqrt(seen_out)
            g = p.mean(0)
            seen_bias += g**2
            bias = bias - 0.2 * RATE * g / np.sqrt(seen_bias)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def features(words: Words, text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their weights, which sum to 1."""
    every = words.rows(text)
    if not len(every):
        return np.empty(0, np.uint16), np.empty(0, np.float32)
    at, times = np.unique(every, return_counts=True)
    own = [words.grams[i] for i in at]
    buckets = np.concatenate([*own, pair_buckets(words.hash[every])])
    weight = np.concatenate([np.repeat(times, [len(o) for o in own]), np.ones(len(every) - 1)])
    summed = np.bincount(buckets, weight, BUCKETS)
    ids = np.flatnonzero(summed)
    return ids.astype(np.uint16), (summed[ids] / summed.sum()).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most: int = FIT_ROWS) -> Subword:
    small_batches(docs.sparkSession)
    sample = materialize(training_rows(docs, labels, "quality", modulus, held_out, most), "quality-rows")

    def make():
        words = Words()

        def each(columns):
            rows = [features(words, text) for text in columns["text"].to_pylist()]
            return {c: columns[c] for c in ("mark", "doc_id", "label")} | {"buckets": pa.array([b.tobytes() for b, _ in rows], pa.binary()), "weights": pa.array([w.tobytes() for _, w in rows], pa.binary())}

        return each

    rows = materialize(map_rows(sample.select("mark", "doc_id", "text", "label"), "mark long, doc_id long, label int, buckets binary, weights binary", make), "quality-features")
    discard(sample)
    order = [("mark", "ascending"), ("doc_id", "ascending")]
    sizes = rows.select("mark", "doc_id", F.octet_length("buckets").alias("bytes")).toArrow().sort_by(order)  # at most `most` rows
    before = np.cumsum(sizes.column("bytes").to_numpy()) - sizes.column("bytes").to_numpy()
    last = int((before < 2 * FIT_FEATURES).sum()) - 1
    if last >= 0:
        mark, doc_id = sizes.column("mark")[last].as_py(), sizes.column("doc_id")[last].as_py()
        rows = rows.filter((F.col("mark") < mark) | ((F.col("mark") == mark) & (F.col("doc_id") <= doc_id)))
    got = rows.toArrow().sort_by(order)
    y = got.column("label").to_numpy().astype(float)
    prior = float(y.mean()) if len(y) else 0.0
    if len(set(y)) < 2:
        return Subword(None, 0.0, prior)
    given = [(np.frombuffer(b.as_buffer(), np.uint16), np.frombuffer(w.as_buffer(), np.float32)) for b, w in zip(got.column("buckets"), got.column("weights"))]
    return Subword(*train(given, y), prior)


def scorer(model: Subword, score: str, spark):
    shared = spark.sparkContext.broadcast((model.scores, model.bias, model.prior))  # one number per bucket

    def make():
        own = Subword(*shared.value).scorer()
        return lambda columns: {**columns, score: np.fromiter(map(own, columns["text"].to_pylist()), float, len(columns["text"]))}

    return make


def score_documents(docs: DataFrame, model: Subword, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on)."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long"), "text", held_out_flag(modulus, held_out).alias("held_out"))
    scored = map_rows(given, "doc_id long, held_out boolean, score double", scorer(model, "score", docs.sparkSession))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_poor(docs: DataFrame, model: Subword, threshold: float = REJECTED) -> DataFrame:
    """The rows and columns of `docs` that score above the threshold."""
    small_batches(docs.sparkSession)
    score = free_name(docs, "score")
    return map_rows(docs, f"{ddl_of(docs)}, {score} double", scorer(model, score, docs.sparkSession)).filter(F.col(score) > threshold).drop(score)
