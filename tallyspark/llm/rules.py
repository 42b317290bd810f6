"""Quality rules by weak supervision: each rule calls a document good or poor or abstains, expectation-maximisation
estimates how often a rule is right on either kind, and a document is kept by its posterior probability of being good.

Documents are counted by the pattern of their votes, at most 3^10 patterns, so the estimation reads a bounded table
whatever the number of documents. A rule has two accuracies among the documents on which it doesn't abstain: the share of
good ones that it calls good and the share of poor ones that it calls poor. The second may be low, as a rule knows one
kind of debris; then its praise tells little and its blame much. `PRIOR` documents' worth of the accuracies to begin
with stays in each estimate, which is what decides on very few documents. The order of rows doesn't matter.

Rows: null and empty texts have no words, fail the base and take no part in the estimation; null ids and repeated rows
are judged each; texts of any length are read whole, in slices; an empty table gives no rows. Only `doc_id` and `text`
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, small_batches, word_slices

SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Distinct words that a task names by numbers.
NAMES = 1_000_000
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_capitals long, n_bare long, n_mixed long, n_ends long"

#: (name, count, of, poor from, good up to): a share of `count` in `of` that is at least the one is poor, at most the
#: other good, between them the rule abstains.
SHARES = (
    ("symbols", "n_symbols", "n_words", 0.2, 0.05),
    ("repeats", "n_repeat_words", "n_words", 0.45, 0.2),
    ("lines", "n_dup_lines", "n_lines", 0.4, 0.2),
    ("capitals", "n_capitals", "word_chars", 0.3, 0.12),
    ("bare", "n_bare", "n_words", 0.15, 0.03),
    ("mixed", "n_mixed", "n_words", 0.15, 0.03),
    ("endings", "n_ends", "n_words", 0.45, 0.3),
)
#: Words over which a text needs some variety and sentence ends before their absence is held against it.
LONG = 100
NAMES_OF_RULES = (*(s[0] for s in SHARES), "variety", "sentences", "length")
#: Accuracies to begin with: good ones called good, poor ones called poor, the share of good documents; and their weight.
GOOD, POOR, SHARE, PRIOR = 0.99, 0.4, 0.85, 20.0
#: A rule blames at most this share of the good documents on which it votes: that is how it is written, and it keeps the
#: estimation from taking a whole kind of debris for good because only its own rules blame it.
FALSE = 0.01
ROUNDS, STILL = 200, 1e-9


class Words(dict):
    """Word -> number; with flags 1: no letter or digit, 2: ends a sentence, 4: symbols beside letters or digits."""

    def __init__(self):
        super().__init__()
        self.flags = bytearray()

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "surrogatepass")
        bare = not any(map(str.isalnum, text))
        self.flags.append(bare | (text[-1] in ".!?…") << 1 | (not bare and any(c in SYMBOLS for c in word)) << 2)
        number = self[word] = len(self)
        return number


def repeated(a: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(a) < 4:
        return 0
    _, pair = np.unique(a[:-1] << 32 | a[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] << 32 | a[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : len(a) - 2 + k] |= again
    return int(covered.sum())


def measure(words: Words, text: str) -> tuple[int, ...]:
    """The counts of COUNTS after doc_id."""
    data = text.encode("utf-8", "surrogatepass")
    if len(words) > NAMES:
        words.clear()
        words.flags.clear()
    parts = [np.fromiter(map(words.__getitem__, part), np.int64, len(part)) for part in word_slices(data)]
    a = np.concatenate(parts) if parts else np.empty(0, np.int64)
    flags = np.frombuffer(bytes(words.flags), np.uint8)
    without = lambda what: len(data) - len(data.translate(None, what))
    lines = [line for line in data.split(b"\n") if line.strip()]
    held = flags[a]
    return (len(a), len(text) - without(SPACES), without(SYMBOLS), len(lines) - len(set(lines)), repeated(a), len(lines), len(np.unique(a)), without(CAPITALS), *(int(np.count_nonzero(held & bit)) for bit in (1, 4, 2)))


def rule_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of each row's whole text."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in COUNTS.split(", ")][1:]

    def make():
        words = Words()

        def each(columns):
            rows = np.array([measure(words, t) for t in columns["text"].to_pylist()], np.int64).reshape(-1, len(names))
            return {"doc_id": columns["doc_id"]} | {name: rows[:, i] for i, name in enumerate(names)}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), COUNTS, make)


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of COUNTS: 1 good, -1 poor, 0 abstains."""
    words = F.col("n_words")
    vote = lambda poor, good: F.when(poor, -1).when(good, 1).otherwise(0)
    out = {name: vote((F.col(count) >= poor * F.col(of)) & (F.col(of) > 0), F.col(count) <= good * F.col(of)) for name, count, of, poor, good in SHARES}
    out["variety"] = F.when(words >= LONG, vote(F.col("n_distinct") < 0.1 * F.sqrt(LONG * words), F.col("n_distinct") > 0.2 * F.sqrt(LONG * words))).otherwise(0)
    out["sentences"] = F.when(words >= LONG, vote(F.col("n_ends") < 0.015 * words, F.col("n_ends") > 0.05 * words)).otherwise(0)
    mean = F.col("word_chars") / F.greatest(words, F.lit(1))
    out["length"] = vote((mean < 2.5) | (mean > 15), mean.between(3.5, 11))
    return out


@dataclass
class Accuracies:
    """share: of good documents; good, poor: by rule, how often it is right on documents of that kind."""

    share: float
    good: np.ndarray
    poor: np.ndarray

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of being good: to begin with, and by rule for a vote of good and one of poor."""
        return float(np.log(self.share / (1 - self.share))), np.log(self.good / (1 - self.poor)), np.log((1 - self.good) / self.poor)


def estimate(patterns: np.ndarray, times: np.ndarray) -> Accuracies:
    """patterns: votes by document pattern and rule; times: its documents."""
    praise, blame = patterns > 0, patterns < 0
    rules = patterns.shape[1]
    now = Accuracies(SHARE, np.full(rules, GOOD), np.full(rules, POOR))
    for _ in range(ROUNDS):
        start, up, down = now.weights()
        good = times / (1 + np.exp(-(start + praise @ up + blame @ down)))
        poor = times - good
        after = Accuracies(
            (good.sum() + SHARE * PRIOR) / (times.sum() + PRIOR),
            np.maximum((good @ praise + GOOD * PRIOR) / (good @ (praise | blame) + PRIOR), 1 - FALSE),
            (poor @ blame + POOR * PRIOR) / (poor @ (praise | blame) + PRIOR),
        )
        moved = max(abs(after.share - now.share), np.abs(after.good - now.good).max(), np.abs(after.poor - now.poor).max())
        now = after
        if moved < STILL:
            break
    return now


def fit(counts: DataFrame) -> Accuracies:
    """The rules' accuracies over all rows of `counts` that have a word. At most 3^10 patterns reach the driver."""
    rules = list(NAMES_OF_RULES)
    seen = counts.filter("n_words > 0").select(*[v.alias(name) for name, v in votes().items()]).groupBy(*rules).agg(F.count(F.lit(1)).alias("times"))
    table = seen.toArrow().sort_by([(r, "ascending") for r in rules])
    return estimate(np.array([table.column(r).to_numpy() for r in rules], np.int64).T.reshape(-1, len(rules)), table.column("times").to_numpy().astype(float))


def posterior(found: Accuracies) -> Column:
    """A row's probability of being good, from its COUNTS."""
    start, up, down = found.weights()
    odds = F.lit(start)
    for (name, vote), praise, blame in zip(votes().items(), up, down):
        odds = odds + F.when(vote > 0, float(praise)).when(vote < 0, float(blame)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept. The counts are a
    written table in the shared folder, which the result reads; it goes with that folder."""
    counts = materialize(rule_counts(docs), "rule-counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.select("*", failed.alias("base_failed"), posterior(fit(counts)).alias("posterior"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))
