"""The runs of words in texts that are most like given passages, without missing any.

Runs that equal a passage are found by the sums of their characters' powers (hashes of all runs from one running sum), and
compared then. A passage that has none needs more: a ratio of 70 lets so many characters differ that no shared word or run
of characters is certain, so every run counts. The longest common subsequence (LCS) of a passage with a stretch of text
bounds those of all runs within the stretch; stretches grow until they rule nothing out, and the next one begins with the
first run left. LCSs are computed for many stretches at once, one bit for a passage's character in limbs of 63 bits, as
numpy vectors over the stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

NOT_WORD = re.compile(r"[^\w\s]")
#: Runs compared between two looks at the best, runs that a processor's cache holds at once, and stretches at once at least.
RUNS, LANES, LEAST_LANES = 20_000, 4_000, 500
#: Runs dealt to a lane at once, at most, as a multiple of the passage's words, and those that a look at one rules out at most.
DEALT, AHEAD = 8, 16
#: Bits of a limb, below the one that takes the carry.
BITS = 63
FULL = np.uint64(2**BITS - 1)
#: By how much a product of a ratio may be too large.
SLACK = 1e-6
#: Words that a passage and a run share in a row where a good run is guessed, runs tried for a passage and batch, and places
#: in passages from which on shared words tell nothing.
SHARED, GUESSES, COMMON = 3, 4, 50
#: Characters whose hash is looked up for equal runs, and bits of the hash that the first look takes.
BEGINS, LOOK = 16, 18
#: An odd factor for the hashes, and its inverse, both modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)


def fold(word: str) -> str:
    """A word without punctuation, in lower case."""
    return NOT_WORD.sub("", word).lower()


def folded_words(text: str) -> list[str]:
    """A text's words between spaces, folded; some may be empty."""
    return list(map(fold, text.split()))


class Alphabet(dict):
    """Characters of the passages by numbers; 0 is any other."""

    def __missing__(self, c: str) -> int:
        return 0


@dataclass
class Passage:
    """n: its words as given; bits: by limb and character, where the character stands in the folded text."""

    n: int
    text: str
    bits: np.ndarray

    @property
    def length(self) -> int:
        return len(self.text)


def prepare(texts: list[str | None]) -> tuple[Alphabet, list[Passage]]:
    """The passages' alphabet and their tables."""
    folded = [folded_words(t or "") for t in texts]
    shown = [" ".join(w for w in words if w) for words in folded]
    alphabet = Alphabet({c: i + 1 for i, c in enumerate(sorted(set("".join(shown))))})
    out = []
    for words, text in zip(folded, shown):
        bits = np.zeros((max(1, -(-len(text) // BITS)), len(alphabet) + 1), np.uint64)
        limb, place = np.divmod(np.arange(len(text)), BITS)
        np.bitwise_or.at(bits, (limb, np.array([alphabet[c] for c in text], np.intp)), np.uint64(1) << place.astype(np.uint64))
        out.append(Passage(len(words), text, bits))
    return alphabet, out


@lru_cache(8)
def powers_up_to(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(factor: int, n: int) -> np.ndarray:
    """The first n; tables are kept, by sizes that are powers of two."""
    return powers_up_to(factor, 1 << max(n - 1, 1).bit_length())[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_of(text: str) -> int:
    """What Texts.hashes has for the same characters."""
    return int((code_points(text).astype(np.uint64) * powers(FACTOR, len(text))).sum(dtype=np.uint64))


class Texts:
    """Many texts, folded, as one array of characters; words and runs of words are ranges of it.

    first, last: where a word begins and ends; an empty one begins where the next does and ends where the last did. doc,
    word: its text and its place in it. rank: of a text, where texts with one id, which have the same, aren't told apart."""

    def __init__(self, texts: list[str | None], alphabet: Alphabet | None = None, rank: list[int] | None = None):
        shown, counts, held = [], [], []
        for text in texts:
            words = (text or "").split()
            folded = NOT_WORD.sub("", text or "").lower().split()
            shown.append(" ".join(folded))
            counts.append(len(words))
            held.append(np.ones(len(words), bool) if len(folded) == len(words) else np.fromiter((fold(w) != "" for w in words), bool, len(words)))
        # no text has a character 0, as folding drops it
        self.text = "\0" + "".join(t + "\0" for t in shown)
        self.codes = code_points(self.text)
        apart = (self.codes == 32) | (self.codes == 0)
        first = np.append(np.flatnonzero(apart[:-1] & ~apart[1:]) + 1, len(apart) - 1)
        last = np.append(np.flatnonzero(~apart[:-1] & apart[1:]) + 1, 0)
        full = np.concatenate([*held, np.empty(0, bool)])
        before = np.cumsum(full)
        self.first, self.last = first[before - full], last[before - 1]
        self.begins = np.cumsum([0, *counts])
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.word = np.arange(len(full)) - self.begins[self.doc]
        if alphabet is not None:
            numbers = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int32)
            for c, i in alphabet.items():
                numbers[ord(c)] = i
            self.chars = np.take(numbers, self.codes, mode="clip")
        self.rank = np.arange(len(texts)) if rank is None else np.array(rank, np.int64)
        self.sized: tuple[int, np.ndarray] = (0, np.empty(0))

    @cached_property
    def sums(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes * powers(FACTOR, len(self.codes)), dtype=np.uint64)])

    @cached_property
    def inverse(self) -> np.ndarray:
        return powers(INVERSE, len(self.codes) + 1)

    def earliest(self, words: np.ndarray) -> tuple[int, int]:
        """(text, word) of the first of some words: of the lowest rank, and of texts of one rank where it stands first."""
        at = words[np.lexsort((self.word[words], self.rank[self.doc[words]]))[0]]
        return int(self.doc[at]), int(self.word[at])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of ranges of characters; equal ones have equal hashes."""
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    @cached_property
    def ended(self) -> np.ndarray:
        """Words that end at each place or before it."""
        return np.cumsum(np.bincount(self.last, minlength=len(self.codes)))

    def least(self, n: int) -> np.ndarray:
        """By word, characters of the shortest of the AHEAD runs of n words from there on, or fewer."""
        if self.sized[0] != n:
            out = np.maximum(self.last[n - 1 :] - self.first[: len(self.first) - n + 1], 0)
            step = 1
            while step < AHEAD:
                out[:-step] = np.minimum(out[:-step], out[step:])
                step *= 2
            self.sized = (n, out)
        return self.sized[1]


def step(bits: np.ndarray, seen: np.ndarray, rows: np.ndarray, hit: np.ndarray, total: np.ndarray, carry: np.ndarray) -> None:
    """Take one more character of each lane into its LCS."""
    np.take(bits, seen, axis=1, out=hit, mode="clip")
    hit &= rows
    np.add(rows, hit, out=total)
    for k in range(1, len(rows)):
        np.right_shift(total[k - 1], np.uint64(BITS), out=carry)
        total[k] += carry
    rows ^= hit
    rows |= total
    rows &= FULL


def counted(rows: np.ndarray) -> np.ndarray:
    """The lanes' LCSs: bits beyond a passage's end stay."""
    return BITS * len(rows) - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)


def common(passage: Passage, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """LCS of the passage with each range of characters."""
    out = np.empty(len(start), np.int64)
    for k in range(0, len(start), LANES):
        out[k : k + LANES] = common_of_lanes(passage, chars, start[k : k + LANES], stop[k : k + LANES])
    return out


def common_of_lanes(passage: Passage, chars: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    size = stop - start
    rows = np.full((len(passage.bits), len(start)), FULL)
    hit, total, carry = np.empty_like(rows), np.empty_like(rows), np.empty(len(start), np.uint64)
    every = int(size.min(initial=0))
    for j in range(int(size.max(initial=0))):
        at = start + j
        seen = chars[at] if j < every else np.where(at < stop, chars[np.minimum(at, len(chars) - 1)], 0)
        step(passage.bits, seen.astype(np.intp), rows, hit, total, carry)
    return counted(rows)


def left_over(passage: Passage, texts: Texts, accept: float) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs that stretches don't rule out, and what their LCSs are at most."""
    n, m = passage.n, passage.length
    # each text's runs, dealt to as many lanes as there is room for
    begins, ends = texts.begins[:-1], texts.begins[1:] - n + 1
    begins, ends = begins[ends > begins], ends[ends > begins]
    lanes = max(LEAST_LANES, 4 * LANES // len(passage.bits))
    dealt = min(max(int((ends - begins).sum()) // lanes, n), DEALT * n)
    pieces = -(-(ends - begins) // dealt)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    queue = np.repeat(begins, pieces) + dealt * within
    until = np.minimum(queue + dealt, np.repeat(ends, pieces))
    taken = min(len(queue), lanes)
    # of each lane: the stretch's first word, the first run that isn't ruled out, where its runs end; the next character
    lo, done, end = queue[:taken].copy(), queue[:taken].copy(), until[:taken].copy()
    at = texts.first[lo]
    least, columns = texts.least(n), max(4, min(32, m // 10))
    rows = np.full((len(passage.bits), taken), FULL)
    hit, total, carry = np.empty_like(rows), np.empty_like(rows), np.empty(taken, np.uint64)
    ahead = np.arange(columns)[:, None]
    found, bounds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(lo):
        seen = np.take(texts.chars, at + ahead, mode="clip").astype(np.intp)
        for row in seen:
            step(passage.bits, row, rows, hit, total, carry)
        at += columns
        held = counted(rows)
        covered = np.minimum(np.minimum(np.take(texts.ended, at, mode="clip") - n + 1, done + AHEAD), end)
        new = covered > done
        out = new & (200.0 * held < accept * (m + least[done]) - SLACK)
        stuck = new & ~out
        alone = np.flatnonzero(stuck & (lo == done))
        size = covered[alone] - done[alone]
        found.append(np.repeat(done[alone] - np.cumsum(size) + size, size) + np.arange(size.sum()))
        bounds.append(np.repeat(held[alone], size))
        out[alone] = True
        done = np.where(out, covered, done)
        stuck = np.flatnonzero(stuck)
        lo[stuck] = done[stuck]
        over = np.flatnonzero(done >= end)
        more = over[: len(queue) - taken]
        lo[more] = done[more] = queue[taken : taken + len(more)]
        end[more] = until[taken : taken + len(more)]
        taken += len(more)
        again = np.concatenate([stuck[done[stuck] < end[stuck]], more])
        at[again] = texts.first[lo[again]]
        rows[:, again] = FULL
        if len(over) > len(more):
            keep = done < end
            lo, done, end, at, rows = lo[keep], done[keep], end[keep], at[keep], np.ascontiguousarray(rows[:, keep])
            hit, total, carry = np.empty_like(rows), np.empty_like(rows), np.empty(len(lo), np.uint64)
    return np.concatenate(found), np.concatenate(bounds)


def most_like(passage: Passage, texts: Texts, accept: float) -> tuple[float, int, int] | None:
    """(ratio, text, first word) of the best run of as many words as the passage has, from `accept` on; of equal ones the
    first by the texts' rank and the place in them. A passage without a word character is like nothing."""
    n, m = passage.n, passage.length
    if m == 0 or len(texts.first) < n:
        return None
    runs, bound = left_over(passage, texts, accept)
    start = texts.first[runs]
    stop = np.maximum(texts.last[runs + n - 1], start)
    size, best = stop - start, accept
    score = np.full(len(runs), -1.0)
    for part in np.array_split(np.argsort(-bound, kind="stable"), -(-len(runs) // RUNS) or 1):
        part = part[200.0 * bound[part] >= best * (m + size[part]) - SLACK]
        if len(part):
            score[part] = 200.0 * common(passage, texts.chars, start[part], stop[part]) / (m + size[part])
            best = max(best, score[part].max())
    top = score.max(initial=-1.0)
    return (float(top), *texts.earliest(runs[score == top])) if top >= accept else None


class Hashes:
    """Hashes with the numbers that belong to each."""

    def __init__(self, pairs: list[tuple[int, int | tuple[int, int]]]):
        held: dict[int, list] = {}
        for h, number in pairs:
            held.setdefault(h, []).append(number)
        self.keys = np.array(sorted(held), np.uint64)
        self.held = [held[int(h)] for h in self.keys]
        self.look = np.zeros(1 << LOOK, bool)
        self.look[self.keys >> np.uint64(64 - LOOK)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are among these, and their places here."""
        some = np.flatnonzero(self.look[hashes >> np.uint64(64 - LOOK)])
        place = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        same = self.keys[place] == hashes[some] if len(self.keys) else np.zeros(len(some), bool)
        return some[same], place[same]


@dataclass
class Places:
    """begins: passages by the hash of their first characters, by how many these are; runs: (passage, word) where each
    SHARED words in a row stand."""

    begins: dict[int, Hashes]
    runs: Hashes


def places_of(texts: list[str | None]) -> Places:
    runs, begins = [], {}
    for k, text in enumerate(texts):
        words = folded_words(text or "")
        shown = " ".join(w for w in words if w)
        if shown:
            begins.setdefault(min(BEGINS, len(shown)), []).append((hash_of(shown[:BEGINS]), k))
        for i, run in enumerate(zip(*(words[j:] for j in range(SHARED)))):
            if any(run):
                runs.append((hash_of(" ".join(w for w in run if w)), (k, i)))
    return Places({size: Hashes(pairs) for size, pairs in begins.items()}, Hashes(runs))


def equal_runs(places: Places, ready: list[Passage], texts: Texts) -> dict[int, tuple[int, int]]:
    """(text, first word) of each passage's first run with equal characters, by the texts' rank and the place in them."""
    out = {}
    for size, begins in places.begins.items():
        start = texts.first[texts.first + size <= len(texts.codes)]  # these are the first ones
        word, place = begins.found(texts.hashes(start, start + size))
        order = np.argsort(place, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
            for k in begins.held[place[part[0]]] if len(part) else ():
                n, m = ready[k].n, ready[k].length
                at = word[part]
                at = at[at + n <= len(texts.doc)]
                at = at[(texts.last[at + n - 1] - texts.first[at] == m) & (texts.doc[at] == texts.doc[at + n - 1])]
                at = at[[texts.text[i : i + m] == ready[k].text for i in texts.first[at]]]
                if len(at):
                    out[k] = texts.earliest(at)
    return out


def guessed(places: Places, ready: list[Passage], texts: Texts | list[str | None], ratio, known: dict[int, float] | None = None) -> dict[int, float]:
    """The best ratio of each passage with a few of the runs that share words in a row with it: what its best run reaches
    at least. Passages whose `known` ratio is 100 are left out."""
    known, best = known or {}, {}
    texts = texts if isinstance(texts, Texts) else Texts(texts)
    if len(texts.first) < SHARED:
        return best
    start = texts.first[: 1 - SHARED]
    word, place = places.runs.found(texts.hashes(start, np.maximum(texts.last[SHARED - 1 :], start)))
    tries: dict[int, dict[int, int]] = {}
    for i, p in zip(word.tolist(), place.tolist()):
        for k, at in places.runs.held[p] if len(places.runs.held[p]) <= COMMON else ():
            if known.get(k) != 100.0:
                tried = tries.setdefault(k, {})
                tried[i - at] = tried.get(i - at, 0) + 1
    for k, tried in tries.items():
        n = ready[k].n
        for begin in sorted((i for i, count in tried.items() if count > n // 8), key=lambda i: -tried[i])[:GUESSES]:
            if begin >= 0 and begin + n <= len(texts.doc) and texts.doc[begin] == texts.doc[begin + n - 1] and best.get(k) != 100.0:
                best[k] = max(best.get(k, 0.0), ratio(texts.text[texts.first[begin] : texts.last[begin + n - 1]], ready[k].text))
    return best


def batches(texts: Iterator[tuple[int, str | None]], chars: int = 1_000_000) -> Iterator[tuple[list[int], list[str | None]]]:
    """Texts with their ids, about `chars` characters at a time."""
    ids, held, size = [], [], 0
    for i, text in texts:
        ids.append(i)
        held.append(text)
        size += len(text or "")
        if size >= chars:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held
