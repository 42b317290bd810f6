import random
import re
from collections import Counter

import pytest

from tallyspark.llm import collocations as co


def brute(rows, max_n, least, percent, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, folded = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked, place = set(), Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.add((lang, place[lang], phrase.decode(), -a, left, right, total, -score))
    return ranked


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Élan", "x\x00y", "naïve", "a", "B", "c d", "zz", "\U0001f600", "É"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", "; ", "\x0b", "!"]
    rows = []
    for _ in range(120):
        parts = [rng.choice(["new york city", "of the", "a b c d e f", "Élan zz"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(p + rng.choice(ends) for p in parts)))
    return rows + [("en", ""), ("en", None), (None, " . . "), ("de", "only once here")]


@pytest.mark.parametrize("max_n,least,percent,top", [(5, 8, 100, 2000), (5, 8, 60, 3), (3, 4, 100, 10), (2, 4, 100, 10)])
def test_against_brute_force(spark, max_n, least, percent, top):
    rows = corpus(max_n + least)
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "lang string, text string, phrase string, f int").repartition(5)
    got = co.collocations(docs, max_n, least, percent, top).collect()
    assert {tuple(r) for r in got} == brute(rows, max_n, least, percent, top)
    assert len(got) == len({(r.lang, r.rank) for r in got}) > 0


def test_small_filters_and_blocks_lose_nothing(spark, monkeypatch):
    rows = corpus(3)
    for name in ("BLOCK", "NAMES", "SLICE"):
        monkeypatch.setattr(co, name, 40)
    full = co.bloom
    monkeypatch.setattr(co, "bloom", lambda keys: full(keys) | co.np.uint64(2**64 - 1))  # a filter that holds everything
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in co.collocations(docs, 5, 8, 100, 2000).collect()} == brute(rows, 5, 8, 100, 2000)


def test_a_hot_language_repeated_rows_and_a_long_text(spark):
    rows = [("en", "alpha beta gamma. " * 40_000), *[("en", "alpha beta delta")] * 150, *[("fr", "alpha beta")] * 99]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = co.collocations(docs).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 100, 100, 2000)
    assert {r.lang for r in got} == {"en"}


def test_products_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 10**13), ("en", 1, "b", 10**13), ("en", 2, "a b", 10**13 - 1)], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    (row,) = co.scored(counts.filter("words > 1"), counts, totals).collect()
    assert row.score == 1000 * (10**13 - 1) * 10**16 // 10**26


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert co.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []
