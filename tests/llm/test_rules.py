import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def prose(rng, n):
    words = [rng.choice(["stone", "river", "Élan", "quiet", "the", "of", "window", "ñandú"]) + rng.choice(["", "s", "ed", "ly", "ing"]) + rng.choice("abcdefghij") for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def texts():
    rng = random.Random(4)
    odd = ["", None, " \n\t ", "one", "a b a b a b", "x y z x y z", "line\nline\n line\n\nline", "<a>|b*\x1f# $", "\U0001f600 é", "a\x85b a\x85b"]
    return odd + [" ".join(rng.choices("ab#*\n", k=rng.randint(0, 90))) for _ in range(60)] + [prose(rng, rng.randint(40, 400)) for _ in range(60)]


def junk(rng, kind, n):
    words = prose(rng, n).split()
    return {"marks": " ".join(w + "###" for w in words), "shout": " ".join(w.upper() + "!!" for w in words), "table": " | ".join(words), "stutter": " ".join(w for w in words[:12] for _ in range(n // 12))}[kind]


def test_counts_against_brute_force(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, rows[5], (None, "a null id", "x", 5)], "doc_id long, text string, kept string, n_words int").repartition(4)
    got = rules.judge(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = brute(rows[r.doc_id][1] if r.doc_id is not None else "a null id")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1


def test_debris_goes_and_prose_stays(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, rng.randint(60, 500))) for i in range(400)]
    poor = [(1000 + i, junk(rng, kind, rng.randint(80, 400))) for i, kind in enumerate(["marks", "shout", "table", "stutter"] * 15)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(good + poor, "doc_id long, text string")).collect()}
    assert sum(got[i].kept for i, _ in good) >= 396
    assert not any(got[i].kept for i, _ in poor)


def test_estimation_against_a_plain_loop():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.8
    right, wrong = np.array([0.995, 0.99, 0.992, 0.999]), np.array([0.6, 0.3, 0.5, 0.2])
    called = np.where(truth[:, None], rng.random((3000, 4)) < right, rng.random((3000, 4)) > wrong)
    votes = np.where(rng.random((3000, 4)) < 0.2, 0, np.where(called, 1, -1))
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    found = rules.estimate(patterns, times.astype(float))
    share, good, poor = rules.SHARE, [rules.GOOD] * 4, [rules.POOR] * 4
    for _ in range(rules.ROUNDS):
        p = []
        for v in votes:
            a, b = share, 1 - share
            for k in range(4):
                a *= {1: good[k], -1: 1 - good[k], 0: 1}[int(v[k])]
                b *= {1: 1 - poor[k], -1: poor[k], 0: 1}[int(v[k])]
            p.append(a / (a + b))
        p = np.array(p)
        before = (share, *good, *poor)
        share = (p.sum() + rules.SHARE * rules.PRIOR) / (len(p) + rules.PRIOR)
        good = [max((p[votes[:, k] == 1].sum() + rules.GOOD * rules.PRIOR) / (p[votes[:, k] != 0].sum() + rules.PRIOR), 1 - rules.FALSE) for k in range(4)]
        poor = [((1 - p)[votes[:, k] == -1].sum() + rules.POOR * rules.PRIOR) / ((1 - p)[votes[:, k] != 0].sum() + rules.PRIOR) for k in range(4)]
        if max(abs(a - b) for a, b in zip(before, (share, *good, *poor))) < rules.STILL:
            break
    assert found.share == pytest.approx(share, abs=1e-6)
    assert list(found.good) == pytest.approx(good, abs=1e-6) and list(found.poor) == pytest.approx(poor, abs=1e-6)


def test_empty_table_and_one_row(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (row,) = rules.judge(spark.createDataFrame([(1, prose(random.Random(1), 80))], "doc_id long, text string")).collect()
    assert row.kept


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(rules, "NAMES", 1000)
    text = prose(random.Random(2), 200_000)
    rows = [(1, text), (2, "b " * 3), (3, text[: len(text) // 3])]
    for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(rows[r.doc_id - 1][1])
