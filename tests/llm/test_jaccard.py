import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import jaccard
from tallyspark.llm.components import connected_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset({tuple(words)} if words else ())


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    smallest = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return Counter((d, len(sets[i]), smallest[find(i)]) for i, (d, _) in enumerate(rows)), [find(i) for i in range(len(rows))]


def corpus(seed=0, families=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    passage = rng.choices(words, k=60)
    for _ in range(families):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 15, 30, 80, 200, 500]))
        if rng.random() < 0.3:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            n += rng.randint(1, 9)
            rows.append((n, " ".join(w.upper() if rng.random() < 0.1 else w for w in copy)))
    rng.shuffle(rows)
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "one"), (None, "one"), (None, "alone here"), rows[0], (rows[1][0], "same id other text"), (9006, "long text of words " * 4000), (9007, "long text of words " * 4000 + "x")]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 0), (5, 80, 1), (3, 50, 2)])
def test_against_brute_force(spark, width, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as key", "3 as row").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_components(docs, width, percent).collect())
    assert got == brute(rows, width, percent)[0]


def test_keep_one(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as class_id").repartition(3)
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    _, group = brute(rows, 5, 80)
    want = Counter()
    for g in set(group):
        members = [r for r, h in zip(rows, group) if h == g]
        if not shingles(members[0][1], 5):
            want.update(members)
        else:
            want[min((d is None, d) for d, _ in members)] += 1
    got = kept.collect()
    assert Counter((r.doc_id is None, r.doc_id) if shingles(r.text, 5) else (r.doc_id, r.text) for r in got) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_components(docs).collect() == []
    assert jaccard.keep_one(docs).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    for n in [2, 3, 5, 9, 10, 11, 19, 20, 37, 100, 260, 1000, 5000]:
        for _ in range(8):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            most = int(n * (100 - percent) / percent)
            extra = rng.integers(0, most + 1)
            lost = 0 if extra else rng.integers(0, int(n * (100 - percent) / 100) + 1)
            b = np.concatenate([a[lost:], rng.integers(0, 1 << 63, extra).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            assert 100 * common >= percent * (len(a) + len(b) - common)
            if len(a) == len(b) == common:
                continue
            assert len(np.intersect1d(jaccard.segment_keys(a, percent), jaccard.segment_keys(b, percent))), (n, extra, lost)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_keep_one_leaves_clashing_columns_alone(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "a", "b"), (2, text + " more", "c", "d"), (3, "other words that stay here", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, _row string")
    assert sorted(map(tuple, jaccard.keep_one(docs, 5, 80).collect())) == [rows[0], rows[2]]
