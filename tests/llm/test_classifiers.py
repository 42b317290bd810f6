import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import subword, toxicity
from tallyspark.llm.common import table


def corpus(n=700):
    rng = random.Random(6)
    plain = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words.insert(rng.randint(0, len(words)), rng.choice(["grumbo", "grumbolix", "idiot", "you"]))
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["$$$", "###"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


EDGES = [(9001, None), (9002, ""), (9003, "  \n"), (9004, "word " * 30000), (None, "no id"), (9005, "YOU st*pid 1d1ot ퟿"), (3, "repeated id")]


def split(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.mark.parametrize("module,column,modulus,held,least", [(toxicity, "toxic", 3, 1, 0.9), (subword, "quality", 4, 2, 0.9)])
def test_learns_and_scores_every_row(spark, module, column, modulus, held, least):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs + EDGES, "doc_id long, text string").selectExpr("*", "'x' as label", "1.0D as score", "2 as held_out")
    marks = spark.createDataFrame(labels + [(9001, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(frame, marks)
    got = module.score_documents(frame, model).collect()
    assert len(got) == len(docs) + len(EDGES)
    truth = {i: t if column == "toxic" else g for i, g, t in labels}
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and split(r.doc_id, modulus) == held)
        if r.held_out and r.doc_id in truth and r.doc_id != 3:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > least
    assert module.score_documents(frame.limit(0), model).collect() == []


@pytest.mark.parametrize("module", [toxicity, subword])
def test_labels_of_held_out_rows_are_not_learned(spark, module):
    docs, labels = corpus(80)
    column, modulus, held = ("toxic", 3, 1) if module is toxicity else ("quality", 4, 2)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - g, 1 - t) if split(i, modulus) == held else (i, g, t) for i, g, t in labels]
    a, b = ({r.doc_id: r.score for r in module.score_documents(frame, module.fit(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int"))).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, subword])
def test_nothing_to_learn_from(spark, module):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in module.score_documents(frame, module.fit(frame, none)).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("module", [toxicity, subword])
def test_scores_do_not_depend_on_partitions(spark, module):
    docs, labels = corpus(200)
    scores = []
    for n in (3, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2 * n)
        scores.append({r.doc_id: r.score for r in module.score_documents(frame, module.fit(frame, marks)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert scores[0] == scores[1]


def plain_isotonic(m, y):
    """The least-squares rising fit by its min-max formula over distinct margins, with the same tenth of a row added."""
    at = sorted(set(m))
    groups = [[label for x, label in zip(m, y) if x == v] for v in at]
    out = []
    for i in range(len(at)):
        value, best = -1.0, None
        for lo in range(i + 1):
            low = min((sum(map(sum, groups[lo : hi + 1])) / sum(map(len, groups[lo : hi + 1])), -hi) for hi in range(i, len(at)))
            if low[0] > value:
                value, best = low[0], (lo, -low[1])
        pool = sum(groups[best[0] : best[1] + 1], [])
        out.append((sum(pool) + 0.05) / (len(pool) + 0.1))
    return dict(zip(at, out))


def test_isotonic_against_the_plain_formula():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 12, 60).astype(float)
    y = (rng.random(60) < m / 12).astype(float)
    at, p = toxicity.isotonic(m, y)
    want = plain_isotonic(m.tolist(), y.tolist())
    # a pool has one knot, at its rows' mean margin
    pools = {}
    for v, q in want.items():
        pools.setdefault(round(q, 12), []).extend(x for x in m if x == v)
    assert sorted(pools) == pytest.approx(sorted(p.tolist())) and sorted(np.mean(x) for x in pools.values()) == pytest.approx(sorted(at.tolist()))


def plain_tree(x, g, h, edges, depth, least, ridge):
    """The best split of each node by trying every edge of every feature on the raw values."""

    def value(rows):
        return -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)

    def half(rows):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + ridge)

    def grow(rows, left):
        best = (1e-6, None)
        for j in range(x.shape[1]) if left else ():
            for e in edges[j]:
                a, b = [i for i in rows if x[i, j] < e], [i for i in rows if x[i, j] >= e]
                if a and b and min(sum(h[i] for i in a), sum(h[i] for i in b)) >= least:
                    gain = half(a) + half(b) - half(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
        if best[1] is None:
            return {i: value(rows) for i in rows}
        return grow(best[1][0], left - 1) | grow(best[1][1], left - 1)

    return grow(list(range(len(g))), depth)


def test_trees_against_plain_splits():
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = toxicity.Boosted(trees=3, depth=3).fit(x, y)
    margin = np.full(90, model.base)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, p - y, p * (1 - p), model.edges, 3, model.least, model.ridge)
        got = model.walk(tree, model.binned(x))
        assert got == pytest.approx([want[i] for i in range(90)])
        margin += model.rate * got
    assert model.margin(x) == pytest.approx(margin)


def plain_train(rows, y, seed=11):
    """The same steps, one document and one feature at a time."""
    S = subword
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / S.WIDTH, (S.BUCKETS, S.WIDTH))
    out, bias = rng.normal(0, 0.1, (S.WIDTH, 2)), np.log(np.array([(1 - y).mean(), y.mean()]) + 1e-3)
    seen, seen_out, seen_bias = {}, np.full((S.WIDTH, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(S.EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), S.BATCH):
            part = order[k : k + S.BATCH]
            step, go, gb = {}, np.zeros((S.WIDTH, 2)), np.zeros(2)
            for i in part:
                hidden = sum((w * vectors[b] for b, w in zip(*rows[i])), np.zeros(S.WIDTH))
                e = np.exp(hidden @ out + bias)
                miss = e / e.sum() - np.eye(2)[int(y[i])]
                back = out @ miss
                for b, w in zip(*rows[i]):
                    step[b] = step.get(b, 0) + w * back
                go, gb = go + np.outer(hidden, miss) / len(part), gb + miss / len(part)
            for b, s in step.items():
                seen[b] = seen.get(b, 1e-8) + (s**2).mean()
                vectors[b] -= S.RATE * 0.25 * s / np.sqrt(seen[b])
            seen_out += go**2
            out -= S.RATE * go / np.sqrt(seen_out)
            seen_bias += gb**2
            bias = bias - 0.2 * S.RATE * gb / np.sqrt(seen_bias)
    return vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]


def test_training_against_plain_steps():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(70):
        ids = np.unique(rng.integers(0, 50, 8)).astype(np.uint16)
        w = rng.random(len(ids)).astype(np.float32)
        rows.append((ids, w / w.sum()))
    y = (rng.random(70) < 0.5).astype(float)
    got, want = subword.train(rows, y), plain_train(rows, y)
    assert got[0] == pytest.approx(want[0], abs=1e-5) and got[1] == pytest.approx(want[1], abs=1e-5)


def test_features_against_plain_counts():
    text = "one two one one, three"
    words, plain = text.split(), {}
    pairs = subword.pair_buckets(np.array([subword.xxhash.xxh3_64_intdigest(w.encode()) for w in words], np.uint64))
    for b in [b for w in words for b in subword.grams(w)] + pairs.tolist():
        plain[b] = plain.get(b, 0) + 1
    ids, weights = subword.features(subword.Words(), text)
    assert dict(zip(ids.tolist(), weights.tolist())) == pytest.approx({b: n / sum(plain.values()) for b, n in plain.items()})


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * m))).astype(float)
    at, p = toxicity.isotonic(m, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and p[0] < 0.1 and p[-1] > 0.9


def test_features_of_obfuscated_words():
    row = dict(zip(toxicity.FEATURES, toxicity.Featurizer({"idiot": toxicity.STRONG}).row("you are an 1d1ot, id1ot! idiot")))
    assert row["strong"] > 0 and row["near_person"] > 0 and row["obfuscated_hits"] > 0


def auc(scores, truth):
    """The share of pairs of a row of label 1 and one of label 0 that the scores put in order; ties count half."""
    ones, zeros = ([s for s, t in zip(scores, truth) if t == which] for which in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def test_toxicity_learns_from_few_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    assert labels.filter("toxic IS NOT NULL").count() < 500
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").filter("toxic IS NOT NULL").select("score", "toxic", "predicted").collect()
    assert auc([r.score for r in got], [r.toxic for r in got]) >= 0.9
    assert not [r for r in got if r.predicted > r.toxic]


def test_lexicons_leave_their_fold_out(spark):
    rows = [(f"plain words number{i % 7} " + ("grumbo" if i % 4 == 0 else "") + (f" only{i % 5}" if i % 4 == 0 else ""), int(i % 4 == 0), i % 5) for i in range(200)]
    lexicons = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, fold int"))
    assert all("grumbo" in lexicon and "plain" not in lexicon and "number1" not in lexicon for lexicon in lexicons)
    for fold in range(5):
        assert [f"only{k}" in lexicons[fold] for k in range(5)] == [k != fold for k in range(5)]
    assert all(f"only{k}" in lexicons[-1] for k in range(5))
    few = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, fold int"), 1)
    assert all(len(lexicon) <= len(toxicity.INSULTS) + 1 for lexicon in few)
