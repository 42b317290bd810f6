import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for i, text in rows if i is not None and not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return n, {i: (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in tokens(t))) for i, t in rows}


def corpus():
    rng = random.Random(4)
    nouns = [f"n{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            n = rng.choice(nouns)
            words += [n, f"verb_{n}", rng.choice("abc")]
        rows.append((i, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, "Never SEEN words " + "x" * 3000), (303, "n1 verb_n1 " * 8000), (None, "n1 verb_n1")]


@pytest.mark.parametrize("head", [1_000_000, 20, 0])
def test_exact_counts_and_better_model(spark, head):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as held_out", "1 as key", "2 as rows").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(docs, head_words=head).collect()}
    n, want = brute(rows)
    assert len(got) == len(rows)
    for i, (held_out, n_tokens, n_known, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)
    unseen = [r for i, r in got.items() if i is not None and i < 300 and r.held_out]
    assert sum(r.score for r in unseen) > 0.8 * sum(r.base_score for r in unseen)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score_documents(docs.limit(0)).collect() == []
    only = next(i for i in range(99) if held(i))
    r = lm.score_documents(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_filter_keeps_what_fits_in_any_order():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    n = 40_000
    keys = rng.integers(0, 1 << 63, n).astype(np.int64)
    level = np.minimum(rng.geometric(0.6, n), 30)

    def build(order, step):
        parts = [order[i : i + step] for i in range(0, n, step)]
        batches = (pa.record_batch({"block": np.full(len(p), 5, np.int32), "key": keys[p], "level": level[p].astype(np.int32), "pair": np.ones(len(p), bool)}) for p in parts)
        return next(lm.build_blocks(batches)).column("bits")[0].as_py()

    assert build(np.arange(n), 1000) == build(rng.permutation(n), 7777)


def test_levels_read_back():
    keys = lm.word_keys(np.arange(1, 2000, dtype=np.uint64))
    count = np.random.default_rng(1).integers(1, 100_000, len(keys))
    import pyarrow as pa

    level = lm.level_of(count)
    bits = np.zeros((lm.BLOCKS, lm.BLOCK_BITS // 8), np.uint8)
    batch = pa.record_batch({"block": lm.block_of(keys), "key": keys.view(np.int64), "level": level.astype(np.int32), "pair": np.zeros(len(keys), bool)})
    for out in lm.build_blocks(iter([batch])):
        bits[out.column("block")[0].as_py()] = np.frombuffer(out.column("bits")[0].as_py(), np.uint8)
    model = lm.Model(bits, 10, 10, np.zeros(lm.LEVELS + 1))
    assert (model.levels(keys) == level).mean() > 0.999
    assert (model.levels(lm.word_keys(np.arange(5000, 9000, dtype=np.uint64))) == 0).mean() > 0.999


def test_filter_grows_with_the_corpus():
    for n in (10**6, 6 * 10**7, 4 * 10**9):
        assert lm.blocks_for(n) * lm.BLOCK_BITS >= n * lm.BITS_PER_ENTRY
    keys = np.sort(lm.word_keys(np.arange(1, 100_000, dtype=np.uint64)))
    block = lm.block_of(keys, lm.blocks_for(4 * 10**9))
    assert (np.diff(block) >= 0).all() and block.max() > 50 * lm.BLOCKS


def test_overfull_block_keeps_all_pairs():
    import pyarrow as pa

    keys = lm.word_keys(np.arange(1, 20_001, dtype=np.uint64))
    batch = pa.record_batch({"block": np.zeros(len(keys), np.int32), "key": keys.view(np.int64), "level": np.ones(len(keys), np.int32), "pair": np.ones(len(keys), bool)})
    bits = np.frombuffer(next(lm.build_blocks(iter([batch]))).column("bits")[0].as_py(), np.uint8)[None]
    assert (lm.Model(bits, 1, 1, None).levels(keys) >= 1).all()


def test_same_scores_in_any_chunks(spark):
    docs = spark.createDataFrame(corpus()[:303], "doc_id long, text string").repartition(2)
    whole = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    dealt = {r.doc_id: r.score for r in lm.score_documents(docs, chunk=500).collect()}
    assert dealt == pytest.approx(whole, rel=1e-9)


def test_probabilities_after_a_context_add_up_to_one_at_most():
    """Over the whole vocabulary, the unknown word included, for the true levels of a small corpus' counts."""
    words = [t for _, text in corpus()[:200] for t in (text or "").split()] + ["x"] * 900
    rng = np.random.default_rng(1)
    after = list(zip(words, rng.permutation(words)))
    count, pairs = Counter(words), Counter(after)
    level = lambda n: int(lm.level_of(np.array([n]))[0]) if n else 0
    model = lm.Model(None, len(words), len(count), np.linspace(0.1, 0.98, lm.LEVELS + 1))
    for context in [w for w, _ in count.most_common(40)]:
        c = level(count[context])
        classes = [(c * (lm.LEVELS + 1) + level(pairs[context, w])) * (lm.LEVELS + 1) + level(count[w]) for w in count]
        total = (10 ** model.logs(np.array([*classes, c * (lm.LEVELS + 1) ** 2]))).sum()
        assert 0.3 < total <= 1 + 1e-9


def test_score_against_brute_force(spark):
    """The filter's levels of these few n-grams are the true ones, so the score is that of exact counts, quantised."""
    docs = [(i, t) for i, t in corpus()[:120]]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.doc_id is not None}
    learn = [(t or "").lower().split() for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count, pairs, starts = Counter(), Counter(), len(learn)
    for words in learn:
        tokens = [*words, None]
        count.update(tokens)
        pairs.update(zip(["<", *words], tokens))
    level = lambda n: int(lm.level_of(np.array([n]))[0]) if n else 0
    low, high = lm.level_counts()
    model = lm.Model(None, sum(count.values()), len(count), np.zeros(lm.LEVELS + 1))
    place = lambda a, b: (level(count[a] if a != "<" else starts), level(pairs[a, b]), level(count[b]))
    code = lambda c: (c[0] * (lm.LEVELS + 1) + c[1]) * (lm.LEVELS + 1) + c[2]
    seen = Counter(code(place(a, b)) for words in learn for a, b in zip(["<", *words], [*words, None]))
    weights = lm.fit_weights(model, np.array(list(seen)), np.array(list(seen.values())))
    near = []
    for i, t in docs:
        if i is None:
            continue
        words, total = (t or "").lower().split(), 0.0
        for a, b in zip(["<", *words], [*words, None]):
            c, p, w = place(a, b)
            p = min(p, c, w)
            total += math.log10(weights[c] * (low[p] / high[c] if c else 0) + (1 - weights[c]) * (low[w] + 1) / (model.tokens + model.vocabulary + 1))
        near.append(abs(got[i] - total) <= 0.02 * abs(total) + 1e-6)
    assert sum(near) >= 0.95 * len(near)
