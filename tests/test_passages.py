import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyspark.functions import fuzzy, passages

WORDS = ["the", "lazy", "dog", "sleeps", "here", "now", "cat", "fox;", "Jumps,", "over", "-", "été", "a", "of", "contract", "liability", "shall", "not", "exceed", "(amount)"]


def brute(texts, docs, accept):
    out = {}
    for p, text in texts:
        scored = [(-s, d, a, b) for d, t in docs for s, a, b in [fuzzy.best_window(text, (t or "").split())] if s >= accept]
        if any(map(passages.fold, text.split())) and scored:  # without a word character it is like nothing
            s, d, a, b = min(scored)
            out[p] = (d, -s, a, b)
    return out


def edited(rng, words):
    """Every fourth word changed, dropped in part or replaced."""
    return [rng.choice([w[:-1] + "x", w + "s", w[1:] or "q", rng.choice(WORDS)]) if i % 4 == 3 else w for i, w in enumerate(words)]


def sample(seed, n_docs=25):
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choices(WORDS + [f"w{k}" for k in range(60)], k=rng.randint(0, 160)))) for i in range(n_docs)]
    texts = []
    for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 30, 45, 60, 60]):
        words = docs[rng.randrange(n_docs)][1].split()
        at = rng.randrange(max(1, len(words) - n))
        texts.append((i, " ".join(edited(rng, words[at : at + n] or ["none"]))))
    return docs, texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(fuzzy, "BLOCK_CHARS", 600)
    docs, texts = sample(seed)
    docs += [(100, ""), (101, None), (102, " -- ,, "), (103, docs[3][1]), (103, docs[3][1])]
    texts += [(50, ""), (51, "---"), (52, "quick fox"), (53, "the lazy dog sleeps here now")]
    given = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4)
    got = {r.passage_id: (r.doc_id, r.score, r.start, r.stop) for r in fuzzy.locate_passages(spark.createDataFrame(texts + [(60, None)], "passage_id int, passage string"), given).collect()}
    assert got == brute(texts, docs, 70.0)
    assert len(got) >= 10


def test_what_runs_of_four_words_missed(spark):
    docs = spark.createDataFrame([(1, "the quick fox jumps over"), (2, "and the lazy cat sleeps here now"), (3, "alpha beta, gamma delta; epsilon")], "doc_id int, text string")
    texts = spark.createDataFrame([(1, "quick fox"), (2, "the lazy dog sleeps here now"), (3, "alpha, beta gamma; delta epsilon")], "passage_id int, passage string")
    got = {r.passage_id: (r.doc_id, round(r.score), r.start) for r in fuzzy.locate_passages(texts, docs).collect()}
    assert got == {1: (1, 100, 1), 2: (2, 89, 1), 3: (3, 100, 0)}
    assert fuzzy.locate_passages(texts, docs.limit(0)).collect() == [] == fuzzy.locate_passages(texts.limit(0), docs).collect()


def test_common_length_of_many_runs():
    rng = random.Random(4)
    for m in (1, 5, 63, 64, 65, 128, 200):
        text = "".join(rng.choices("abc é", k=m))
        alphabet, (passage,) = passages.prepare(["x"])
        alphabet, (passage,) = passages.prepare([text.replace(" ", "b")])
        chars = np.array([alphabet[c] for c in "".join(rng.choices("abcéz", k=400))], np.int16)
        start = np.array([rng.randrange(300) for _ in range(50)])
        stop = start + np.array([rng.randrange(100) for _ in range(50)])
        letters = "\0" + "".join(sorted(alphabet, key=alphabet.get))
        want = [fuzzy.common_length(passage.text, "".join(letters[c] for c in chars[a:b])) for a, b in zip(start, stop)]
        assert list(passages.common(passage, chars, start, stop)) == want


def test_skipped_runs_lose_nothing():
    rng = random.Random(9)
    docs, texts = sample(11, 60)
    alphabet, ready = passages.prepare([t for _, t in texts])
    held = passages.Texts([t for _, t in docs], alphabet)
    for passage, (_, text) in zip(ready, texts):
        for accept in (30.0, 70.0, rng.uniform(40, 100)):
            scored = [(-s, i, a) for i, (_, t) in enumerate(docs) for s, a, _ in [fuzzy.best_window(text, t.split())] if s >= accept]
            assert passages.most_like(passage, held, accept) == ((-min(scored)[0], *min(scored)[1:]) if scored else None)


def nearest(name, known):
    key = lambda t: " ".join((t or "").translate({ord(c): '"' for c in "’‘'"}).lower().split())
    equal = [k for k in known if k is not None and key(k) == key(name)]
    return max(((fuzzy.name_score(key(name), key(k)), k) for k in equal or known if k is not None), default=(0.0, None))


def misspelt(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randint(0, 2)] = rng.choice(["", "x", " ", "é", "'"])
    return "".join(out)


def names(seed, n):
    rng = random.Random(seed)
    known = sorted({" ".join(rng.choices(["Tech", "Offer", "final", "BOQ", "rev_2", "Doors", "été", "a", "site works"], k=rng.randint(1, 5))) + rng.choice([".pdf", "", ".xlsx"]) for _ in range(n)})
    return known, sorted({misspelt(rng, rng.choice(known)) for _ in range(n)} | {"", "zzz", "’Tech’ OFFER"})


@pytest.mark.parametrize("block", [10_000, 7])
def test_nearest_names_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(fuzzy, "MOST_NAMES", block)
    known, given = names(block, 60)
    listed = spark.createDataFrame([(k,) for k in [*known, known[0], None]], "name string")
    got = {r.name: (r.score, r.best, r.confidence) for r in fuzzy.nearest_names(spark.createDataFrame([(n,) for n in [*given, None]], "name string"), listed).collect()}
    for n in given:
        score, best = nearest(n, known)
        assert got[n] == (score, best if score >= 50 else None, "high" if score >= 70 else "low" if score >= 50 else "none"), n
    assert set(got) == {*given, None} and got[None][1:] == (None, "none")
    assert {r.best for r in fuzzy.nearest_names(listed, listed.limit(0)).collect()} == {None}


def test_nearest_names_of_one_group(spark, monkeypatch):
    known, given = names(3, 40)
    listed = spark.createDataFrame([(k, i % 3) for i, k in enumerate(known)], "name string, package int")
    asked = spark.createDataFrame([(n, p) for n in given for p in (0, 1, 7)], "name string, package int")
    got = {(r.name, r.package): (r.score, r.best) for r in fuzzy.nearest_names(asked, listed, by="package").collect()}
    assert len(got) == 3 * len(given)
    for (n, p), (score, best) in got.items():
        want = nearest(n, [k for i, k in enumerate(known) if i % 3 == p])
        assert score == want[0] and best == (want[1] if score >= 50 else None)
    monkeypatch.setattr(fuzzy, "MOST_NAMES", 5)
    with pytest.raises(Exception, match="more than 5 known names"):
        fuzzy.nearest_names(asked, listed, by="package").collect()


def test_customers_against_parts(spark):
    sf = "/root/testdata/sf0.001"
    known = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct().collect()]
    given = [r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select(F.concat_ws(" ", "c_mktsegment", "c_name")).distinct().limit(40).collect()]
    listed = fuzzy.NameList([k.lower() for k in known], known)
    assert all(listed.best(n.lower()) == nearest(n, known) for n in given)


def test_promoted_keys(spark):
    rows = [({"tehcnical": "a", "budget": "1"},), ({"technical": "b", "tehcnical": "c"},), ({"x": "d"},), (None,), ({"Technicals": "e", "techx": "f"},)]
    got = [(r.p.payload, r.p.error) for r in spark.createDataFrame(rows, "m map<string,string>").select(fuzzy.promote_key(F.col("m"), "technical").alias("p")).collect()]
    assert [g[0] for g in got] == [{"technical": "a", "budget": "1"}, rows[1][0], rows[2][0], None, {"technical": "e", "techx": "f"}]
    assert [g[1] is None for g in got] == [True, True, False, False, True]


def test_a_ratio_that_rounds_up_still_counts():
    """The best ratio so far is what another run must reach, though its product with the lengths may round up."""
    for m in range(2, 24):
        for s in range(2, 24):
            shared = min(m, s) - 1
            passage, word = "a" * shared + "b" * (m - shared), "a" * shared + "c" * (s - shared)
            alphabet, (ready,) = passages.prepare([passage])
            held = passages.Texts([word], alphabet)
            least = fuzzy.ratio(passage, word)
            assert passages.most_like(ready, held, least) == (least, 0, 0), (m, s)


def test_guessed_ratios_are_reached():
    docs, texts = sample(5, 40)
    ready = passages.prepare([t for _, t in texts])[1]
    held = [t for _, t in docs]
    guessed = passages.guessed(passages.places_of([t for _, t in texts]), ready, held, fuzzy.ratio)
    assert guessed
    for k, score in guessed.items():
        assert score <= max(fuzzy.best_window(texts[k][1], t.split())[0] for t in held)


def test_many_names_at_once_against_each_pair():
    rng = random.Random(6)
    for letters in ("ab ", "abcdé ", "xyz  '\""):
        make = lambda: "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 9, 30, 63, 64, 70, 130])))  # noqa: E731, B023
        keys = [make() for _ in range(30)]
        known = [f"{k}|{rng.randint(0, 5)}" for k in keys]
        asked = [make() for _ in range(25)] + keys[:3] + ["q"]
        want = [max((fuzzy.name_score(a, k), n) for k, n in zip(keys, known)) for a in asked]
        listed = fuzzy.NameList(keys, known)
        assert listed.best_of(asked) == want == [listed.best(a) for a in asked]
    assert fuzzy.NameList([], []).best_of(["a", "b"]) == [(0.0, None)] * 2


def first_equal(passage, docs):
    """(doc, word) of the first run of as many words with the same folded text."""
    n, want = len(passage.split()), passages.prepare([passage])[1][0].text
    runs = ((d, i) for d, t in docs for i in range(len((t or "").split()) - n + 1) if " ".join(w for w in passages.folded_words(" ".join(t.split()[i : i + n])) if w) == want)
    return min(runs, default=None) if want else None


ODD = ["ΟΔΟΣ", "ΣΑΣ'", "'Σ", "İl", "a\x1cb", "\0", "-", "--", "x y", "\U0001d400b", "ⅣⅤ", "é", "\ud800", "“q”", "_", "STRASSE", "ǅ", "\x85", "٣"]


def test_folded_texts_word_by_word():
    rng = random.Random(8)
    texts = [None, "", " ", "-", " - -", *("".join(rng.choices([*ODD, *WORDS, " ", "  ", "\n"], k=rng.randint(1, 60))) for _ in range(200))]
    held = passages.Texts(texts)
    at = 0
    for d, text in enumerate(texts):
        words = passages.folded_words(text or "")
        for i, word in enumerate(words):
            assert (held.doc[at + i], held.word[at + i]) == (d, i)
            assert not word or held.text[held.first[at + i] : held.last[at + i]] == word
            for n in range(1, min(6, len(words) - i + 1)):
                start, stop = held.first[at + i], held.last[at + i + n - 1]
                assert held.text[start : max(start, stop)] == " ".join(w for w in words[i : i + n] if w)
        at += len(words)
    assert at == len(held.doc)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_runs_against_each_run(seed):
    rng = random.Random(seed)
    docs = [(i // 2, " ".join(rng.choices(["the", "The,", "-", "dog", "a", "ΣΑΣ", "--"], k=rng.randint(0, 120)))) for i in range(30)]
    texts = []
    for n in (1, 1, 2, 3, 4, 5, 6, 7, 9, 14, 30):
        words = rng.choice(docs)[1].split()
        at = rng.randrange(max(1, len(words) - n))
        texts += [" ".join(words[at : at + n]), " ".join(words[at : at + n]).upper() + "!"]
    texts += ["-", "", "zebra", "the dog zebra"]
    ready = passages.prepare(texts)[1]
    held = passages.Texts([t for _, t in docs], rank=[d for d, _ in docs])
    got = {k: (docs[d][0], i) for k, (d, i) in passages.equal_runs(passages.places_of(texts), ready, held).items()}
    assert got == {k: want for k, text in enumerate(texts) if (want := first_equal(text, docs))}
    assert len(got) >= 12


def test_hashes_that_meet_are_compared(monkeypatch):
    monkeypatch.setattr(passages.Texts, "hashes", lambda self, start, stop: np.full(len(start), 7, np.uint64))
    monkeypatch.setattr(passages, "hash_of", lambda text: 7)
    texts = ["lazy dog", "quick fox jumps", "cat"]
    held = passages.Texts(["the lazy cat", "the lazy dog", "a quick, fox jumps"])
    assert passages.equal_runs(passages.places_of(texts), passages.prepare(texts)[1], held) == {0: (1, 1), 1: (2, 1), 2: (0, 2)}


def test_passages_with_equal_runs_take_one_pass(spark, capsys):
    """No run exceeds an equal one, so only passages without one are held against every run."""
    docs = spark.createDataFrame([(2, "and the Lazy - dog; sleeps"), (1, "x the lazy! dog sleeps"), (1, "lazy dog sleeps")], "doc_id int, text string")
    ask = lambda *texts: fuzzy.locate_passages(spark.createDataFrame([*enumerate(texts)], "passage_id int, passage string"), docs)
    whole, part = ask("lazy dog sleeps", "lazy dog", "--"), ask("lazy dog sleeps", "the lazy dig sleeps")
    plans = []
    for asked in (whole, part):
        asked.explain()
        plans.append(capsys.readouterr().out.count("MapInPandas"))
    assert plans == [0, 1]
    assert sorted(map(tuple, whole.collect())) == [(0, 1, 100.0, 0, 3), (1, 1, 100.0, 0, 2)]
    assert {r.passage_id: (r.doc_id, round(r.score), r.start) for r in part.collect()} == {0: (1, 100, 0), 1: (1, 95, 1)}


@pytest.mark.parametrize("accept, most", [(70.0, 3.2), (94.0, 2.6)])
def test_stretches_take_few_characters(accept, most, monkeypatch):
    """Characters taken into an LCS for each one of the texts."""
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 9))) for _ in range(3000)]
    ready = passages.prepare([" ".join(rng.choices(words, k=36))])
    held = passages.Texts([" ".join(rng.choices(words, k=rng.randint(20, 4000))) for _ in range(40)], ready[0])
    taken = []
    monkeypatch.setattr(passages, "step", lambda bits, seen, *rest, step=passages.step: (taken.append(len(seen)), step(bits, seen, *rest)))
    assert passages.most_like(ready[1][0], held, accept) is None
    assert sum(taken) < most * len(held.chars)


def test_copies_are_held_against_once(spark, capsys):
    """Of equal documents the smallest id counts, and the second pass gets one."""
    docs = spark.createDataFrame([(i, "and the lazy cat sleeps here now" if i % 3 else None) for i in range(7, 60)], "doc_id int, text string").repartition(5)
    asked = fuzzy.locate_passages(spark.createDataFrame([(1, "the lazy dog sleeps here now")], "passage_id int, passage string"), docs)
    asked.explain()
    plan = capsys.readouterr().out
    assert plan.count("keys=[text") >= 1
    assert [(r.doc_id, round(r.score), r.start, r.stop) for r in asked.collect()] == [(7, 89, 1, 7)]
