import random
import re
from collections import Counter
from itertools import permutations

from tallyspark.llm import audit


def fails(rows):
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        out |= {"E"} if doc_id is not None and smallest[text] < doc_id else set()
        yield doc_id, lang or "", out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    docs = list(fails(rows))
    out, total = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                reach = [(i, f) for i, f in own if not f & before]
                gone = [i for i, f in reach if x in f]
                total[part, x] += len(gone)
                out[part, "".join(order), k + 1] = [len(reach) - len(gone), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own), sum(i in good for i in gone), sum(i in toxic for i in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def sample():
    rng = random.Random(5)
    words = ["A", "b", "Cc", "déjà", "x\x85y", "#", "w%", "zz"] + [f"w{i}" for i in range(300)]
    texts = ["", None, "A", " \t\n", "B#"] + [" ".join(rng.choices(words[rng.choice([0, 8]) :], k=rng.randint(150, 420))) for _ in range(25)] + ["a b " * 200, "the SAME " * 100]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    return [*rows, rows[0], rows[0]]


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in df.collect()}


def test_against_brute_force(spark):
    rows = sample()
    labels = [(i, i % 2, i % 3 == 0) for i in range(40)] + [(3, None, None), (4, 1, 1), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, n int").repartition(7)
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert result(got) == brute(rows, labels)
    assert got.count() == 600 * 3


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert result(audit.filter_audit(one, labels)) == brute([(1, None, None)], [])


def test_copies_and_long_texts_are_cut_nowhere(spark):
    rows = [(i, "one text " * 120, "en") for i in range(300)] + [(1000, "w " * 600_000 + "#", "en"), (1001, " ".join(f"w{i}" for i in range(300_000)), "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert result(audit.filter_audit(docs, labels)) == brute(rows, [(0, 1, 0), (7, 0, 1)])


def test_edges():
    assert len(audit.edges()) == 80 and len(audit.steps()) == 600
    assert sum(w for _, _, w in audit.edges()) == 600
