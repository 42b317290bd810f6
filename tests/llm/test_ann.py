import numpy as np
import pytest

from tallyspark.llm import ann


def brute(rows, modulus=20, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    for i in ids[ids % modulus == 0]:
        s = x @ good[i]
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(i)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 24))
    x = np.where(rng.random((n, 1)) < 0.5, centers[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, 24)), rng.normal(size=(n, 24)))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def test_recall_ties_and_bad_rows(spark):
    rows = vectors(3000)
    rows += [(40000 + i, rows[3][1]) for i in range(50)] + [(50000, None), (50020, []), (50040, [0.0] * 24), (50060, [float("nan")] * 24), (50080, [1.0, None] * 12), (50100, [float("inf")] + [0.0] * 23), (None, rows[0][1]), (50120, [1.0, 2.0]), rows[20], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as v", "3 as score")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = total = 0
    by_id = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 24 and None not in v}
    for q, best in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        for _, i, s in mine:
            assert i != q and s == pytest.approx(by_id[i] @ by_id[q], rel=1e-9)
        hits += len({i for _, i, _ in mine} & {i for i, _ in best})
        total += 20
    assert hits / total > 0.9


def test_few_vectors_and_none(spark):
    rows = vectors(7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()]
    assert got == [(0, k + 1, i) for k, (i, _) in enumerate(brute(rows)[0])]
    assert ann.search(df.limit(0)).collect() == []
    assert ann.search(df.limit(1)).collect() == []


def test_queries_are_dealt_in_bounded_groups(spark):
    df = spark.createDataFrame(vectors(1000), "query_id long, q array<double>")
    dealt, parts = ann.deal_queries(df, 1000, 100)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert parts == 10 and len(sizes) == 10 and max(sizes) < 150
    rows = spark.createDataFrame(vectors(1000), "vec_id long, embedding array<float>")
    assert sorted(ann.search(rows, group_queries=8).collect()) == sorted(ann.search(rows).collect())


def test_recall_on_the_table_of_embeddings(spark):
    """Isotropic vectors, the hardest case: the share of lists to probe comes from the sample, and is less than all."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.select("vec_id", "embedding").collect()]
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    index = ann.Index(x, len(x), 20)
    assert 0.1 < index.share < 0.95
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i, v in rows:
        if i % 20 == 0:
            s = np.where(ids == i, -np.inf, x @ v)
            hits += len(got[i] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(got) == 100 and hits / 2000 >= 0.9


def test_lists_share_blocks_and_long_ones_are_dealt():
    first, number = ann.lay_out(np.array([3, 4, 5, 25, 1, 0, 10]), 10)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6] and number.tolist() == [1, 1, 1, 3, 1, 1, 1]


def test_equal_vectors_in_several_blocks(spark):
    rows = vectors(400) + [(1000 + i, vectors(1)[0][1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.search(df, block_rows=64).filter("query_id = 0").orderBy("rank").collect()]
    assert got == [i for i, _ in brute(rows)[0]]


@pytest.mark.parametrize("kind", ["lengths", "outliers", "several vectors"])
def test_exact_on_other_rows(spark, kind):
    """Vectors of very different lengths, outliers that the centroids don't know, and ids with many vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    if kind == "lengths":
        x *= np.exp(2 * rng.normal(size=(6000, 1)))
    if kind == "outliers":
        x[:, :] = 0.01 * x + rng.normal(size=24)
        x[rng.choice(6000, 200, False)] = 3 * rng.normal(size=(200, 24))
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if kind == "several vectors":
        rows += [(7001, (x[20 * j] * (2 + j / 100)).astype(np.float32).tolist()) for j in range(300)]
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=2048).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in range(0, 6000, 20):
        score = np.where(ids == i, -np.inf, every @ x[i])
        best = []
        for j in np.lexsort((ids, -score)):
            if ids[j] not in best:
                best.append(int(ids[j]))
            if len(best) == 20:
                break
        assert got[i] == best
