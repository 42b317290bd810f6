import random

import corpus_pipeline

from tallyspark.llm import packing


def corpus(n=240, seed=3):
    """Documents of which a third are toxic, a third debris, and some good ones are copied."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=60)
        if i % 3 == 0:
            body[::6] = rng.choices(["you", "idiot", "stupid", "scum"], k=10)
        elif i % 3 == 1:
            body = [w + rng.choice(["###", "%%%", "$$$"]) for w in body]
        docs.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, int(i % 3 != 1), int(i % 3 == 0)))
    copies = [(1000 + d[0], d[1] + " extra", *d[2:]) for d in docs if d[0] % 12 == 2]
    return docs + copies + [(5000, None, None, None, None), (5001, "", "en", "s", 0)], labels


def test_pipeline(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns = rows.columns
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert rows.columns == columns
        kept.append({r.doc_id for r in rows.select("doc_id").collect()})
    good = {d[0] for d in docs if d[0] % 3 == 2 and d[0] < 1000}
    toxic = {d[0] for d in docs if d[0] % 3 == 0 and d[0] < 1000}
    assert len(kept[0] & toxic) <= 0.05 * len(toxic) and len(good - kept[0]) <= 0.02 * len(good)
    debris = {d[0] for d in docs if d[0] % 3 == 1 and d[0] < 1000}
    assert len(kept[1] & debris) <= 0.05 * len(debris) and len(good - kept[1]) <= 0.05 * len(good)
    texts = {d[0]: d[1] for d in docs}
    copied = {d for d in kept[1] if 1000 <= d < 5000 and d - 1000 in kept[1]}
    assert kept[2] == kept[1] - copied  # 60 words and one more: 56 of 57 shingles in common
    assert kept[3] == kept[2]
    pieces = rows.collect()
    used = {}
    for p in pieces:
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for runs in used.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(p.length for p in pieces) >= sum(len((texts[d] or "").split()) + 1 for d in kept[3])


def test_empty_tables_null_ids_and_clashing_columns(spark, tmp_path):
    docs, labels = corpus(90, 5)
    schema = "doc_id long, text string, row string, score string, _range string, label string"
    rows = [(d[0], d[1], "r", "s", "x", "l") for d in docs] + [(None, "a null id that stays in the corpus", "r", "s", "x", "l")]
    for name, given, marks in (("full", rows, labels), ("empty", [], []), ("unlabelled", rows[:6], [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert any(p.doc_id is None for p in pieces) and any(p.doc_id == 2 for p in pieces)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    table = spark.read.parquet(f"{tmp_path}/unlabelled/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, table, f"{tmp_path}/unlabelled").columns == table.columns
