import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tallyspark.llm import packing

PATH = P.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def unroll(histogram, capacity):
    runs, opened = packing.sweep(histogram, {}, capacity)
    by = defaultdict(list)
    for length, rank, gap, first, offset in runs.tolist():
        assert gap == 0
        by[length].append((rank, first, offset))
    out = []
    for length, count in histogram.items():
        rows = sorted(by[length])
        for (rank, seq, offset), end in zip(rows, [r[0] for r in rows[1:]] + [count]):
            out += [(length, seq + k, offset) for k in range(end - rank)]
    assert {seq for _, seq, _ in out} == set(range(opened))
    return out


def gapless(rows, capacity):
    seqs = defaultdict(list)
    for length, seq, offset in rows:
        seqs[seq].append((offset, length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 50, 2048):
        for _ in range(20):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
            lengths += [rng.choice(lengths)] * rng.randint(0, 100)
            placed = unroll(Counter(lengths), capacity)
            assert Counter(x[0] for x in placed) == Counter(lengths)
            assert gapless(placed, capacity) == best_fit_decreasing(lengths, capacity)
    assert len(packing.sweep({}, {}, 9)[0]) == 0


def test_sweep_takes_the_successor_gap_by_rank():
    runs, opened = packing.sweep({5: 3}, {4: 9, 5: 1, 7: 1}, 10)
    assert runs.tolist() == [[5, 0, 5, 0, 5], [5, 1, 7, 0, 3], [5, 2, 0, 0, 0]] and opened == 1


def test_supersteps_pack_like_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BUCKET", 7)  # hot sizes are dealt over many buckets
    rng = random.Random(5)
    for capacity, lengths in ((50, [rng.randint(1, 50) for _ in range(400)] + [13] * 200), (8, [8, 8, 8]), (100, [1])):
        rows = spark.createDataFrame([(None, 0, 0, n, 7) for n in lengths], "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.best_fit(rows.repartition(3, "length"), capacity).collect()
        assert sorted(r.length for r in got) == sorted(lengths)
        assert gapless([(r.length, r.sequence_id, r.offset) for r in got], capacity) == best_fit_decreasing(lengths, capacity)


def test_ids_are_the_tokenizers(spark):
    real = Tokenizer.from_file(PATH)
    own = packing.WordIds(PATH)
    for text in ["", "Hello  world,\n\tIt's 3 o'clock", "ÀÉ é Σας x y \x1c z", "<|endoftext|> a", "b<|endoftext|>", "<|startoftext|>!", "<|ENDOFTEXT|>, x", "İ,", "ǰ! ΐ.", "ñ" * 3000, "a ́b", "x\r\ny\x0b\x0cz", "Word!!! WORD word's éA... É,e\u0301 don't-it's ΣΑΣ. İx!", "a" * 300 + " $$$ $a$ 12%"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids, text


def test_ids_of_random_texts():
    real, own, rng = Tokenizer.from_file(PATH), packing.WordIds(PATH), random.Random(9)
    letters = "aAbBéÉİıßǰΐΣσςЖñ中\u0301\u0345'’,.!$<|>1٣ \t"
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "<|endoftext|>", " <|endoftext|> ", "'s", "'S"])
        assert np.frombuffer(own.ids(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids, text


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta!"], k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, "word " * 5000), (3, rows[3][1]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece", "'x' as bucket")
    got = packing.pack_documents(docs, PATH).collect()
    real = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = real.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[i, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    n = gapless([(r.length, r.sequence_id, r.offset) for r in got], 2048)
    assert n == best_fit_decreasing([r.length for r in got], 2048)
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
