import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = bpe.TreeBpe(RANKS, P.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=300))
def test_any_text_encodes_as_the_library_does(text):
    assert ids(text) == REAL.encode_ordinary(text)
    assert OWN.decode(ids(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinotrs hl", max_size=400), st.text(alphabet="=-*ab \n\t", max_size=400))
def test_long_matches_of_few_letters(a, b):
    for text in (a, b, a.replace(" ", ""), b.replace(" ", "")):
        assert ids(text) == REAL.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "=" * 4001, " " * 3000 + "x", "é" * 999, "the" * 1000, "x\n \ny", "a  b", "Word!!! it's, 'tis don't... x%%% y$$$ 12% é-é", "\u0345a! ͅ", "퟿\U0001f600" * 300])
def test_edges(text):
    assert ids(text) == REAL.encode_ordinary(text)


def test_random_strings_of_vocabulary_pieces():
    rng = random.Random(5)
    pieces = [t.decode() for t in RANKS if t.isalpha() and t.isascii()]
    for _ in range(300):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 60)))
        assert ids(text) == REAL.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "A plain text."), (2, None), (3, ""), (4, "word " * 30000), (1, "A plain text."), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = sorted(map(tuple, bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        x = REAL.encode_ordinary(t or "")
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_tree_joins_at_its_boundaries_over_a_whole_table(spark):
    """Every match of more than a leaf that is no token of its own goes through joins, and some windows are re-encoded."""
    counted = {"join": 0, "window": 0}

    class Counting(bpe.TreeBpe):
        def join(self, left, right):
            counted["join"] += 1
            counted["window"] += not self.pair_is_stable(left[-1], right[0])
            return super().join(left, right)

    own = Counting(RANKS, P.PATTERN)
    for (text,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == REAL.encode_ordinary(text or "")
    long = [m for m in own.matches if len(m.encode()) > bpe.LEAF_BYTES and m.encode() not in RANKS]
    assert len(long) > 1000 and counted["join"] >= len(long) and counted["window"] > 100
