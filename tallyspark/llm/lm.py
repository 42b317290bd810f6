"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs over all training texts are quantised on a logarithmic scale and kept in a Bloom
filter: an n-gram of level q is inserted with each of the levels 1..q, and is read back by probing levels until one is
missing. The filter grows with the corpus: its blocks are sized from the counted n-grams and levels, none is left out,
and it is never gathered in one place. It is split by ranges of keys into shards of `SHARD_BLOCKS` blocks, which are
rows of a table. Documents are gathered into chunks; a chunk sends each shard its distinct keys and gets back their
levels, so a frequent n-gram costs one key a chunk, and a task holds one shard at a time while probing.

The probability of a word after another interpolates the pair's relative frequency with the word's own add-one
probability, all read from the filter. A level stands for its least count above a fraction's line and for its greatest
below it, and a pair isn't more frequent than its words; so, but for the filter's few false answers, the probabilities of
all words after a context add up to 1 at most. The weights, one per frequency level of the context, come from leave-one-out
expectation maximisation on all training rows, of which only the number of tokens in each class of three levels
(context, pair, word) goes to the driver.

The base score uses exact counts. Words that are frequent in training (at most `HEAD_WORDS` of them) are broadcast;
all others are joined with the counts by word, so no vocabulary size is assumed.

Rows: a null text counts as empty, and an empty text has one token, its end. A null id is never learned from and is
not held out. Repeated rows are counted and scored each. With nothing to learn from, every score is 0. Only `doc_id`
and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashCache, arrow_schema, discard, distinct, id_remainder, materialize, mix64, small_batches, words_of

END = np.uint64(0x5EED0E4D)  # the end token's hash; words have hashes of their own
START = np.uint64(0x57A27)

#: Fewest blocks of a filter; it has as many as its entries need.
BLOCKS = 4096
BLOCK_BITS = 1 << 17
#: Blocks of one shard: 2 MiB.
SHARD_BLOCKS = 128
PROBES = 4
BITS_PER_ENTRY = 10
#: Ratio of neighbouring count levels.
LEVEL_BASE = 1.5
LEVELS = 64
#: Tokens of the documents that make a chunk, and entries that a task gathers before it sends them to the shards.
CHUNK = 500_000
HEAD_WORDS = 1_000_000
#: Rows in one Arrow batch of numbers.
NUMBER_ROWS = 65_536
#: Bytes in one Arrow batch where rows are large.
BATCH_BYTES = 8 << 20
#: Classes of three levels: context, pair, word.
CLASSES = (LEVELS + 1) ** 3


def level_of(count: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(count, 1)) / np.log(LEVEL_BASE) + 1e-9)).astype(np.int64).clip(1, LEVELS)


def level_counts() -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest count of each level; 0 for level 0."""
    low = np.ceil(LEVEL_BASE ** np.arange(LEVELS) - 1e-9)
    high = np.maximum(np.ceil(LEVEL_BASE ** np.arange(1, LEVELS + 1) - 1e-9) - 1, low)
    return np.concatenate([[0.0], low]), np.concatenate([[0.0], high])


def token_hashes(text: str | None, cache: HashCache) -> np.ndarray:
    words = words_of(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    out[-1] = END
    return out


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def block_of(keys: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Ranges of keys, so that sorted keys have sorted blocks."""
    return ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def blocks_for(entries: int) -> int:
    """Blocks that hold so many (n-gram, level) entries, a tenth of room included, in whole shards; not fewer than BLOCKS."""
    need = -(-entries * BITS_PER_ENTRY * 11 // (BLOCK_BITS * 10))
    return -(-max(need, BLOCKS) // SHARD_BLOCKS) * SHARD_BLOCKS


@contextmanager
def batch_rows(spark: SparkSession, rows: int, size: int = -1):
    """Rows, and where given bytes, in one Arrow batch, for the tables written inside."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        if value > 0:
            spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, place by place: the high places are zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


CHUNKS = "chunk long, docs array<struct<doc_id:long,held_out:boolean,learn:boolean,n:long>>, words binary, at binary"


def gather_chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, learn, text) -> chunks: the documents, their distinct words' sorted hashes, and each token's place in those."""
    from pyspark import TaskContext

    cache, docs, held, size = HashCache(), [], [], 0
    chunk = TaskContext.get().partitionId() << 40

    def packed():
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        columns = ([chunk], [docs], [binary(words)], [binary(at.astype(np.int32))])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            tokens = token_hashes(row.pop("text"), cache)
            docs.append(row | {"n": len(tokens)})
            held.append(tokens)
            size += len(tokens)
            if size >= most:
                yield packed()
                docs, held, size, chunk = [], [], 0, chunk + 1
    if docs:
        yield packed()


def chunks_in(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[dict], np.ndarray, np.ndarray]]:
    """Each chunk's row, documents, tokens and the places where its documents start."""
    for row in batch.to_pylist():
        tokens = np.frombuffer(row["words"], np.uint64)[np.frombuffer(row["at"], np.int32)]
        yield row, row["docs"], tokens, np.cumsum([0, *(d["n"] for d in row["docs"][:-1])])


def chunk_pairs(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], tokens[:-1]])
    before[starts] = START
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) ^ mix64(tokens))


COUNTED = pa.schema([("key", pa.int64()), ("rows", pa.int64())])


def count_in_task(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk's distinct keys in training rows."""
    for batch in batches:
        for _, docs, tokens, starts in chunks_in(batch):
            learn = np.repeat([d["learn"] for d in docs], [d["n"] for d in docs])
            keys, rows = np.unique((chunk_pairs(tokens, starts) if pairs else tokens)[learn], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rows.astype(np.int64))], schema=COUNTED)


def counts(chunks: DataFrame, pairs: bool) -> DataFrame:
    """key (a word's hash, or a pair's key), rows (its count)."""
    return chunks.mapInArrow(partial(count_in_task, pairs=pairs), "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows"))


def steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each key's probes begin within its block and how far apart they are, modulo 2^32: double hashing."""
    mixed = mix64(keys + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return mixed.astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def set_bits(bits: np.ndarray, blocks: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> None:
    """Insert keys with each level up to their own; `blocks` are rows of `bits`."""
    flat, base = bits.reshape(-1), blocks * (BLOCK_BITS // 8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        part = np.flatnonzero(levels >= level)
        keys, levels, base = keys[part], levels[part], base[part]
        at, step = steps(keys, level)
        for _ in range(PROBES):
            bit = at & np.uint32(BLOCK_BITS - 1)
            np.bitwise_or.at(flat, base + (bit >> np.uint32(3)), np.uint8(1) << (bit & np.uint32(7)).astype(np.uint8))
            at += step


def read_levels(bits: np.ndarray, blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key: probes go on until a level is missing."""
    flat, base = bits.reshape(-1), blocks * (BLOCK_BITS // 8)
    found, alive = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level in range(1, LEVELS + 1):
        if not len(alive):
            break
        at, step = steps(keys, level)
        held, left = base, None  # the places of those whose probes have all hit; None: all
        for probe in range(PROBES):
            bit = at & np.uint32(BLOCK_BITS - 1)
            hit = np.flatnonzero(flat[held + (bit >> np.uint32(3))] >> (bit & np.uint32(7)).astype(np.uint8) & np.uint8(1))
            if len(hit) < len(at):
                at, step, held, left = at[hit], step[hit], held[hit], hit if left is None else left[hit]
            at = at + step
        if left is not None:
            alive, keys, base = alive[left], keys[left], base[left]
        found[alive] = level
    return found


BLOCK = pa.schema([("block", pa.int32()), ("bits", pa.binary())])


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, key, level) of whole blocks -> the blocks' bits. All entries are kept."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        block, inverse = np.unique(batch.column("block").to_numpy(), return_inverse=True)
        bits = np.stack([held.get(int(b), np.zeros(BLOCK_BITS // 8, np.uint8)) for b in block]) if len(block) else np.zeros((0, BLOCK_BITS // 8), np.uint8)
        set_bits(bits, inverse, batch.column("key").to_numpy().view(np.uint64), batch.column("level").to_numpy().astype(np.int64))
        held.update(zip(map(int, block), bits))
    for block, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], schema=BLOCK)


ENTRIES = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("levels", pa.binary())])


def by_shard(keys: np.ndarray, blocks: int) -> Iterator[tuple[int, int, int]]:
    """Shard, and the range of its keys in sorted `keys`."""
    shard = block_of(keys, blocks) // SHARD_BLOCKS
    edges = np.flatnonzero(np.diff(shard, prepend=-1))
    return zip(shard[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(keys)])


def send_entries(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, level, pair) -> one row for each shard and CHUNK entries."""
    held, size = [], 0

    def packed():
        keys, levels = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, levels = keys[order], levels[order]
        rows = [(s, pack_keys(keys[a:b]), binary(levels[a:b])) for s, a, b in by_shard(keys, blocks)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTRIES)], schema=ENTRIES)

    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key").to_numpy().view(np.uint64)
            word = ~batch.column("pair").to_numpy(zero_copy_only=False)
            held.append((np.where(word, word_keys(keys), keys), batch.column("level").to_numpy().astype(np.uint8)))
            size += batch.num_rows
            if size >= CHUNK:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


SHARDS = pa.schema([("shard", pa.int32()), ("bits", pa.binary())])


def build_shards(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, keys, levels) of whole shards in order -> the shards' bits."""
    at, bits = None, None

    def built():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([binary(bits)], pa.binary())], schema=SHARDS)

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != at:
                if at is not None:
                    yield built()
                at, bits = row["shard"], np.zeros((SHARD_BLOCKS, BLOCK_BITS // 8), np.uint8)
            keys = unpack_keys(row["keys"])
            set_bits(bits, block_of(keys, blocks) - at * SHARD_BLOCKS, keys, np.frombuffer(row["levels"], np.uint8))
    if at is not None:
        yield built()


ASKED = pa.schema([("slot", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("levels", pa.binary())])


def chunk_keys(row: dict, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted distinct keys that a chunk needs the levels of."""
    words = np.append(np.frombuffer(row["words"], np.uint64), END)
    return distinct(np.concatenate([word_keys(words), chunk_pairs(tokens, starts)]))


def ask(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Chunks -> their keys by shard, in odd slots; the shards' bits come before them in even ones."""
    for batch in batches:
        for row, _, tokens, starts in chunks_in(batch):
            keys = chunk_keys(row, tokens, starts)
            rows = [(2 * s + 1, row["chunk"], pack_keys(keys[a:b])) for s, a, b in by_shard(keys, blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ASKED)], schema=ASKED)


def answer(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Slots in order -> the levels of the asked keys; a shard without bits knows none."""
    at, bits = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            shard = row["slot"] >> 1
            if row["slot"] & 1 == 0:
                at, bits = shard, np.frombuffer(row["data"], np.uint8).reshape(SHARD_BLOCKS, -1)
                continue
            keys = unpack_keys(row["data"])
            levels = read_levels(bits, block_of(keys, blocks) - at * SHARD_BLOCKS, keys) if shard == at else np.zeros(len(keys))
            rows.append((row["chunk"], shard, binary(levels.astype(np.uint8))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)


def levels_of_chunks(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """chunk, found (array of shard and levels, sorted): the levels of each chunk's keys, from a filter of all counts."""
    spark = chunks.sparkSession
    level = F.least(F.lit(LEVELS), F.lit(1) + F.floor(F.log(F.col("rows").cast("double")) / F.lit(float(np.log(LEVEL_BASE))) + F.lit(1e-9))).cast("int")
    with batch_rows(spark, 1):
        pairs = materialize(counts(chunks, True).select("key", level.alias("level"), F.lit(True).alias("pair")), "pairs")
    entries = pairs.unionByName(words.select("key", level.alias("level"), F.lit(False).alias("pair")))
    blocks = blocks_for(entries.agg(F.sum("level")).first()[0] or 0)
    shards = blocks // SHARD_BLOCKS
    with batch_rows(spark, NUMBER_ROWS, BATCH_BYTES):
        sent = entries.mapInArrow(partial(send_entries, blocks=blocks), "shard int, keys binary, levels binary")
        built = materialize(sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(partial(build_shards, blocks=blocks), "shard int, bits binary"), "filter")
    discard(pairs)
    with batch_rows(spark, 1):
        asked = chunks.mapInArrow(partial(ask, blocks=blocks), "slot long, chunk long, data binary")
        stored = built.select((F.col("shard").cast("long") * 2).alias("slot"), F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("data"))
        dealt = stored.unionByName(asked).repartition(shards, F.shiftright("slot", 1)).sortWithinPartitions("slot")
        found = materialize(dealt.mapInArrow(partial(answer, blocks=blocks), "chunk long, shard int, levels binary"), "found")
    discard(built)
    return found.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "levels"))).alias("found"))


class Model:
    """Turns levels into probabilities; with a filter's bits, reads levels back from it."""

    def __init__(self, bits: np.ndarray | None, tokens: int, vocabulary: int, weights: np.ndarray):
        self.bits, self.tokens, self.vocabulary, self.weights = bits, tokens, vocabulary, weights
        self.low, self.high = level_counts()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        return read_levels(self.bits, block_of(distinct, len(self.bits)), distinct)[back]

    def parts(self, classes: np.ndarray, without: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The context's level, the pair's and the word's probability in each class. `without` is taken off the counts,
        so that a training row isn't judged by its own occurrence."""
        context, pair, word = classes // (LEVELS + 1) ** 2, classes // (LEVELS + 1) % (LEVELS + 1), classes % (LEVELS + 1)
        pair = np.minimum(pair, np.minimum(context, word))
        whole = np.maximum(self.high[context] - without, 1e-9)
        p_pair = np.where(context > 0, np.minimum(np.maximum(self.low[pair] - without, 0) / whole, 1.0), 0.0)
        p_word = (np.maximum(self.low[word] - without, 0) + 1) / (self.tokens + self.vocabulary + 1)
        return context, p_pair, p_word

    def logs(self, classes: np.ndarray) -> np.ndarray:
        """log10 probability of a token of each class."""
        context, p_pair, p_word = self.parts(classes)
        weight = self.weights[context]
        return np.log10(weight * p_pair + (1 - weight) * p_word)


def classes_of(row: dict, tokens: np.ndarray, starts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The class of each token, from the levels of the chunk's keys."""
    words = np.append(np.frombuffer(row["words"], np.uint64), END)
    back = np.unique(np.concatenate([word_keys(words), chunk_pairs(tokens, starts)]), return_inverse=True)[1]
    of_words = levels[back[: len(words)]].astype(np.int64)
    word, pair = of_words[np.frombuffer(row["at"], np.int32)], levels[back[len(words) :]].astype(np.int64)
    context = np.concatenate([[0], word[:-1]])
    context[starts] = of_words[-1]  # texts start as often as they end
    return (context * (LEVELS + 1) + pair) * (LEVELS + 1) + word


def fit_weights(model: Model, classes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One weight per context level, by leave-one-out expectation maximisation over the tokens of each class."""
    weights = np.full(LEVELS + 1, 0.3)
    weights[0] = 0.0
    if len(classes):
        context, p_pair, p_word = model.parts(classes, without=1.0)
        n = np.bincount(context, times, minlength=LEVELS + 1)
        for _ in range(30):
            weight = weights[context]
            share = weight * p_pair / np.maximum(weight * p_pair + (1 - weight) * p_word, 1e-300)
            weights = np.clip((np.bincount(context, share * times, minlength=LEVELS + 1) + 0.3) / (n + 1.0), 1e-4, 0.98)
            weights[0] = 0.0
    return weights


def count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for classes in batch.column("classes").to_pylist():
            np.add.at(total, np.frombuffer(classes, np.int32), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=COUNTED)


LEVELLED = "uid long, doc_id long, held_out boolean, learn boolean, n_tokens long, head_known long, head_logs double, classes binary, rare array<struct<word:long,times:int>>"
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_logs double, score double"


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, head_words: int = HEAD_WORDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.coalesce(id_remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"))
    docs = docs.select(F.col("doc_id").cast("long"), "held_out", (~F.col("held_out") & F.col("doc_id").isNotNull()).alias("learn"), "text")
    chunks = materialize(docs.mapInArrow(partial(gather_chunks, schema=arrow_schema(CHUNKS), most=chunk), CHUNKS), "chunks")
    with batch_rows(spark, 1):
        words = materialize(counts(chunks, False), "word-counts")
    # one row of totals, and of counts by binary order of magnitude (at most 64)
    orders = {int(r["order"]): (r["n"], r["total"]) for r in words.groupBy(F.floor(F.log2("rows")).alias("order")).agg(F.count("*").alias("n"), F.sum("rows").alias("total")).collect()}
    vocabulary, tokens = sum(n for n, _ in orders.values()), sum(t for _, t in orders.values())
    least, kept = 1 << 62, 0
    for order in sorted(orders, reverse=True):
        if kept + orders[order][0] > head_words:
            break
        least, kept = 1 << order, kept + orders[order][0]
    found = levels_of_chunks(chunks, words)
    head = words.filter(F.col("rows") >= least).toArrow()  # at most head_words rows
    head_keys, head_rows = head.column("key").to_numpy().view(np.uint64), head.column("rows").to_numpy()
    order = np.argsort(head_keys)
    shared = spark.sparkContext.broadcast((head_keys[order], np.log10(head_rows[order] + 1.0)))
    with batch_rows(spark, 1):
        levelled = materialize(chunks.join(found, "chunk").mapInArrow(partial(level_in_task, shared=shared, schema=arrow_schema(LEVELLED)), LEVELLED), "levelled")
    discard(chunks)
    seen = levelled.filter("learn").select("classes").mapInArrow(count_classes, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows")).toArrow()  # at most CLASSES rows
    model = Model(None, tokens, vocabulary, np.zeros(LEVELS + 1))
    model.weights = fit_weights(model, seen.column("key").to_numpy(), seen.column("rows").to_numpy())
    scored = levelled.select("uid", "doc_id", "held_out", "n_tokens", "head_known", "head_logs", "classes").mapInArrow(partial(score_in_task, model=model), SCORED)
    rare = (
        levelled.select("uid", F.explode("rare").alias("r"))
        .select("uid", F.col("r.word").alias("key"), F.col("r.times").alias("times"))
        .join(words.filter(F.col("rows") < least), "key")
        .groupBy("uid")
        .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("rows") + 1.0)).alias("rare_logs"))
    )
    known = F.col("head_known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("head_logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + vocabulary + 1)))
    return scored.join(rare, "uid", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def level_in_task(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    head_keys, head_logs = shared.value
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for row, docs, every, starts in chunks_in(batch):
            levels = np.frombuffer(b"".join(f["levels"] for f in row["found"]), np.uint8)
            classes = classes_of(row, every, starts, levels).astype(np.int32)
            lengths = np.array([d["n"] for d in docs])
            words, token = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["at"], np.int32)
            at = np.minimum(np.searchsorted(head_keys, words), max(len(head_keys) - 1, 0))
            known = head_keys[at] == words if len(head_keys) else np.zeros(len(words), bool)
            logs = np.where(known, head_logs[at], 0.0) if len(head_keys) else np.zeros(len(words))
            known, logs = known[token], logs[token]
            rare = []
            for lo, n in zip(starts, lengths):
                word, times = np.unique(every[lo : lo + n][~known[lo : lo + n]], return_counts=True)
                rare.append([{"word": w, "times": t} for w, t in zip(word.view(np.int64).tolist(), times.tolist())])
            columns = {
                "uid": pa.array(uid + np.arange(len(docs)), pa.int64()),
                "doc_id": pa.array([d["doc_id"] for d in docs], pa.int64()),
                "held_out": pa.array([d["held_out"] for d in docs], pa.bool_()),
                "learn": pa.array([d["learn"] for d in docs], pa.bool_()),
                "n_tokens": pa.array(lengths, pa.int64()),
                "head_known": pa.array(np.add.reduceat(known.astype(np.int64), starts), pa.int64()),
                "head_logs": pa.array(np.add.reduceat(logs, starts), pa.float64()),
                "classes": pa.array([binary(classes[lo : lo + n]) for lo, n in zip(starts, lengths)], pa.binary()),
                "rare": pa.array(rare, schema.field("rare").type),
            }
            uid += len(docs)
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def score_in_task(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    logs = model.logs(np.arange(CLASSES))
    for batch in batches:
        score = [float(logs[np.frombuffer(c, np.int32)].sum()) for c in batch.column("classes").to_pylist()]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score, pa.float64())], names=[*names, "score"])
