"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous supersteps.

Pieces and gaps (open sequences and the room left in them) are tables, ranked among those of equal size. A superstep takes
the pieces of one band of lengths, a power of two to the next, from the longest on: pieces and gaps are range-sorted, a
sweep finds for each class of pieces the successor gap class (the smallest gap that still fits), and conflicts between
pieces that want the same class are resolved by rank: the r-th piece takes the r-th gap, by an equi-join on class and
rank. What no gap fits opens new sequences. Then gaps are shrunk by what they took, written, and the next superstep
begins. There are at most 12 supersteps for 2,048 tokens, whatever the rows.

Sizes are integers from 1 to `capacity`, so the sweep is steered by the histograms of the two tables, of at most `capacity`
rows whatever the corpus size. A gap may take several pieces in one superstep, in the order of the sweep, so the packing is
that of best-fit decreasing, piece by piece.

Rows: a null text counts as empty (one piece holding only the end id); null ids and repeated rows are packed like
others; equal pieces are interchangeable, ties take any order; only `doc_id` and `text` are read; an empty table gives
no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from functools import lru_cache, reduce
from unicodedata import is_normalized

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, materialize, small_batches

CAPACITY = 2048
#: Chunks whose ids a worker remembers, from task to task.
CACHE = 300_000
#: Rows of one size that a task numbers together: hot sizes are dealt over buckets of about this many.
RANK_BUCKET = 20_000


#: Marks that are one pre-token of their own where they end a chunk (the apostrophe may begin another kind).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_marks() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 ones for themselves, the others
    by the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTES = byte_marks()


class WordIds(dict):
    """Chunk between ASCII spaces -> its ids as little-endian 32-bit integers. The tokenizer drops white space and
    never looks across it, so a text's ids are those of its chunks in order; nor across the edge between letters and
    the marks after them, so a word is encoded once for all its cases and endings. A special token's string in a text
    is that token, as the tokenizer has it by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {"": b""}

    def part(self, text: str) -> bytes:
        out = self.parts.get(text)
        if out is None:
            if len(self.parts) >= CACHE:
                self.parts.clear()
            out = self.parts[text] = self.encoded(text)
        return out

    def encoded(self, text: str) -> bytes:
        """Ids of a text; one of lower-case letters alone is a single word for the model as it is."""
        if text.isalpha() and text.islower() and text == text.lower() and is_normalized("NFC", text):
            word = text if text.isascii() else "".join(map(BYTES.__getitem__, text.encode()))
            ids = [token.id for token in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if len(chunk) > 200:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if core.isascii() and core.isalpha():
            out = self.part(core.lower()) + self.part(chunk[len(core) :])
        elif core.isalpha() and core.lower().isalpha() and is_normalized("NFC", core):  # lower case may end in a mark
            out = self.part(core) + self.part(chunk[len(core) :])
        else:
            out = self.part(chunk)
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = out
        return out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(1)
def shared_words(path: str) -> WordIds:
    """One for each Python worker, from task to task."""
    return WordIds(path)


PIECES = "doc_id long, pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with id 0 at the end, cut only where longer than
    `capacity`."""
    small_batches(docs.sparkSession)

    def make():
        words = shared_words(tokenizer_path)

        def each(columns):
            out = []
            for text in columns["text"].to_pylist():
                data = words.ids(text) + b"\0\0\0\0"
                step = 4 * capacity
                out.append([{"piece": k, "start": at // 4, "length": min(step, len(data) - at) // 4, "ids_crc32": zlib.crc32(data[at : at + step])} for k, at in enumerate(range(0, len(data), step))])
            return {"doc_id": columns["doc_id"], "pieces": out}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), PIECES, make).select("doc_id", F.inline("pieces"))


def sweep(pieces: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """One superstep over the class histograms (size -> count, at most `capacity` entries each): classes of pieces from
    the largest on, each matched with its successor gap class, and with the next one once that is used up; where no gap
    fits, sequences open. Gives rows (length, first rank, gap class, first rank in it, offset), sorted: from that rank on,
    pieces of that length take the gaps of that class rank by rank. Class 0 are the opened sequences, whose number is
    given too."""
    open_gaps = {gap: [(gap, 0, count)] for gap, count in gaps.items()}  # gap now -> runs of (class at the start, rank, count)
    sizes = sorted(open_gaps)
    runs, opened = [], 0

    def add(gap: int, own: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in open_gaps:
                open_gaps[gap] = []
                bisect.insort(sizes, gap)
            open_gaps[gap].append((own, first, count))

    for length in sorted(pieces, reverse=True):
        rank, left = 0, pieces[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):  # the successor class
                gap = sizes[at]
                own, first, count = open_gaps[gap].pop()
                if not open_gaps[gap]:
                    del open_gaps[gap], sizes[at]
                taken = min(left, count)
                runs.append((length, rank, own, first, capacity - gap))
                add(gap, own, first + taken, count - taken)
                add(gap - length, own, first, taken)
                rank, left = rank + taken, left - taken
            else:  # no gap fits: sequences open and fill with this class
                each = capacity // length
                more = max(1, left // each)
                filled = min(each, left)
                for k in range(filled):
                    runs.append((length, rank, 0, opened, k * length))
                    rank, left = rank + more, left - more
                add(capacity - filled * length, 0, opened, more)
                opened += more
    runs = np.array(runs, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))], opened


def histogram(df: DataFrame, size: str) -> dict[int, int]:
    """Size -> rows; sizes are 1 to `capacity`, so that is the most that the driver gets."""
    return {int(r[size]): r["rows"] for r in df.groupBy(size).agg(F.count("*").alias("rows")).collect()}


def ranked(df: DataFrame, size: str, row: str, counts: dict[int, int]) -> DataFrame:
    """Add rank: the position among rows of equal size, from 0, in any order; `row` differs by row. A size that many
    rows share is dealt over buckets, which are numbered apart and then offset by the counts of the buckets before."""
    many = df.sparkSession.createDataFrame([(n, -(-rows // RANK_BUCKET)) for n, rows in counts.items()], f"{size} long, buckets long")
    dealt = df.join(F.broadcast(many), size).withColumn("bucket", F.pmod(F.xxhash64(row), F.col("buckets"))).drop("buckets")
    before = dealt.groupBy(size, "bucket").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(Window.partitionBy(size).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = dealt.withColumn("within", F.row_number().over(Window.partitionBy(size, "bucket").orderBy(row)))
    return numbered.join(before.select(size, "bucket", "before"), [size, "bucket"]).withColumn("rank", F.col("within") - 1 + F.coalesce("before", F.lit(0))).drop("bucket", "before", "within")


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
WANTED = "doc_id long, piece int, start long, length long, ids_crc32 long, gap long, rank long, offset long"


def wanted_gaps(pieces: DataFrame, runs: np.ndarray) -> DataFrame:
    """Each ranked piece with the class and rank of the gap that the sweep gives it, and its offset there."""
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def make():
        def each(columns):
            length, rank = (columns[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            return {c: columns[c] for c in PIECE} | {"gap": run[:, 2], "rank": run[:, 3] + rank - run[:, 1], "offset": run[:, 4]}

        return each

    return map_rows(pieces.select(*PIECE, "rank"), WANTED, make)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). `pieces` is read several times:
    pass a written table."""
    spark = pieces.sparkSession
    counts = histogram(pieces, "length")
    rows = ranked(pieces.withColumn("row", F.monotonically_increasing_id()), "length", "row", counts).drop("row")
    rows = materialize(rows.repartitionByRange(F.desc("length"), "rank").sortWithinPartitions(F.desc("length"), "rank"), "ranked")
    gaps, sizes, sequences, packed = None, {}, 0, []
    for low in (1 << k for k in reversed(range(capacity.bit_length()))):  # lengths from low to 2 low - 1
        band = {n: count for n, count in counts.items() if low <= n < 2 * low}
        if not band:
            continue
        runs, opened = sweep(band, sizes, capacity)
        there = spark.range(opened).select(F.lit(0).cast("long").alias("gap"), F.col("id").alias("rank"), (F.col("id") + sequences).alias("sequence_id"))
        if gaps is not None and sizes:
            there = there.unionByName(ranked(gaps, "gap", "sequence_id", sizes))
        there = materialize(there, "there")
        wanted = wanted_gaps(rows.filter(F.col("length").between(low, 2 * low - 1)), runs)
        packed.append(materialize(wanted.join(there, ["gap", "rank"]).select(*PIECE, "sequence_id", "offset"), "packed"))
        sequences += opened
        rest = [n for n in counts if n < low]
        if rest:
            used = packed[-1].groupBy("sequence_id").agg(F.sum("length").alias("used"))
            left = F.when(F.col("gap") == 0, capacity).otherwise(F.col("gap")) - F.coalesce("used", F.lit(0))
            shrunk = there.join(used, "sequence_id", "left").select("sequence_id", left.cast("long").alias("gap")).filter(F.col("gap") >= min(rest))
            discard(gaps)
            gaps = materialize(shrunk, "gaps")
            sizes = histogram(gaps, "gap")
        discard(there)
    discard(gaps)
    discard(rows)
    if not packed:
        return materialize(pieces.select(*PIECE, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")), "packed")
    return reduce(DataFrame.unionByName, packed)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity), "pieces")
    packed = best_fit(pieces, capacity)
    discard(pieces)
    return packed
