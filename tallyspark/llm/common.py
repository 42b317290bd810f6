"""What the operators share: session settings, shared tables, word splitting and hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in one Arrow batch; whole documents are long, so batches stay small.
BATCH_ROWS = 512
#: Bytes of text that are split into words at once.
SLICE = 1_000_000
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch of long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or on a local master, where driver and executors
    are one process, a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the operators need a folder that all executors share")
    fallback = getattr(spark, "_tallyspark_shared", None)
    if fallback is None:
        fallback = spark._tallyspark_shared = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    return fallback


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_tallyspark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def id_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, as UTF-8; bytes.lower and bytes.split know exactly those."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_slices(data: bytes) -> Iterator[list[bytes]]:
    """A text's words [^\\x20\\x09-\\x0D]+, in lists of the words of about SLICE bytes."""
    start = 0
    while start < len(data):
        end = SPACE.search(data, start + SLICE)
        end = end.end() if end else len(data)
        yield data[start:end].split()
        start = end


class HashCache(dict):
    """Word -> 64-bit hash; emptied when it has grown to its bound."""

    def __init__(self, most: int = 400_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by sorting: for many 64-bit ones several times as fast as np.unique."""
    x = np.sort(x)
    return x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] if len(x) else x


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width`-word shingles; shorter texts are one shingle, empty ones none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : n - width + 1 + i])
    return distinct(out)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema; only the driver can parse it."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def ddl_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """mapInArrow with one function per task, made by `make` on the executor, from columns to columns."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each({name: batch.column(i) for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip((out[f.name] for f in arrow), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
