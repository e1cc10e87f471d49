"""Shared parts: the folder all executors see, text batches as byte arrays, and vectorised word hashing.

Words are maximal runs of bytes other than space and \\t..\\r, hashed by a polynomial over GF-free 64-bit arithmetic
with random byte values. The same arrays serve every operator, so a word or shingle has one hash everywhere.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
PIECE_BYTES = 1 << 19


#: With it, Spark deletes a query's shuffle files when the query ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session, as in tests, gets one of its own;
    a cluster's machines would not see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch on its way to or from Python: texts of any usual batch fit an executor's memory many times.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of a few megabytes from now on; a single longer row still travels whole."""
    spark.conf.set(*ARROW_BYTES)
    return spark


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and reread: cuts lineage, survives lost executors. The query's shuffle
    files are deleted at its end."""
    spark, path = bounded_batches(df.sparkSession), f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialise(), once nothing lazy reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    ours = shared_dir(df.sparkSession).rsplit("/", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{ours}/" not in folder:
            raise ValueError(f"{folder} is not a table of the shared folder")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    """Partitions of an exchange, as the session sets them for its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Text batches ---------------------------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of text each; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


# Hashing ----------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = U64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE^0 .. BASE^(n-1) mod 2^64, or of its inverse; the table grows as needed and is kept."""
    table = _POWERS[inverse]
    if len(table) < n:
        step = U64(_inverse(int(BASE))) if inverse else BASE
        size = max(n, 2 * len(table), 1 << 12)
        factors = np.full(size, step, np.uint64)
        factors[0] = 1
        table = _POWERS[inverse] = np.multiply.accumulate(factors)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte positions) and document index of every word."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of buf[start:end] for ascending, disjoint, non-empty segments."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (LOWER_VALUE if lower else BYTE_VALUE)[buf]
    lengths = ends - starts
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    keep = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = values[keep] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) ^ lengths.astype(np.uint64))


def shingle_hash(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one document, and the index of each one's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = (out ^ words[j : j + n]) * BASE + U64(j + 1)
        out ^= out >> U64(29)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(out[at]), at


def crc_mod(spark_column, divisor: int):
    """crc32 of a number's decimal text, mod divisor; null counts as the empty text."""
    from pyspark.sql import functions as F

    return F.pmod(F.crc32(F.coalesce(spark_column.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def file_uri(path: str) -> str:
    """path as a URI that pyarrow's file systems accept."""
    if "://" in path:
        return path
    if path.startswith("file:"):
        return "file://" + path[5:]
    return "file://" + os.path.abspath(path)
