"""Quality rules: word, symbol and repetition counts, and compression bands.

A document's zstandard ratio (bytes / compressed bytes) must lie in a band chosen by its length, and so must most of
its fixed chunks, the last partial one included: text that compresses far better is repetitive, text that hardly
compresses is noise. A chunk is held to the band of a text of its length. Tails under ``MIN_BYTES`` have no verdict of
their own and pass; so would texts, but the ten words that the word rule asks for take more.

Null text counts as empty. Empty text has no words, so the word rule rejects it. Texts of any length are read whole. A
ratio just on a limit (a tie) is inside. Extra input columns are ignored, whatever their names; repeated rows and rows
without doc_id each get their own result; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

#: (bytes, lowest ratio, highest ratio), in between interpolated by the logarithm of the length. Five standard
#: deviations on either side of the mean ratio of texts of that length, from the texts labelled good with even doc_id
#: in sf0.1; below 128 bytes from slices of them, with a wider margin. From 65536 bytes on too few exist: the trend is
#: carried on with a wider margin, and the last row is a guess.
BANDS = [
    (16, 0.50, 0.85), (32, 0.60, 1.05), (64, 0.70, 1.50), (128, 0.95, 1.60), (256, 1.14, 1.81), (512, 1.33, 1.93), (1024, 1.60, 2.10), (2048, 1.85, 2.20), (4096, 2.01, 2.30),
    (8192, 2.10, 2.41), (16384, 2.20, 2.50), (32768, 2.32, 2.61), (65536, 2.30, 2.85), (131072, 2.20, 3.10), (1 << 20, 1.5, 5.0),
]
MIN_BYTES = BANDS[0][0]
CHUNK_BYTES = 4096
#: A document fails if more than this share of its bytes lies in chunks outside their band.
BAD_CHUNK_SHARE = 1 / 3
LEVEL = 3
WINDOW_WORDS = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = b"[#*$%&|<>]"[1:-1]

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint"
)


def band(n_bytes: int, bands=BANDS) -> tuple[float, float] | None:
    if n_bytes < bands[0][0]:
        return None
    for (a, low_a, high_a), (b, low_b, high_b) in itertools.pairwise(bands):
        if n_bytes < b:
            part = math.log(n_bytes / a) / math.log(b / a)
            return low_a + part * (low_b - low_a), high_a + part * (high_b - high_a)
    return bands[-1][1:]


def inside(n_bytes: int, ratio: float, bands=BANDS) -> bool:
    limits = band(n_bytes, bands)
    return limits is None or limits[0] <= ratio <= limits[1]


def compression_verdict(data: bytes, squeeze, bands=BANDS, chunk_bytes=CHUNK_BYTES) -> tuple[bool, float, int, int]:
    """Passes, whole ratio, chunks, chunks outside their band. squeeze: bytes to compressed bytes."""
    if band(len(data), bands) is None:
        return True, 0.0, 0, 0
    ratio = len(data) / len(squeeze(data))
    whole = inside(len(data), ratio, bands)
    if len(data) <= chunk_bytes:
        return whole, ratio, 1, int(not whole)
    chunks = [data[i : i + chunk_bytes] for i in range(0, len(data), chunk_bytes)]
    bad = [len(c) for c in chunks if not inside(len(c), len(c) / len(squeeze(c)), bands)]
    return whole and sum(bad) <= BAD_CHUNK_SHARE * len(data), ratio, len(chunks), len(bad)


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int = WINDOW_WORDS) -> np.ndarray:
    """Per document, words inside windows that occur twice or more in it (windows compared by 64-bit hash)."""
    keys, at = common.shingle_hash(words, doc, width)
    if not len(keys):
        return np.zeros(n_docs, np.int64)
    keys = keys ^ common.mix(doc[at].astype(np.uint64) + common.U64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    hits = at[twice]
    np.add.at(edge, hits, 1)
    np.subtract.at(edge, hits + width, 1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def measure(batch: pa.RecordBatch, squeeze) -> pa.RecordBatch:
    buf, offsets = common.text_buffer(batch.column("text"))
    n = batch.num_rows
    starts, ends, doc = common.word_spans(buf, offsets)
    n_words = np.bincount(doc, minlength=n)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    counted = (~common.IS_SPACE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)
    sums = [np.concatenate(([0], np.cumsum(t[buf]))) for t in (counted, is_symbol.astype(np.int64))]
    word_chars, n_symbols = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    repeat = repeated_words(common.segment_hash(buf, starts, ends), doc, n)
    raw = buf.tobytes()
    texts = [raw[offsets[i] : offsets[i + 1]] for i in range(n)]
    dup = np.fromiter((duplicate_lines(t) for t in texts), np.int64, n)
    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    verdicts = [compression_verdict(t, squeeze) for t in texts]
    passed = np.array([v[0] for v in verdicts], bool)
    columns = [batch.column("doc_id"), n_words, word_chars, n_symbols, dup, repeat, failed, ~failed & passed, [v[1] for v in verdicts], [v[2] for v in verdicts], [v[3] for v in verdicts]]
    return [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]


def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]
    for piece in common.pieces(batches):
        columns = [c.cast(t) for c, t in zip(measure(piece, squeeze), types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA per row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def filter_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs that pass, all columns kept. The verdict rides along in the same pass: no join, no shuffle."""
    names = docs.columns
    common.bounded_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for piece in common.pieces(batches):
            yield piece.filter(measure(piece.select([names.index("doc_id"), names.index("text")]), squeeze)[7])

    return docs.mapInArrow(keep, docs.schema)
