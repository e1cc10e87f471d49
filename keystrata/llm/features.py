"""Hashed features and bounded training samples shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters, digits and all non-ASCII bytes make words here; other bytes part them.
WORD_BYTES = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    WORD_BYTES[_b] = _b


def word_features(batch: pa.RecordBatch, bits: int, bigrams: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of all words and word pairs, hashed to ``bits`` bits, repeats included."""
    buf, offsets = common.text_buffer(batch.column("text"))
    buf = WORD_BYTES[buf]
    starts, ends, doc = common.word_spans(buf, offsets)
    words = common.segment_hash(buf, starts, ends, lower=True)
    shift = common.U64(64 - bits)
    if not bigrams:
        return doc, (words >> shift).astype(np.int64)
    pairs, at = common.shingle_hash(words, doc, 2)
    return np.concatenate((doc, doc[at])), np.concatenate((words >> shift, pairs >> shift)).astype(np.int64)


def once(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once, ordered by text."""
    both = np.unique(doc.astype(np.int64) << bits | feature)
    return both >> bits, both & ((1 << bits) - 1)


def bounded_sample(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct doc_id, the least by hash: the same ones on every run."""
    return ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs in a bounded sample, whose ids are broadcast."""
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Rows:
    """Sparse binary rows: sums of weights per row and of row values per feature."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n_rows: int, n_features: int):
        self.row, self.feature, self.n_rows, self.n_features = row, feature, n_rows, n_features

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n_rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, weights=g[self.row], minlength=self.n_features)


class Adam:
    def __init__(self, size: int, rate: float = 0.05):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
