"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over hashed words and word pairs is fitted to confirmed toxic texts (P) and texts taken as unlabelled
(U). With class prior p the risk is p * E_P[loss+] + max(0, E_U[loss-] - p * E_P[loss-]): the negatives' share of U is
what remains after taking out the positives', and where that estimate falls below zero its gradient is turned around.
P and U are bounded samples, the documented limits below; every text is scored, whole.

Null and empty texts have no features and get the model's base score. Without any positive example every score is the
prior's floor, 0. Repeated rows each get a score; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import Adam, Rows, bounded_sample, once, sample_texts, sigmoid, word_features

BITS = 20
MOST_POSITIVE = 4000
MOST_UNLABELLED = 8000
MOST_FEATURES = 4096
ROUNDS = 250
L2 = 2e-4
FOLDS = 5


def sample_features(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Distinct features of each sampled text (bounded by the sample's limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            doc, feature = once(*word_features(piece, BITS), BITS)
            cuts = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "f"])

    table = sample_texts(docs.select("doc_id", "text"), ids).mapInArrow(run, "doc_id bigint, f array<int>").toArrow().sort_by("doc_id")
    return [x.values.to_numpy() for x in table.column("f")]


def choose(p: list[np.ndarray], u: list[np.ndarray], prior: float, most: int = MOST_FEATURES) -> np.ndarray:
    """Features whose shares in P and U differ by over four standard errors and, with the positives' part taken out
    of U, by a factor over three between P and the negatives. The most significant ones, if there are too many."""
    dp, du = (np.bincount(np.concatenate([np.zeros(0, np.int64), *x]), minlength=1 << BITS) for x in (p, u))
    rp, ru = dp / max(1, len(p)), du / max(1, len(u))
    both = (dp + du) / max(1, len(p) + len(u))
    z = np.abs(rp - ru) / np.sqrt(both * (1 - both) * (1 / max(1, len(p)) + 1 / max(1, len(u))) + 1e-12)
    rn = np.maximum(ru - prior * rp, 0) / (1 - prior)
    least = 1 / max(1, len(p))
    z[(dp + du < 6) | (np.abs(np.log((rp + least) / (rn + least))) < np.log(3))] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 4])


def fit_nnpu(p: list[np.ndarray], u: list[np.ndarray], prior: float, chosen: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of the chosen features and the bias that minimise the non-negative risk with logistic loss."""

    def rows(texts):
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate([np.zeros(0, np.int64), *texts])
        at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1) if len(chosen) else np.zeros(len(flat), np.int64)
        ok = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
        return Rows(row[ok], at[ok], len(texts), len(chosen))

    rp, ru = rows(p), rows(u)
    w, adam = np.zeros(len(chosen) + 1), Adam(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(rounds):
        sp, su = (sigmoid(r.times(w[:-1]) + w[-1]) for r in (rp, ru))
        # Mean gradients over the scores: of loss+ on P, loss- on P and loss- on U.
        plus, minus, free = (sp - 1) / len(p), sp / len(p), su / len(u)
        rest = np.mean(np.log1p(np.exp(np.clip(ru.times(w[:-1]) + w[-1], -60, 60)))) - prior * np.mean(np.log1p(np.exp(np.clip(rp.times(w[:-1]) + w[-1], -60, 60))))
        if rest >= 0:
            gp, gu = prior * (plus - minus), free
        else:
            gp, gu = prior * minus, -free
        g = np.append(rp.back(gp) + ru.back(gu), gp.sum() + gu.sum())
        g[:-1] += L2 * w[:-1]
        adam.step(w, g)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, positive: DataFrame, unlabelled: DataFrame, prior: float, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[np.ndarray, float]:
    """Dense weights (2^BITS floats, 4 MB) and bias from ids (doc_id) of confirmed and of unlabelled texts."""
    p = sample_features(docs, bounded_sample(positive, most_positive))
    u = sample_features(docs, bounded_sample(unlabelled, most_unlabelled))
    dense = np.zeros(1 << BITS, np.float32)
    if not p or not u:
        return dense, -60.0
    prior = float(np.clip(prior, 1e-3, 0.9))
    chosen = choose(p, u, prior)
    w, bias = fit_nnpu(p, u, prior, chosen)
    dense[chosen] = w
    return dense, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every row."""
    used = np.flatnonzero(weights)
    values = weights[used].astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, bool)
        mask[used] = True
        for piece in common.pieces(batches):
            doc, feature = word_features(piece, BITS)
            ok = mask[feature]
            doc, feature = once(doc[ok], feature[ok], BITS)
            total = bias + np.bincount(doc, weights=values[np.searchsorted(used, feature)], minlength=piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(sigmoid(total))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted), learnt from rows outside fold 0 of crc32(doc_id).

    Positives are training rows with label 1. All other training rows are unlabelled, label 0 or none; the prior is
    the share of label 1 among labelled training rows.
    """
    rest = common.crc_mod(F.col("doc_id"), folds) != 0
    known = labels.where(rest & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    weights, bias = train(docs, known.where("toxic = 1"), docs.where(rest).select("doc_id"), share or 0.0)
    out = score(docs, weights, bias)
    return out.select("doc_id", (~rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
