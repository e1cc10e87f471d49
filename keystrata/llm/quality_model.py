"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text; each of them errs. Expectation-maximisation over
the counts of vote patterns of all documents (at most 3^labellers of them) starts at the majority and estimates the prior
and, for each labeller and class, how often its votes are good or bad; no vote is no evidence. So a bad vote of a labeller
that often errs is overruled by good ones, and one of a labeller that hardly does is not. Posterior labels of a bounded sample train a logistic scorer over hashed word shapes and
hashed statistic bins; the scorer then rates every text, whole.

No given label is used. Null and empty texts have no words: every labeller abstains and the scorer's base rate holds,
so they are kept. Patterns with as many good as bad votes start at a half. Texts of any length are read whole. Repeated rows each get a result; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import Adam, bounded_sample, sample_texts, sigmoid
from .quality_rules import LEVEL, SYMBOLS, band, duplicate_lines, repeated_words

BITS = 14
MOST_TRAINING = 6000
ROUNDS = 300
EM_ROUNDS = 60

STATISTICS = ["symbols", "capitals", "repeats", "lines", "wordless", "short", "ratio", "marks"]
#: From here on a labeller votes bad.
FAULTS = {"symbols": 0.1, "capitals": 0.1, "repeats": 0.15, "lines": 0.3, "wordless": 0.04, "short": 0.48, "ratio": 1.0, "marks": 0.2}
#: Up to here it votes good; between the two it abstains.
CLEAN = {"symbols": 0.02, "capitals": 0.05, "repeats": 0.02, "lines": 0.02, "wordless": 0.01, "ratio": 0.96, "marks": 0.05}
#: The share of short words that prose has: inside the last two, "short" votes good; below the first it votes bad.
PROSE_SHORT = (0.1, 0.22, 0.36)
#: "short" needs a text of so many words.
MIN_PROSE = 20
#: Texts with fewer words give no evidence.
MIN_WORDS = 4


def statistics(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One row of STATISTICS per text, its number of words, and (text index, hashed shape) of all words.

    A word's shape replaces letters by a or A, digits by 9 and folds runs, so that it carries case and punctuation only.
    """
    buf, offsets = common.text_buffer(batch.column("text"))
    n = batch.num_rows
    starts, ends, doc = common.word_spans(buf, offsets)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    upper = (buf >= 65) & (buf <= 90)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    per = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    any_letter = np.concatenate(([0], np.cumsum(letter)))
    bare = any_letter[ends] == any_letter[starts]
    raw, squeeze = buf.tobytes(), zstandard.ZstdCompressor(level=LEVEL).compress
    lines, ratio = np.zeros(n), np.zeros(n)
    for i in range(n):
        text = raw[offsets[i] : offsets[i + 1]]
        lines[i] = duplicate_lines(text) / max(1, text.count(b"\n") + 1)
        limits = band(len(text))
        if limits:
            r = len(text) / len(squeeze(text))
            ratio[i] = max(r / limits[1], limits[0] / r)
    hashes = common.segment_hash(buf, starts, ends)
    table = np.stack(
        [
            per(symbol[buf]) / some,
            per(upper) / np.maximum(per(letter), 1),
            repeated_words(hashes, doc, n) / some,
            lines,
            np.bincount(doc[bare], minlength=n) / some,
            np.bincount(doc[ends - starts <= 3], minlength=n) / some,
            ratio,
            (per(buf == 33) + per(buf == 63)) / some,
        ],
        axis=1,
    )
    shape = np.where(upper, 65, np.where(letter, 97, np.where((buf >= 48) & (buf <= 57), 57, buf))).astype(np.uint8)
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    first = np.zeros(len(shape) + 1, bool)
    first[starts] = True
    keep |= first[:-1]
    place = np.concatenate(([0], np.cumsum(keep)))
    folded = shape[keep]
    shapes = common.segment_hash(folded, place[starts], np.maximum(place[ends], place[starts] + 1))
    return table, words, doc, (shapes >> common.U64(64 - BITS)).astype(np.int64)


def votes(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    """+1 good, -1 bad, 0 no vote, per text and labeller."""
    out = np.zeros(table.shape, np.int8)
    for j, name in enumerate(STATISTICS):
        out[:, j] = np.where(table[:, j] >= FAULTS[name], -1, table[:, j] <= CLEAN.get(name, -1))
    j = STATISTICS.index("ratio")
    out[table[:, j] == 0, j] = 0  # too short for a band
    j = STATISTICS.index("short")
    low, good, high = PROSE_SHORT
    share = table[:, j]
    out[:, j] = np.where((share >= good) & (share <= high), 1, np.where((share < low) | (share >= FAULTS["short"]), -1, 0))
    out[words < MIN_PROSE, j] = 0
    out[words < MIN_WORDS] = 0
    return out


def pattern_code(vote: np.ndarray) -> np.ndarray:
    return (vote.astype(np.int64) + 1) @ (3 ** np.arange(vote.shape[1]))


def pattern_votes(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(STATISTICS)) % 3 - 1).astype(np.int8)


def fit_labellers(code: np.ndarray, count: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts: posterior of good per pattern, vote tables [labeller, class, bad or good], prior of good.

    Patterns start at the share of good among their votes. Abstentions are missing votes, not evidence.
    """
    vote = pattern_votes(code)
    bad, good = (vote < 0).astype(float), (vote > 0).astype(float)
    post = (good.sum(axis=1) + 1) / (good.sum(axis=1) + bad.sum(axis=1) + 2)
    weight = count.astype(float)
    tables = prior = None
    for _ in range(rounds):
        prior = float(np.clip((post * weight).sum() / max(weight.sum(), 1), 0.02, 0.98))
        classes = np.stack((1 - post, post)) * weight
        tables = np.stack((classes @ bad, classes @ good), axis=2).transpose(1, 0, 2) + 1.0
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.log(tables[:, 1] / tables[:, 0])
        post = sigmoid(bad @ odds[:, 0] + good @ odds[:, 1] + np.log(prior / (1 - prior)))
    return post, tables, prior if prior is not None else 0.5


def design(table: np.ndarray, words: np.ndarray, doc: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value): shares of word shapes, and one bin of each statistic."""
    n = len(words)
    both, times = np.unique(doc * (1 << BITS) + shape, return_counts=True)
    row, feature = both >> BITS, both & ((1 << BITS) - 1)
    value = times / np.maximum(words, 1)[row]
    spread = np.array([FAULTS[s] for s in STATISTICS])
    step = np.minimum((table / spread * 4).astype(np.int64), 6)
    step[words < MIN_WORDS] = 0
    names = common.mix((np.arange(len(STATISTICS))[None, :] * 16 + step + 1).astype(np.uint64))
    bins = (names >> common.U64(64 - BITS)).astype(np.int64)
    return np.concatenate((row, np.repeat(np.arange(n), len(STATISTICS)))), np.concatenate((feature, bins.reshape(-1))), np.concatenate((value, np.ones(n * len(STATISTICS))))


def vote_patterns(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the vote patterns of all documents, at most 3^labellers rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            table, words, _, _ = statistics(piece)
            code, count = np.unique(pattern_code(votes(table, words)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])

    found = docs.select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return found.column("code").to_numpy(), found.column("n").to_numpy()


def train(docs: DataFrame, most: int = MOST_TRAINING) -> tuple[np.ndarray, float, dict[int, float]]:
    """Weights and bias of the scorer, and the posterior of every vote pattern."""
    code, count = vote_patterns(docs)
    if not len(code):
        return np.zeros(1 << BITS), 2.0, {}
    post, _, prior = fit_labellers(code, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            table, words, doc, shape = statistics(piece)
            row, feature, value = design(table, words, doc, shape)
            order = np.argsort(row, kind="stable")
            cuts = pa.array(np.searchsorted(row[order], np.arange(piece.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order].astype(t))) for x, t in ((feature, np.int32), (value, np.float32))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(pattern_code(votes(table, words))), *lists], names=["doc_id", "code", "f", "v"])

    ids = bounded_sample(docs, most)
    got = sample_texts(docs.select("doc_id", "text"), ids).mapInArrow(run, "doc_id bigint, code bigint, f array<int>, v array<float>").toArrow().sort_by("doc_id")
    table = dict(zip(code.tolist(), post.tolist(), strict=True))
    y = np.array([table.get(c, prior) for c in got.column("code").to_pylist()])
    row = np.repeat(np.arange(len(y)), [len(x) for x in got.column("f")])
    flat = [np.concatenate([np.zeros(0), *(x.values.to_numpy() for x in got.column(c))]) for c in ("f", "v")]
    feature, value = flat[0].astype(np.int64), flat[1]
    w, adam = np.zeros((1 << BITS) + 1), Adam((1 << BITS) + 1)
    for _ in range(ROUNDS if len(y) else 0):
        s = sigmoid(np.bincount(row, weights=w[feature] * value, minlength=len(y)) + w[-1])
        g = (s - y) / len(y)
        step = np.bincount(feature, weights=g[row] * value, minlength=1 << BITS) + 1e-4 * w[:-1]
        adam.step(w, np.append(step, g.sum()))
    return w[:-1], float(w[-1]), table


def classify(docs: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """(doc_id, score, kept, posterior): the scorer's probability of good, whether it is at least a half, and the weak
    labels' own posterior."""
    weights, bias, posterior = train(docs, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            table, words, doc, shape = statistics(piece)
            row, feature, value = design(table, words, doc, shape)
            s = sigmoid(np.bincount(row, weights=weights[feature] * value, minlength=piece.num_rows) + bias)
            p = [posterior.get(c, 0.5) for c in pattern_code(votes(table, words)).tolist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(s), pa.array(s >= 0.5), pa.array(p, pa.float64())], names=["doc_id", "score", "kept", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, kept boolean, posterior double")
