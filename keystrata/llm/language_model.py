"""Hashed maximum-entropy language model with class-factored softmax.

Tokens are lower-cased words and one end per document. Words are counted over all training documents, exactly. The
most frequent ones are factored into classes by rank; all others form a last class, which is factored into groups by
their last two letters. Inside a group a word's probability is (count + 1) / (the group's counts + types + 1), an unseen
word counting as one further type. So

    P(token | context) = P(class | context) * P(place | class, context) [* P(word | group)]

is a distribution for any count table. A place is a frequent word of its class, or a group of the last one. Both
softmaxes are log-linear in hashed features: the word before, the pair before, and words skipped to at distances two and
three (classes); the first and third of these (places). Weights start at the unigram model.

The rows of both tables, the buckets that tell rare words apart as contexts, the tokens of a shard and the blocks that
changes are averaged in grow with the square root of the training tokens, so that shards times weights, which is what a
round shuffles, grow in proportion to the text. MOST_SCALE bounds the weights by what a task can hold.

Training is one pass over all training documents in ROUNDS disjoint parts. A part is dealt by a hash of id and text into
shards of about SHARD_TOKENS tokens, so their number follows the corpus and neither files nor tasks have a say. From the
round's weights each shard runs sparse Adagrad steps over minibatches of its documents in the order of that hash; the
shards' changes are averaged by tokens, block by block, and become the next round's weights. A shard learns no less in
a larger corpus, so the gain does not fade as shards multiply.

Counts of frequent words travel in a broadcast table of at most HEAD_WORDS rows; documents carry the hashes of all
other words, which are joined with the count table, so that every count is exact at any vocabulary size.

Null and empty texts consist of their end; a null doc_id is held out or not by the empty text's checksum. Rows that
repeat a doc_id are separate rows, each scored by its own text. Words of equal count rank by hash. Texts of any length
are read whole. Extra columns are ignored, whatever their names; an empty table gives an empty result. With no training
documents all counts are 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = common.U64
FOLDS, HELD = 7, 2
CLASSES, CLASS_WORDS = 32, 64
FREQUENT = (CLASSES - 1) * CLASS_WORDS
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 13
HEAD_WORDS = 1 << 18
CONTEXT_BUCKETS = 4096
ROUNDS = 2
RATE = 0.06
MINIBATCH = 8192
#: Rows worked on at a time, so that they stay in a core's cache; without influence on results.
CACHED = 1024
#: Tokens a shard trains on, and the most shards of a round: beyond that shards grow.
SHARD_TOKENS = 1_000_000
MOST_SHARDS = 4096
BLOCKS = 16
#: Up to four times so many training tokens the sizes above hold; they double with each further factor of four.
SCALE_TOKENS = 16_000_000
#: 256 MB of weights, beyond 6.5e10 training tokens.
MOST_SCALE = 64
#: The low bits of a token's hash, its group: the hashed last two bytes of the word.
GROUP = CLASS_WORDS - 1
END = U64(0xE0D0E0D0E0D0E0D1)
#: Word hashes a task holds before it sends their counts on.
HELD_COUNTS = 4_000_000
LN10 = np.log(10.0)


def tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the piece's tokens, each document's end included, and the documents' cuts."""
    buf, offsets = common.text_buffer(piece.column("text"))
    starts, ends, doc = common.word_spans(buf, offsets)
    words = common.segment_hash(buf, starts, ends, lower=True)
    last, second = buf[ends - 1], np.where(ends - starts > 1, buf[np.maximum(ends, 2) - 2], 0)
    low = [x.astype(np.uint64) + U64(32) * ((x >= 65) & (x <= 90)) for x in (last, second)]
    words = words & ~U64(GROUP) | common.mix(low[0] * U64(256) + low[1]) >> U64(58)
    cuts = np.searchsorted(doc, np.arange(piece.num_rows + 1))
    out = np.empty(len(words) + piece.num_rows, np.uint64)
    out[np.arange(len(words)) + doc] = words
    cuts = cuts + np.arange(piece.num_rows + 1)
    out[cuts[1:] - 1] = END
    return out, cuts


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD for i in ids], bool)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every token of the training documents. Each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, first = np.unique(keys[order], return_index=True)
            return keys, np.add.reduceat(values[order], first)

        for piece in common.pieces(batches):
            piece = piece.filter(pa.array(~held_out(piece.column("doc_id").to_pylist())))
            if not piece.num_rows:
                continue
            found = np.unique(tokens(piece)[0], return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > HELD_COUNTS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_COUNTS // 2:
                    yield from _count_batches(*held[0])
                    held, size = [], 0
        if held:
            yield from _count_batches(*merged())

    counts = docs.select("doc_id", "text").mapInArrow(run, "h bigint, c bigint")
    return counts.groupBy("h").agg(F.sum("c").alias("c"))


def _count_batches(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 17):
        cut = slice(at, at + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(keys[cut].view(np.int64)), pa.array(values[cut].astype(np.int64))], names=["h", "c"])


def scale(n: int) -> int:
    """The factor of the model's sizes for n training tokens: a power of two near the root of n / SCALE_TOKENS."""
    return min(MOST_SCALE, 1 << int(max(0.0, np.log2(max(n, 1) / SCALE_TOKENS)) / 2))


class Vocabulary:
    """The frequent words by hash, with rank and count, the totals, and the masses of the last class's groups."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, mass: np.ndarray):
        """hashes in descending order of count; mass: counts and types of all words by group."""
        order = np.argsort(hashes)
        self.hashes, self.counts, self.rank = hashes[order], counts[order], order.astype(np.int64)
        self.n, self.v = n, v
        top = counts[:FREQUENT]
        self.top = top
        self.rest = mass - np.bincount((hashes[:FREQUENT] & U64(GROUP)).astype(np.int64), weights=top + 1.0, minlength=CLASS_WORDS) + 1.0
        self.scale = scale(n)
        self.buckets = CONTEXT_BUCKETS * self.scale

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and count (0 where not in the table) of each hash."""
        if not len(self.hashes):
            return np.full(len(found), -1), np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = self.hashes[at] == found
        return np.where(hit, self.rank[at], -1), np.where(hit, self.counts[at], 0)


def token_ids(hashes: np.ndarray, rank: np.ndarray, buckets: int) -> np.ndarray:
    """Model ids: ranks below FREQUENT, else one of the buckets by hash. An id's low bits are its place in its class."""
    return np.where((rank >= 0) & (rank < FREQUENT), rank, FREQUENT + (hashes % U64(buckets)).astype(np.int64))


def contexts(ids: np.ndarray, cuts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids one, two and three before each token; ``start`` before a document."""
    place = np.arange(len(ids)) - np.repeat(cuts[:-1], np.diff(cuts))
    back = []
    for d in (1, 2, 3):
        x = np.full(len(ids), start)
        x[d:] = ids[:-d] if d < len(ids) else ids[:0]
        x[place < d] = start
        back.append(x)
    return tuple(back)


def _hashed(x: np.ndarray, salt: int, rows: int) -> np.ndarray:
    # Sorting 16 bits is much faster.
    return (common.mix(x.astype(np.uint64) * U64(8) + U64(salt)) % U64(rows)).astype(np.uint16 if rows <= 1 << 16 else np.uint32)


class Maxent:
    """Two row tables over a fixed unigram bias."""

    def __init__(self, vocabulary: Vocabulary):
        counts = np.zeros(FREQUENT)
        counts[: len(vocabulary.top)] = vocabulary.top
        grid = np.concatenate((counts, vocabulary.rest)).reshape(CLASSES, CLASS_WORDS)
        mass = grid.sum(axis=1)
        self.class_bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        # A place without a word has no chance; a class without words keeps a flat, unused row.
        inside = np.where(grid > 0, np.log(np.maximum(grid, 1e-30) / np.maximum(grid.sum(axis=1, keepdims=True), 1e-30)), -80.0)
        self.word_bias = inside.astype(np.float32)
        self.class_table = np.zeros((CLASS_ROWS * vocabulary.scale, CLASSES), np.float32)
        self.word_table = np.zeros((WORD_ROWS * vocabulary.scale, CLASS_WORDS), np.float32)
        self.start = FREQUENT + vocabulary.buckets
        # Rows of the features of one id, and of one id with a class, once for all ids.
        self.single = [_hashed(np.arange(self.start + 1), salt, len(self.class_table)) for salt in (1, 3, 4)]
        self.paired = [_hashed(np.arange((self.start + 1) * CLASSES), salt, len(self.word_table)) for salt in (5, 6)]

    def feature_rows(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> list[np.ndarray]:
        """Class-table rows of: word before, pair before, word at distance two, word at distance three."""
        return [self.single[0][w1], _hashed(w1 << 20 | w2, 2, len(self.class_table)), self.single[1][w2], self.single[2][w3]]

    def word_rows(self, w1: np.ndarray, w2: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        return [self.paired[0][w1 * CLASSES + cls], self.paired[1][w2 * CLASSES + cls]]

    def flat(self) -> np.ndarray:
        return np.concatenate((self.class_table.reshape(-1), self.word_table.reshape(-1)))

    def load(self, flat: np.ndarray) -> None:
        cut = self.class_table.size
        self.class_table = flat[:cut].reshape(-1, CLASSES).astype(np.float32)
        self.word_table = flat[cut:].reshape(-1, CLASS_WORDS).astype(np.float32)

    @staticmethod
    def _logits(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = table.take(rows[0], axis=0)
        for r in rows[1:]:
            z += table.take(r, axis=0)
        z += bias
        return np.minimum(z, 60.0, out=z)  # far above any sum of logs and weights

    def _class_logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return self._logits(self.class_table, self.class_bias, rows)

    def _word_logits(self, rows: list[np.ndarray], cls: np.ndarray) -> np.ndarray:
        return self._logits(self.word_table, self.word_bias.take(cls, axis=0), rows)

    @staticmethod
    def _log_share(z: np.ndarray, target: np.ndarray) -> np.ndarray:
        picked = z[np.arange(len(z)), target]
        np.exp(z, out=z)
        return picked - np.log(z @ np.ones(z.shape[1], np.float32))

    @staticmethod
    def _error(z: np.ndarray, target: np.ndarray) -> np.ndarray:
        np.exp(z, out=z)
        z *= (1.0 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        z[np.arange(len(z)), target] -= 1
        return z

    def log_probabilities(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(place | class): of the word, or of its group for tokens of the last class."""
        out = np.zeros(len(ids))
        back = contexts(ids, cuts, self.start)
        for at in range(0, len(ids), CACHED):
            cut = slice(at, at + CACHED)
            now, w = ids[cut], [b[cut] for b in back]
            cls = np.minimum(now // CLASS_WORDS, CLASSES - 1)
            out[cut] = self._log_share(self._class_logits(self.feature_rows(*w)), cls)
            out[cut] += self._log_share(self._word_logits(self.word_rows(w[0], w[1], cls), cls), now % CLASS_WORDS)
        return out

    def train(self, ids: np.ndarray, cuts: np.ndarray, sums: list[np.ndarray]) -> None:
        """Adagrad steps over the documents; sums holds the squared gradients of both tables."""
        back = contexts(ids, cuts, self.start)
        for at in range(0, len(ids), MINIBATCH):
            cut = slice(at, at + MINIBATCH)
            now, w = ids[cut], [b[cut] for b in back]
            cls, place = np.minimum(now // CLASS_WORDS, CLASSES - 1), now % CLASS_WORDS
            class_rows, word_rows = self.feature_rows(*w), self.word_rows(w[0], w[1], cls)
            parts = []
            for low in range(0, len(now), CACHED):
                some = slice(low, low + CACHED)
                of_class = self._error(self._class_logits([r[some] for r in class_rows]), cls[some])
                parts.append((of_class, self._error(self._word_logits([r[some] for r in word_rows], cls[some]), place[some])))
            errors = [np.concatenate(x) for x in zip(*parts, strict=True)]
            self._step(self.class_table, sums[0], class_rows, errors[0])
            self._step(self.word_table, sums[1], word_rows, errors[1])

    @staticmethod
    def _step(table: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], g: np.ndarray) -> None:
        for r in rows:
            order = np.argsort(r, kind="stable")  # a radix sort for 16 bits
            ordered = r[order]
            new = np.ones(len(ordered), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            first = np.flatnonzero(new)
            used = ordered[first]
            # Most rows occur once: only the others are summed.
            sizes = np.diff(np.append(first, len(ordered)))
            total = g.take(order[first], axis=0)
            many = np.flatnonzero(sizes > 1)
            if len(many):
                more = sizes[many] - 1
                total[many] += np.add.reduceat(g.take(order[~new], axis=0), np.cumsum(more) - more, axis=0)
            for at in range(0, len(used), CACHED):
                row, step = used[at : at + CACHED], total[at : at + CACHED]
                grown = squares.take(row, axis=0)
                grown += step * step
                squares[row] = grown
                grown += 1.0
                np.sqrt(grown, out=grown)
                step *= np.float32(RATE)
                step /= grown
                table[row] -= step


def shard_count(n: int, rounds: int) -> int:
    """Shards of a round over n training tokens."""
    return min(MOST_SHARDS, max(1, round(n / rounds / SHARD_TOKENS / scale(n))))


def training_tokens(docs: DataFrame, shared, rounds: int, shards: int) -> DataFrame:
    """(round, shard, place, ids): the training documents' model ids, four bytes each, and where they belong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0]
        for piece in common.pieces(batches):
            hashes, cuts = tokens(piece)
            some, back = np.unique(hashes, return_inverse=True)
            ids = token_ids(some, vocabulary.look_up(some)[0], vocabulary.buckets).astype(np.uint32)[back]
            raw = ids.tobytes()
            texts = [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("round", "shard", "place")), pa.array(texts, pa.binary())], names=["round", "shard", "place", "ids"])

    dealt = docs.where(common.crc_mod(F.col("doc_id"), FOLDS) != HELD).select("text", F.xxhash64("doc_id", "text").alias("place"))
    dealt = dealt.select("text", "place", F.pmod("place", F.lit(rounds)).cast("int").alias("round"), F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.mapInArrow(run, "round int, shard int, place bigint, ids binary")


def fit(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over all training documents in ``rounds`` parts of averaged local steps."""
    spark = docs.sparkSession
    weights = Maxent(vocabulary).flat()
    shards, blocks = shard_count(vocabulary.n, rounds), BLOCKS * vocabulary.scale
    size = -(-len(weights) // blocks)
    shared = spark.sparkContext.broadcast((vocabulary, weights))
    table = common.materialise(training_tokens(docs, shared, rounds, shards), "training-tokens")
    for number in range(rounds):
        if number:
            shared = spark.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, start = shared.value
            model, seen, shard, sums, held = None, 0, None, [], []

            def learn():
                nonlocal held, seen
                model.train(np.concatenate(held).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in held]))), sums)
                seen, held = seen + sum(map(len, held)), []

            def finished() -> Iterator[pa.RecordBatch]:
                learn()
                change = model.flat() - start
                for b in range(blocks):
                    data = zlib.compress(change[b * size : (b + 1) * size].astype(np.float16).tobytes(), 1)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "shard": pa.array([shard], pa.int32()), "n": pa.array([seen], pa.int64()), "change": pa.array([data], pa.binary())})

            for batch in batches:
                for now, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    if now != shard:
                        if held:
                            yield from finished()
                        model, seen, shard = Maxent(vocabulary), 0, now
                        model.load(start)
                        sums = [np.zeros_like(model.class_table), np.zeros_like(model.word_table)]
                        held_tokens = 0
                    elif held_tokens >= 64 * MINIBATCH:
                        learn()
                        held_tokens = 0
                    held.append(np.frombuffer(ids, np.uint32))
                    held_tokens += len(held[-1])
            if held:
                yield from finished()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for b, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "change")), strict=True):
                    change = np.frombuffer(zlib.decompress(data), np.float16).astype(np.float64) * n
                    have = total.setdefault(b, [0, 0.0])
                    have[0] += n
                    have[1] = have[1] + change
            for b, (n, change) in total.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "change": pa.array([(change / n).astype(np.float32).tobytes()], pa.binary())})

        part = table.where(F.col("round") == number).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
        changes = part.mapInArrow(run, "block int, shard int, n bigint, change binary").repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "shard")
        weights = weights.copy()
        for r in changes.mapInArrow(average, "block int, change binary").collect():  # one model
            weights[r.block * size : (r.block + 1) * size] += np.frombuffer(r.change, np.float32)
        shared.unpersist()
    common.drop_table(table)
    return weights


ROWS = "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, head_log double, model_log double, tail array<bigint>, tail_n array<int>, top_log double, rest_log double"


def score_rows(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """ROWS: what the broadcast table settles of each document, and the hashes of its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, flat = shared.value
        model, row_id = Maxent(vocabulary), TaskContext.get().partitionId() << 40
        model.load(flat)
        for piece in common.pieces(batches):
            n = piece.num_rows
            hashes, cuts = tokens(piece)
            some, back = np.unique(hashes, return_inverse=True)
            rank, count = vocabulary.look_up(some)
            ids = token_ids(some, rank, vocabulary.buckets)[back]
            doc = np.repeat(np.arange(n), np.diff(cuts))
            local = (rank >= 0)[back]
            logs = np.where(local, np.log(count[back] + 1.0), 0.0)
            add = lambda x: np.bincount(doc, weights=x, minlength=n)
            # A document's other words, each once with its number of times.
            far = np.flatnonzero(~local)
            both, times = np.unique(doc[far] * len(some) + back[far], return_counts=True)
            owner = both // max(1, len(some))
            lists = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
            tail = pa.ListArray.from_arrays(lists, pa.array(some[both % max(1, len(some))].view(np.int64)))
            tail_n = pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))
            ids_column = piece.column("doc_id").cast(pa.int64())
            columns = [
                pa.array(np.arange(row_id, row_id + n)), ids_column, pa.array(held_out(ids_column.to_pylist())), pa.array(np.diff(cuts)),
                pa.array(add(local).astype(np.int64)), pa.array(add(logs)), pa.array(add(model.log_probabilities(ids, cuts))), tail, tail_n,
                pa.array(add(np.where(ids < FREQUENT, logs, 0.0))), pa.array(add(np.where(ids < FREQUENT, 0.0, np.log(vocabulary.rest)[ids % CLASS_WORDS]))),
            ]
            row_id += n
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the HEAD_WORDS most frequent words (all, if there are fewer) in descending order, words of
    equal count by hash.

    Counts are binned: single counts below 4096 and sixteenths of powers of two above, so the histogram has a fixed size
    and no task sorts the whole table. Of the bin that does not fit whole, the room left is filled.
    """
    c = F.col("c")
    place = F.when(c < 4096, c).otherwise(F.lit(4096) + F.floor(F.log2(c.cast("double")) * 16)).cast("int")
    bins = counts.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least, next_bin = 0, 1 << 30, None
    for b in sorted(bins, key=lambda r: -r.b):
        if total + b.n > HEAD_WORDS:
            next_bin = b.b
            break
        total, least = total + b.n, b.b
    order = [c.desc(), F.shiftrightunsigned("h", 1), "h"]
    parts = [counts.where(place >= least).toArrow()]
    if next_bin is not None and total < HEAD_WORDS:
        parts.append(counts.where(place == next_bin).orderBy(*order).limit(HEAD_WORDS - total).toArrow())
    head = pa.concat_tables(parts)
    hashes, number = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.lexsort((hashes, -number))
    return hashes[order], number[order]


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logs to base 10."""
    counts = common.materialise(word_counts(docs), "word-counts")
    n, v, mass = 0, 0, np.zeros(CLASS_WORDS)
    for r in counts.groupBy(F.col("h").bitwiseAND(GROUP).alias("g")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        n, v, mass[r.g] = n + r.c, v + r.n, r.c + r.n
    vocabulary = Vocabulary(*frequent_words(counts), n, v, mass)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    weights = fit(docs, vocabulary, rounds)
    rows = common.materialise(score_rows(docs, vocabulary, weights), "scored")
    words = rows.select("row_id", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row_id", F.col("t.tail").alias("h"), F.col("t.tail_n").alias("k"))
    c = F.coalesce("c", F.lit(0))
    tail = words.join(counts, "h", "left").groupBy("row_id").agg(F.sum(F.col("k") * F.log(c + 1.0)).alias("far_log"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("far_known"))
    out = rows.drop("tail", "tail_n").join(tail, "row_id", "left")
    far = F.coalesce("far_log", F.lit(0.0))
    base = (F.col("head_log") + far - F.col("n_tokens") * F.lit(float(np.log(n + v + 1.0)))) / F.lit(float(LN10))
    # Words of the last class: their counts over their group's total. top_log belongs to words outside it.
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        ((F.col("model_log") + F.col("head_log") - F.col("top_log") + far - F.col("rest_log")) / F.lit(float(LN10))).alias("score"),
    )
