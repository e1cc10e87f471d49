"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; strings are judged on the input and never cross documents.

A full suffix array over all positions would need more room than the texts, so suffixes are sampled by content: of
the SEED-byte strings inside a LENGTH-byte window the least by hash (leftmost on ties) is the window's anchor. Equal
windows have equal anchors, so no match of LENGTH bytes is missed. Consecutive windows with one anchor form a run; a
run's suffix is the text its windows cover. Suffixes are kept as sorted arrays of fingerprints (32 bits of the
anchor, 64 of the whole run with the anchor's place), dealt by anchor:

* within a task, documents come in batches in doc_id order. A batch's array is sorted, searched by a merge scan in
  every level of the family, and what no level holds becomes a new level; levels of about equal size merge, so sizes
  grow geometrically and an entry is merged a logarithmic number of times;
* a run that an earlier batch or an earlier run holds whole is repeated whole. The first of each different run stays
  open if another one of its anchor may share a window with it: such a window reaches far left or far right of the
  anchor, so the anchor with half of what a window adds to it must agree on that side (two hashes a run). By the anchor
  alone, ever more runs would stay open in a larger input, where any string of SEED bytes is soon found somewhere else;
* the open runs' texts, the edges of copied passages, are dealt by anchor and their windows compared one by one. Where
  they add up to more than half of the input, they go in several rounds of anchors, whose files are deleted in between;
* equal runs of one piece of a map task are folded before any shuffle, so a hot passage reaches a task once a piece.

Levels find whole runs by their fingerprints (96 bits); windows of open runs are grouped by 64-bit hashes and then
compared byte by byte, so that no two different strings are taken for equal there.

Null text counts as empty; texts shorter than LENGTH keep all their bytes; texts of any length are read whole. Rows that
repeat a doc_id with the same text are the same document and get the same result; different texts of one doc_id are
different documents, in the order of their hashes. A null doc_id counts as the least one. Ties between equal strings go
by document and place, so there are none left. Extra columns are ignored or kept as they are, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = common.U64
LENGTH = 100
SEED = 32
#: Suffixes in a batch of the family.
BATCH = 1 << 16
#: Texts of open runs that are on disk at one time: a share of the input's bytes, or as many bytes as never matter.
ROUND_SHARE, ROUND_BYTES = 0.5, 1 << 26
#: Stands in for a null doc_id, which counts as the least one.
NO_ID = -(1 << 63)

RUNS = "anchor int, run bigint, sides bigint, doc_id bigint, lo int, n int, repeated boolean"


class Rolling:
    """Hashes of any segments of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(common.BYTE_VALUE[buf] * common.powers(n), out=self.sums[1:])
        self.back = common.powers(n + 1, inverse=True)

    def segment(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.back[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored_runs(buf: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of every run: document index, first window (position in buf), number of windows, anchor and run fingerprints, and
    those of its sides()."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    sizes = np.diff(offsets)
    if len(buf) < length or sizes.max(initial=0) < length:
        return none
    rolling = Rolling(buf)
    seeds = common.mix(rolling.windows(seed))
    packed = (seeds >> U64(32) << U64(32)) | np.arange(len(seeds), dtype=np.uint64)
    anchor = (sliding_min(packed, length - seed + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(buf) + 1, np.int32)
    long = sizes >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.subtract.at(ok, offsets[1:][long] - length + 1, 1)
    at = np.flatnonzero(np.cumsum(ok[:-1]))
    mine = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, place = at[first], mine[first]
    n = np.diff(np.append(first, len(at)))
    doc = np.searchsorted(offsets, lo, side="right") - 1
    shape = ((place - lo) * 4096 + n).astype(np.uint64)
    run = common.mix(rolling.segment(lo, lo + n - 1 + length) ^ common.mix(shape + U64(1)))
    return doc, lo, n, seeds[place], run, sides(rolling, lo, n, place, length, seed)


def sides(rolling: Rolling, lo: np.ndarray, n: np.ndarray, place: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Two hashes of 32 bits a run: of the anchor with the ``left`` bytes before it, and with the ``right`` bytes behind it.

    A window with ``left`` bytes or more before its anchor holds the first of these strings whole, any other the second.
    Runs of one anchor that share a window thus agree in one of both. 0: no window of the run holds that string.
    """
    left = (length - seed + 1) // 2
    right = length - seed - left + 1
    out = np.zeros((2, len(lo)), np.uint64)
    for side, has, start, end in ((0, place - lo >= left, place - left, place + seed), (1, place - (lo + n - 1) < left, place, place + seed + right)):
        out[side, has] = common.mix(rolling.segment(start[has], end[has])) >> U64(32) | U64(1)
    return out[0] << U64(32) | out[1]


def shared_sides(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which of these different runs agree with another one in the anchor and a side."""
    out, anchor = np.zeros(len(anchor), bool), anchor.view(np.uint32).astype(np.uint64) << U64(32)
    for side in (sides.view(np.uint64) >> U64(32), sides.view(np.uint64) & U64(0xFFFFFFFF)):
        rows = np.flatnonzero(side)
        key = anchor[rows] | side[rows]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out[rows[order[1:][same]]] = out[rows[order[:-1][same]]] = True
    return out


def first_and_later(key: np.ndarray, doc_id: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of each key's first occurrence by (doc_id, lo), and of those truly later than it."""
    order = np.lexsort((lo, doc_id, key))
    k, d, p = key[order], doc_id[order], lo[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    later = (d != d[lead]) | (p != p[lead])
    first, after = np.zeros(len(k), bool), np.zeros(len(k), bool)
    first[order], after[order] = head, later
    return first, after


def merged(doc: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching intervals [lo, end) per document."""
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], end[order]
    if not len(doc):
        return doc, lo, end
    change = np.ones(len(doc), bool)
    change[1:] = doc[1:] != doc[:-1]
    part = np.cumsum(change) - 1
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + part * wide)
    new = np.ones(len(doc), bool)
    new[1:] = lo[1:] + part[1:] * wide > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[last] - part[last] * wide


class SuffixFamily:
    """Sorted suffix arrays of geometric sizes; every entry is the first occurrence of its run."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def known(self, run: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Which entries of a sorted array some level holds."""
        found = np.zeros(len(run), bool)
        for runs, anchors, _ in self.levels:
            at = np.minimum(np.searchsorted(runs, run), len(runs) - 1)
            found |= (runs[at] == run) & (anchors[at] == anchor)
        return found

    def add(self, run: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Take in a batch in document order; the mask of entries whose run occurred before."""
        order = np.lexsort((row, run))
        run, anchor, row = run[order], anchor[order], row[order]
        again = np.zeros(len(run), bool)
        again[1:] = (run[1:] == run[:-1]) & (anchor[1:] == anchor[:-1])
        again |= self.known(run, anchor)
        new = ~again
        if new.any():
            self.levels.append((run[new], anchor[new], row[new]))
            while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
                b, a = self.levels.pop(), self.levels.pop()
                both = [np.concatenate(x) for x in zip(a, b, strict=True)]
                by = np.argsort(both[0], kind="stable")
                self.levels.append(tuple(x[by] for x in both))
        out = np.zeros(len(run), bool)
        out[order] = again
        return out

    def rows(self) -> np.ndarray:
        return np.concatenate([x[2] for x in self.levels]) if self.levels else np.zeros(0, np.int64)


def map_runs(length: int, seed: int):
    """Runs of each piece; those that repeat within the piece come out as finished intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUNS.split(", ")]
        for piece in common.pieces(batches):
            buf, offsets = common.text_buffer(piece.column("text"))
            doc, lo, n, anchor, prints, side = anchored_runs(buf, offsets, length, seed)
            ids = piece.column("doc_id").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            lo = lo - offsets[doc]
            first, later = first_and_later(prints, ids, lo)
            d, a, e = merged(ids[later], lo[later], lo[later] + n[later])
            done = len(d)
            spread = common.mix(d.astype(np.uint64) * U64(3) + a.astype(np.uint64))
            columns = [
                (np.concatenate((anchor[first], spread)) >> U64(32)).astype(np.uint32).view(np.int32),
                np.concatenate((prints[first], np.zeros(done, np.uint64))).view(np.int64),
                np.concatenate((side[first], np.zeros(done, np.uint64))).view(np.int64),
                np.concatenate((ids[first], d)),
                np.concatenate((lo[first], a)).astype(np.int32),
                np.concatenate((n[first], e - a)).astype(np.int32),
                np.concatenate((np.zeros(int(first.sum()), bool), np.ones(done, bool))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def scan_family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of the anchors: repeated runs, and open runs (first ones that may share a window with others)."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches if b.num_rows]
    if not parts:
        return
    anchor, prints, side, doc, lo, n, done = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    out = [(doc[done], lo[done], n[done], np.ones(int(done.sum()), bool), anchor[done])]
    anchor, prints, side, doc, lo, n = (x[~done] for x in (anchor, prints, side, doc, lo, n))
    order = np.lexsort((lo, doc))
    anchor, prints, side, doc, lo, n = (x[order] for x in (anchor, prints, side, doc, lo, n))
    same = np.zeros(len(doc), bool)  # a repeated row's runs are the same occurrence, not a later one
    same[1:] = (doc[1:] == doc[:-1]) & (lo[1:] == lo[:-1])
    anchor, prints, side, doc, lo, n = (x[~same] for x in (anchor, prints, side, doc, lo, n))
    family, again = SuffixFamily(), np.zeros(len(doc), bool)
    rows = np.arange(len(doc))
    for at in range(0, len(doc), BATCH):
        cut = slice(at, at + BATCH)
        again[cut] = family.add(prints[cut], anchor[cut], rows[cut])
    out.append((doc[again], lo[again], n[again], np.ones(int(again.sum()), bool), anchor[again]))
    kept = family.rows()
    kept = kept[shared_sides(anchor[kept], side[kept])]
    out.append((doc[kept], lo[kept], n[kept], np.zeros(len(kept), bool), anchor[kept]))
    for d, a, size, repeated, key in out:
        for at in range(0, len(d), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (d, a, size, repeated, key)], names=["doc_id", "lo", "n", "repeated", "anchor"])


def _list_arrays(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Row number and the fields of each struct in a list column (null lists are empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
    take = [flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    return np.repeat(np.arange(len(column)), sizes), *take


CONTEXTS = "anchor int, doc_id bigint, lo int, n int, context binary"


def map_contexts(length: int, names: Columns):
    """The text that each open run's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            buf, offsets = common.text_buffer(piece.column("text"))
            row, lo, n, anchor = _list_arrays(piece.column(names.runs), ("lo", "n", "anchor"))
            if not len(row):
                continue
            raw, base = buf.tobytes(), (lo + offsets[row]).tolist()
            texts = [raw[a : a + k] for a, k in zip(base, (n - 1 + length).tolist(), strict=True)]
            ids = piece.column(names.key).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            columns = [anchor.astype(np.int32), ids, lo.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(texts, pa.binary())], names=[x.split()[0] for x in CONTEXTS.split(", ")])

    return run


def equal_strings(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of ``length`` bytes at a and b are equal, by eight bytes at a time."""
    same = np.ones(len(a), bool)
    if length < 8:
        return np.all([buf[a + k] == buf[b + k] for k in range(length)], axis=0)
    raw = np.concatenate((buf, np.zeros(8, np.uint8)))
    words = np.ndarray((len(buf) + 1,), "<u8", raw.data, strides=(1,))
    for at in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = words[a[left] + at] == words[b[left] + at]
    return same


def equal_runs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """equal_strings() for many strings that follow each other byte by byte on both sides: of such a run the first is
    compared whole and of the others the last byte; where that finds a difference all of the run are compared whole."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    start = np.ones(len(x), bool)
    start[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    first = np.flatnonzero(start)
    same = buf[x + length - 1] == buf[y + length - 1]
    same[first] = equal_strings(buf, x[first], y[first], length)
    sure = np.repeat(np.logical_and.reduceat(same, first), np.diff(np.append(first, len(x)))) if len(x) else same
    rest = np.flatnonzero(~sure)
    same[rest] = equal_strings(buf, x[rest], y[rest], length)
    out = np.zeros(len(a), bool)
    out[order] = same
    return out


def later_strings(buf: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which strings at ``at`` occur earlier (by doc, place) among them. key: their hashes; strings of one key that differ
    are told apart by another round among themselves."""
    out, rows = np.zeros(len(at), bool), np.arange(len(at))
    while len(rows):
        order = rows[np.lexsort((place[rows], doc[rows], key[rows]))]
        k = key[order]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        same = equal_runs(buf, at[order], at[lead], length)
        out[order[same]] = ((doc[order] != doc[lead]) | (place[order] != place[lead]))[same]
        rows = order[~same]
    return out


def settle_windows(length: int):
    """Intervals of windows in open runs that an earlier document or place holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, starts, keys, docs, places, size = [], [], [], [], [], 0
        for batch in batches:
            for piece in common.pieces(iter([batch]), "context"):
                buf, offsets = common.text_buffer(piece.column("context"))
                doc, lo, n = (piece.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "lo", "n"))
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(offsets[:-1], n) + step
                keys.append(Rolling(buf).segment(at, at + length))
                docs.append(np.repeat(doc, n))
                places.append((np.repeat(lo, n) + step).astype(np.int32))
                starts.append(at + size)
                texts.append(buf)
                size += len(buf)
        if not keys:
            return
        text, at, key, doc, place = (np.concatenate(x) for x in (texts, starts, keys, docs, places))
        later = later_strings(text, at, key, doc, place, length)
        d, a, e = merged(doc[later], place[later].astype(np.int64), place[later].astype(np.int64) + 1)
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array((e - a).astype(np.int32))], names=["doc_id", "lo", "n"])

    return run


class Columns:
    """Names for the columns that come and go beside those of docs."""

    def __init__(self, docs: DataFrame):
        self.key, self.id, self.runs, self.spans = (common.fresh(docs, x) for x in ("_ks_key", "_ks_id", "_ks_runs", "_ks_spans"))


def repeated_windows(docs: DataFrame, names: Columns, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, spans array<struct<lo, n>>): per document the runs of starts whose strings occur earlier.

    docs comes from keyed(). Its rows are dealt by key for the open runs just as a caller that joins the result deals
    them, so that both use one exchange of the texts.
    """
    n_parts = common.parts(docs.sparkSession)
    runs = docs.select(F.col(names.key).alias("doc_id"), "text").mapInArrow(map_runs(length, seed), RUNS).repartition(n_parts, "anchor")
    scanned = common.materialise(runs.mapInArrow(scan_family, "doc_id bigint, lo int, n int, repeated boolean, anchor int"), "suffix-runs")
    opened, rounds = scanned.where("not repeated"), 1
    size = opened.agg(F.sum(F.col("n") + F.lit(length - 1))).first()[0] or 0
    if size > ROUND_BYTES:
        whole = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        rounds = -(-size // max(ROUND_BYTES, int(ROUND_SHARE * whole)))
    found = scanned.where("repeated").select("doc_id", "lo", "n")
    for k in range(rounds):
        mine = opened.where(F.pmod(F.xxhash64("anchor"), F.lit(rounds)) == k) if rounds > 1 else opened
        edges = open_edges(docs, mine, names, length)
        found = found.unionByName(common.materialise(edges, "suffix-edges") if rounds > 1 else edges)
    return found.groupBy(F.col("doc_id").alias(names.id)).agg(F.collect_list(F.struct("lo", "n")).alias(names.spans))


def open_edges(docs: DataFrame, opened: DataFrame, names: Columns, length: int) -> DataFrame:
    """(doc_id, lo, n): the intervals of repeated windows in open runs; those of one anchor must be in opened together."""
    opened = opened.groupBy(F.col("doc_id").alias(names.id)).agg(F.collect_list(F.struct("lo", "n", "anchor")).alias(names.runs))
    contexts = docs.join(opened, docs[names.key] == opened[names.id]).mapInArrow(map_contexts(length, names), CONTEXTS)
    return contexts.repartition(common.parts(docs.sparkSession), "anchor").mapInArrow(settle_windows(length), "doc_id bigint, lo int, n int")


def keyed(docs: DataFrame, names: Columns) -> DataFrame:
    """docs with a key that is never null, in the order of doc_id, and of the texts' hashes where a doc_id has several.

    Usually the key is the doc_id itself: no join needs a filter on it, which would make its exchange another one. Only
    where different texts share a doc_id the pairs of both are numbered in order.
    """
    text, doc_id = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    texts = docs.select(doc_id.alias("id"), text.alias("hash")).groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    if texts.where("a <> b").isEmpty():
        return docs.withColumn(names.key, doc_id)
    pairs = docs.select(doc_id.alias("id"), text.alias("hash")).distinct()
    pairs = pairs.repartitionByRange(common.parts(docs.sparkSession), "id", "hash").sortWithinPartitions("id", "hash")
    pairs = common.materialise(pairs.withColumn(names.key, F.monotonically_increasing_id()), "document-order")
    found = docs.join(pairs, (doc_id == pairs["id"]) & (text == pairs["hash"]))
    return found.select(*[docs[c] for c in docs.columns], pairs[names.key])


def with_spans(docs: DataFrame, names: Columns, length: int, seed: int) -> DataFrame:
    docs = keyed(docs, names)
    spans = repeated_windows(docs, names, length, seed)
    return docs.join(spans, docs[names.key] == spans[names.id], "left")


def _removed(piece: pa.RecordBatch, names: Columns, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes and offsets; row, start and end (in the row) of the maximal removed spans."""
    buf, offsets = common.text_buffer(piece.column("text"))
    row, lo, n = _list_arrays(piece.column(names.spans), ("lo", "n"))
    return buf, offsets, *merged(row, lo, lo + n - 1 + length)


def digests(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    docs = docs.select("doc_id", "text")
    names = Columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            buf, offsets, row, start, end = _removed(piece, names, length)
            size, count = piece.num_rows, np.bincount(row, minlength=piece.num_rows)
            gone = np.bincount(row, weights=end - start, minlength=size).astype(np.int64)
            cuts = np.searchsorted(row, np.arange(size + 1))
            raw, shas = buf.tobytes(), []
            for i in range(size):
                text, digest, at = memoryview(raw)[offsets[i] : offsets[i + 1]], hashlib.sha256(), 0
                for j in range(cuts[i], cuts[i + 1]):
                    digest.update(text[at : start[j]])
                    at = end[j]
                digest.update(text[at:])
                shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(gone), pa.array(count.astype(np.int64)), pa.array(shas)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return with_spans(docs, names, length, seed).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """docs with repeated strings cut from text at whole characters, n_chars (if there) counted anew; rows left without
    a word go."""
    own, names = docs.columns, Columns(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            buf, offsets, row, start, end = _removed(piece, names, length)
            inner = np.append((buf & 0xC0) == 0x80, False)
            cuts, raw, texts = np.searchsorted(row, np.arange(piece.num_rows + 1)), buf.tobytes(), []
            nulls = piece.column("text").is_null().to_pylist()
            for i in range(piece.num_rows):
                base, size, kept, at = offsets[i], offsets[i + 1] - offsets[i], [], 0
                for j in range(cuts[i], cuts[i + 1]):
                    a, b = start[j], end[j]
                    while a < b and inner[base + a]:
                        a += 1
                    while b > a and b < size and inner[base + b]:
                        b -= 1
                    kept.append(raw[base + at : base + a])
                    at = b
                kept.append(raw[base + at : base + size])
                texts.append(None if nulls[i] else b"".join(kept).decode())
            columns = [piece.column(c) for c in own]
            columns[own.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in own:
                kind = piece.schema.field("n_chars").type
                columns[own.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts]).cast(kind)
            # What was empty before stays; what removal has emptied goes.
            keep = pa.array([bool(t and t.strip()) or cuts[i] == cuts[i + 1] for i, t in enumerate(texts)])
            yield pa.RecordBatch.from_arrays(columns, names=own).filter(keep)

    return with_spans(docs, names, length, seed).mapInArrow(run, docs.schema)
