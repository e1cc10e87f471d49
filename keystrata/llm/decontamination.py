"""Benchmark decontamination by template canonicalisation.

Text becomes a template: numbers, units and names (capitalised words inside a sentence, several in a row being one)
turn into typed placeholders, other words are lower-cased without the punctuation around them. A capitalised word that
begins a sentence may be either, so windows over such words are taken twice: with all of them literal and with all of
them names. Windows of template tokens are joined by hash with the benchmark's. A window with too few literals to tell
it from others is taken verbatim, and an item shorter than a window is one window as a whole; one of under MIN_SHORT
tokens only counts where it is the whole text. Matches of one text and item at one shift form a placement; its runs of
windows count if they span enough tokens and their slots are consistent: one item value always stands against one
document value. That catches a question whose numbers and names were exchanged, and lets go text that merely has the
same shape.

Runs are judged as windows that follow each other, that overlap, and that leave at most BRIDGE tokens between them; only
tokens inside matching windows are counted. Where slots contradict each other, the longest part without contradiction
counts if it has MIN_PART tokens: more than a run needs, as the contradiction speaks for a mere likeness.

Documents only send windows that pass a bitmap of the benchmark's hashes, sized by it within limits; the join itself is
exact, and Spark deals or broadcasts the benchmark's side by its size. Null or empty texts and items have no windows; a
repeated item or document row counts like one; different texts of one id, null ids included, are judged apart, and a
row is flagged by its own text. Texts of any length are read whole. Of equal matches (ties) all are reported; item_ids
are in ascending order. Extra columns are ignored, whatever their names; empty tables flag nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sentencepiece_codec import UnitCache

WINDOW = 8
#: Literal tokens a window needs at least, and template tokens that a run must span (or the whole item, if shorter).
MIN_LITERALS = 4
MIN_RUN = 13
#: Unmatched tokens that a run may span in one place, and tokens of a consistent part of a run that contradicts itself.
BRIDGE = 2
MIN_PART = 26
#: Shorter items must be the whole text.
MIN_SHORT = 4
#: The bitmap has about 64 bits a window, between these limits (128 KiB and 16 MiB); the join is exact without it.
BITMAP_BITS = (20, 27)
CACHE_WORDS = 400_000

# Unit words.
UNITS = set(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers centimeter centimeters mg g kg lb lbs oz ton tons gram grams "
    "kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent mph kph watt watts volt volts degree degrees".split()
)
NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(%|[a-zA-Z]{1,2})?")
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”‘’¿¡…–—"
PUNCTUATION = EDGES.replace("$", "").replace("%", "").replace("+", "").replace("-", "")
NUM, UNIT, CAPITAL, ENDS = 1, 2, 4, 8
VERBATIM = np.uint64(0x5EED5EED5EED5EED)
NAME_HASH, NUM_HASH, UNIT_HASH = (np.uint64(xxhash.xxh64_intdigest(x) >> 4 << 4) for x in ("<name>", "<number>", "<unit>"))


def word_code(word: str) -> int:
    """Hash of the literal token with flags in the low four bits; 0 for punctuation alone."""
    bare = word.strip(EDGES)
    if not bare:
        return 0
    flags = ENDS if bare != word and word.rstrip("\"')]”’»")[-1:] in (".", "!", "?", ":") else 0
    # Letters alone make no number.
    if not bare.isalpha() and NUMBER.fullmatch(word.strip(PUNCTUATION)):
        return int(NUM_HASH) | NUM | flags
    low = bare.lower()
    if low in UNITS:
        return int(UNIT_HASH) | UNIT | flags
    if bare[0].isupper() and (len(bare) == 1 or not bare[1:].isupper()):
        flags |= CAPITAL
    return xxhash.xxh64_intdigest(low) >> 4 << 4 | flags


def surface_code(word: str) -> int:
    """Hash of the word itself, whatever it stands for."""
    return xxhash.xxh64_intdigest(word.strip(PUNCTUATION).lower())


class Template:
    """Tokens of one text: hashes and slot marks, with sentence starts literal (0) or names (1), and their words."""

    __slots__ = ("tokens", "slots", "first", "last", "words")

    def __init__(self, words: list[str], codes: np.ndarray):
        at = np.flatnonzero(codes)
        codes = codes[at]
        flags = codes & np.uint64(15)
        starts = np.ones(len(codes), bool)
        starts[1:] = (flags[:-1] & np.uint64(ENDS)) != 0
        capital, typed = (flags & np.uint64(CAPITAL)) != 0, (flags & np.uint64(NUM | UNIT)) != 0
        inner, bare = capital & ~starts, codes ^ flags
        new = np.ones(len(codes), bool)  # a name of several words is one token
        new[1:] = ~(inner[1:] & inner[:-1])
        take = np.flatnonzero(new)
        self.words, self.first = words, at[take]
        self.last = at[np.append(take[1:], len(at)) - 1] if len(take) else at[take]
        self.tokens = [np.where(x, NAME_HASH, bare)[take] for x in (inner, capital)]
        self.slots = [x[take] for x in (inner | typed, capital | typed)]

    def __len__(self) -> int:
        return len(self.first)

    def values(self, place: int, length: int, named: int) -> list[str]:
        """The window's values, an empty string for each literal token; a verbatim window (named -1) has none."""
        slot = self.slots[max(named, 0)]
        return [" ".join(self.words[self.first[i] : self.last[i] + 1]).strip(PUNCTUATION) if named >= 0 and slot[i] else "" for i in range(place, place + length)]


class Canonicaliser:
    def __init__(self, window: int = WINDOW, min_literals: int = MIN_LITERALS):
        self.window, self.min_literals = window, min_literals
        self.codes, self.surfaces = UnitCache(word_code, CACHE_WORDS), UnitCache(surface_code, CACHE_WORDS)

    def template(self, words: list[str]) -> Template:
        return Template(words, np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words)))

    def _verbatim(self, parts: list[Template], first: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Keys of the windows at ``at`` by their words alone."""
        covered = np.zeros(int(first[-1]) + 1, np.int32)
        np.add.at(covered, at, 1)
        np.subtract.at(covered, at + length, 1)
        tokens = np.zeros(int(first[-1]), np.uint64)
        need = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        owner = np.searchsorted(first, need, side="right") - 1
        for i, k in zip(need.tolist(), owner.tolist(), strict=True):
            part, j = parts[k], i - int(first[k])
            for w in part.words[part.first[j] : part.last[j] + 1]:
                tokens[i] = common.mix(tokens[i : i + 1] ^ np.uint64(self.surfaces[w]))[0]
        keys, _ = common.shingle_hash(tokens, np.zeros(len(tokens), np.int64), length)
        return keys[at] ^ VERBATIM

    def windows(self, texts: list[str], short: tuple[int, ...] = (), whole: bool = False) -> tuple[np.ndarray, ...]:
        """Of all windows: hash, text index, token place, tokens, and 1 where sentence starts are names (only windows
        that have some), -1 where it is verbatim; and the texts' templates. short: lengths of short windows, which
        must be whole texts if ``whole`` or under MIN_SHORT."""
        parts = [self.template(t.split()) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        doc, first = np.repeat(np.arange(len(texts)), sizes), np.concatenate(([0], np.cumsum(sizes)))
        tokens, slots = ([np.concatenate([getattr(p, c)[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1)] for c in ("tokens", "slots"))
        found = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)]
        changed = np.concatenate(([0], np.cumsum(tokens[0] != tokens[1])))
        for length in (self.window, *short):
            short_of = np.zeros(max(0, len(doc) - length + 1), bool)  # windows with too few literals in either way
            for named in (0, 1):
                keys, at = common.shingle_hash(tokens[named].astype(np.uint64), doc, length)
                if not len(at):
                    continue
                literals = np.concatenate(([0], np.cumsum(~slots[named].astype(bool))))
                use = np.ones(len(at), bool)
                if length < self.window and (whole or length < MIN_SHORT):
                    use = sizes[doc[at]] == length
                if named:
                    use &= changed[at + length] > changed[at]
                rich = literals[at + length] - literals[at] >= self.min_literals
                short_of[at[use & ~rich]] = True
                use &= rich
                found.append((keys[use], at[use], np.full(int(use.sum()), length), np.full(int(use.sum()), named)))
            poor = np.flatnonzero(short_of)
            if len(poor):
                found.append((self._verbatim(parts, first, poor, length), poor, np.full(len(poor), length), np.full(len(poor), -1)))
        keys, at, length, named = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(at):
            return keys, at, at, length, named, parts
        return keys, doc[at], at - first[doc[at]], length, named, parts


def _stretches(places: list[int], step: int) -> Iterator[list[int]]:
    """places, ascending, cut where the next one is more than step away."""
    begin = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] - places[i - 1] > step:
            yield places[begin:i]
            begin = i


def _longest(values: list[tuple[str, str] | None]) -> int:
    """Length of the longest part in which no item value stands against two document values; None is a literal."""
    best = begin = 0
    last: dict[str, tuple[str, int]] = {}  # the value's document value, and its last place with it
    other: dict[str, int] = {}  # the value's last place with another document value than that
    for i, pair in enumerate(values):
        if pair is not None:
            have = last.get(pair[0])
            if have is not None and have[0] != pair[1]:
                other[pair[0]] = have[1]
            last[pair[0]] = (pair[1], i)
            begin = max(begin, other.get(pair[0], -1) + 1)
        best = max(best, i + 1 - begin)
    return best


def placement_tokens(found: list[tuple[int, int, list[str], list[str]]], size: int, window: int = WINDOW, min_run: int = MIN_RUN) -> int:
    """Tokens of the placement's longest run that counts, 0 if none does. found: item place, how many of the two sides
    took sentence starts for names, item values, document values; size: the item's tokens."""
    at: dict[int, tuple] = {}
    for row in sorted(found, key=lambda r: r[:2]):
        at.setdefault(row[0], row)
    places, least, best = sorted(at), min(min_run, size), 0
    plain = [p for p in places if not at[p][1]]
    for chosen, step in ((plain, 1), (places, 1), (places, window), (places, window + BRIDGE)):
        for run in _stretches(chosen, step):
            values: dict[int, tuple[str, str] | None] = {}
            for p in run:
                for i, pair in enumerate(zip(at[p][2], at[p][3], strict=True), p):
                    # A token that is equal as a literal in one window needs no slot in another.
                    values[i] = None if not pair[0] or values.get(i, pair) is None else pair
            n = len(values)
            if n < least or n <= best:
                continue
            part = _longest([values[i] for i in sorted(values)])
            if part == n or part >= MIN_PART:
                best = max(best, part)
    return best


def _text_hash(df: DataFrame):
    return F.xxhash64(F.coalesce(df["text"], F.lit("")))


def _windows(df: DataFrame, key: str, bitmap: np.ndarray | None, short: tuple[int, ...], window: int, min_literals: int) -> DataFrame:
    """(key, t, n_tokens, h, pos, named, slots) of every window, or of those whose hash is in the bitmap; t is the text's
    hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonicaliser(window, min_literals)
        if bitmap is not None:
            words, shift = bitmap.view(np.uint64), np.uint64(64 - int(len(bitmap) * 64).bit_length() + 1)
        for piece in common.pieces(batches):
            ids = piece.column(key).cast(pa.int64()).to_pylist()
            texts = piece.column("t").to_pylist()
            keys, doc, place, length, named, parts = canon.windows([t or "" for t in piece.column("text").to_pylist()], short, bitmap is None)
            hit = np.arange(len(keys))
            if bitmap is not None:
                bit = keys >> shift
                hit = np.flatnonzero(words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            if len(hit):
                d, p, n, k = (x[hit].tolist() for x in (doc, place, length, named))
                slots = [parts[i].values(j, size, m) for i, j, size, m in zip(d, p, n, k, strict=True)]
                columns = [pa.array([x[i] for i in d], pa.int64()) for x in (ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([len(parts[i]) for i in d], pa.int64()), pa.array(keys[hit].view(np.int64)), pa.array(p, pa.int64()), pa.array(np.maximum(named[hit], 0), pa.int32()), pa.array(slots, pa.list_(pa.string()))],
                    names=[key, "t", "n_tokens", "h", "pos", "named", "slots"],
                )

    return df.select(key, "text", _text_hash(df).alias("t")).mapInArrow(run, f"{key} bigint, t bigint, n_tokens bigint, h bigint, pos bigint, named int, slots array<string>")


def _bitmap(items: DataFrame) -> np.ndarray:
    """The items' hashes by their leading bits, 64 to a word. Words are made in tasks; at most 2^21 reach the driver."""
    low, high = BITMAP_BITS
    bits = min(high, max(low, (64 * items.count()).bit_length()))
    places = items.select(F.shiftrightunsigned("h", 64 - bits).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask"))
    words = places.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_run: int = MIN_RUN, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(doc_id, t, item_id, tokens): texts (t is their hash) that hold a consistent run of an item, and its longest run's
    tokens."""
    items = _windows(benchmark, "item_id", None, tuple(range(1, window)), window, min_literals).dropDuplicates(["item_id", "t", "h", "pos", "named"])
    items = common.materialise(items, "templates")
    short = tuple(sorted(r.n for r in items.where(F.col("n_tokens") < window).select(F.col("n_tokens").cast("int").alias("n")).distinct().collect()))  # under the window's length
    seen = _windows(docs, "doc_id", _bitmap(items), short, window, min_literals)
    item = items.select("item_id", F.col("t").alias("item_t"), "h", F.col("n_tokens").alias("size"), F.col("pos").alias("item_pos"), F.col("named").alias("item_named"), F.col("slots").alias("item_slots"))
    met = seen.select("doc_id", "t", "h", "pos", "named", "slots").join(item, "h").withColumn("shift", F.col("pos") - F.col("item_pos"))
    met = met.withColumn("named", F.col("named") + F.col("item_named")).dropDuplicates(["doc_id", "t", "item_id", "item_t", "shift", "item_pos", "named"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = placement_tokens([(x["item_pos"], x["named"], x["item_slots"], x["slots"]) for x in r["found"]], r["size"], window, min_run)
                if n:
                    rows.append((r["doc_id"], r["t"], r["item_id"], n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "t", "item_id", "tokens"])

    # A placement has at most three rows for each of its item's windows.
    placed = met.groupBy("doc_id", "t", "item_id", "item_t", "shift", "size").agg(F.collect_list(F.struct("item_pos", "named", "item_slots", "slots")).alias("found"))
    # No run is longer than the stretch from the first window to the last.
    reach = F.array_max("found.item_pos") - F.array_min("found.item_pos") + window
    good = placed.where(reach >= F.least(F.lit(min_run), F.col("size"))).mapInArrow(judge, "doc_id bigint, t bigint, item_id bigint, tokens bigint")
    return good.groupBy("doc_id", "t", "item_id").agg(F.max("tokens").alias("tokens"))


def _same_text(docs: DataFrame, found: DataFrame):
    return docs["doc_id"].eqNullSafe(found["doc_id"]) & (_text_hash(docs) == found["t"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, contaminated, n_items, item_ids (ascending)."""
    found = leaks(docs, benchmark).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    docs = docs.select("doc_id", "text")
    items = F.coalesce(found["item_ids"], F.array().cast("array<bigint>"))
    n = F.size(items).cast("bigint")
    return docs.join(found, _same_text(docs, found), "left").select(docs["doc_id"], (n > 0).alias("contaminated"), n.alias("n_items"), items.alias("item_ids"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs without a leak; all columns kept."""
    found = leaks(docs, benchmark).select("doc_id", "t").distinct()
    return docs.join(found, _same_text(docs, found), "left_anti")
