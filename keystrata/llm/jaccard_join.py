"""Exact Jaccard self-join of word shingle sets by token-combination prefixes.

Tokens are 64-bit shingle hashes. Two sets that link share at least k tokens among their extended prefixes (prefix
length plus k - 1) in any common order of tokens. Exact copies are folded first. Then:

* prefixes by hash are counted; a token that few extended prefixes hold is rare and indexed singly;
* a document with k or more frequent tokens in that prefix may share frequent tokens only. Among such documents all
  tokens are counted and prefixes are taken again, the least frequent tokens first. Frequent tokens are dealt into
  classes and the pairs inside a class are the keys; the prefix is extended by one token a class, so that a linked
  partner shares two tokens of one class. Rare tokens there are keys by themselves;
* every key's group is compared with its least member only (a star, so rows stay linear in the group's size), pairs
  are first held to the number of tokens their prefix sketches must share, then verified on the whole sets;
* components of the links so far are found. A rare token's group, small by definition, still gives the pairs between
  its components. Where a combination's group holds several components, its members go to the home of the largest;
  those outside the home's component are held in blocks and all members of the home stream past them as differences
  from its least set, which give every overlap exactly; only links come out, never pairs.

No link between different texts is lost and nothing is capped.

Null and empty texts have an empty set and link with nothing; fewer words than the width make one token of the whole
sequence. A text of any length is read whole. Repeated rows fold like copies; a doc_id with several texts stands for
several documents, and so does each null doc_id. Ties have no say: orders end in the token itself. Extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: A token in more extended prefixes than this is frequent.
RARE_LIMIT = 24
#: Up to so many document ids (8 bytes each) may be broadcast to pick texts; beyond it texts are shuffled.
BROADCAST_IDS = 1_000_000
#: A block holds about so many members and so many of their tokens.
BLOCK_ROWS = 2000
BLOCK_TOKENS = 4_000_000
#: Members streamed past a block at once, and postings expanded at once.
STREAM_ROWS = 512
POSTINGS = 1 << 20

SIGNATURE = "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sketch array<bigint>"


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any partner."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + 1


def extension(n: int) -> int:
    """k: shared tokens that the extended prefix of a set of n guarantees. Grows with n."""
    return 1 + n // 32


def sketch_length(n: int, percent: int) -> int:
    return min(n, max(2 * prefix_length(n, percent) + 8, prefix_length(n, percent) + extension(n) - 1))


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n can link with a different one."""
    return 100 * n >= percent * (n + 1) or 100 * (n - 1) >= percent * n


def shingle_sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    buf, offsets = common.text_buffer(batch.column("text"))
    starts, ends, doc = common.word_spans(buf, offsets)
    words = common.segment_hash(buf, starts, ends, lower=True)
    keys, at = common.shingle_hash(words, doc, width)
    cuts = np.searchsorted(doc[at], np.arange(batch.num_rows + 1))
    word_cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    sets = []
    for i in range(batch.num_rows):
        own = keys[cuts[i] : cuts[i + 1]]
        if not len(own) and word_cuts[i] < word_cuts[i + 1]:
            few = words[word_cuts[i] : word_cuts[i + 1]]
            own = common.shingle_hash(few, np.zeros(len(few), np.int64), len(few))[0] ^ common.U64(len(few))
        sets.append(np.unique(own))
    return sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))), pa.int32()), pa.array(flat))


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """SIGNATURE per document: set size, the set's 128-bit fingerprint, and its least tokens by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            sets = shingle_sets(piece, width)
            prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            sketches = [s[: sketch_length(len(s), percent)] if can_link(len(s), percent) else s[:0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _lists(sketches)],
                names=["doc_id", "n", "fp1", "fp2", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def schemes(n: int, percent: int) -> list[tuple[int, int]]:
    """(number, classes) of the two schemes under which a set of n is indexed: its own size band's and the next one's.

    Partners lie in the same or a neighbouring band, so they have a scheme in common that belongs to the larger one's
    band. A scheme deals tokens into its classes; extended prefixes longer by the number of classes share one token
    more than there are classes, hence two in one class. Without classes (small sets) single tokens are the keys.
    """
    i, low, found = 0, 1, []
    while len(found) < 2:
        high = low * 100 // percent + 1
        if n < high:
            found.append((i, min(prefix_length(high - 1, percent) // 4, least_overlap(low, percent) - 1)))
        i, low = i + 1, high
    return found


def combination_keys(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, rare_limit: int = RARE_LIMIT) -> np.ndarray:
    """Keys of a set of n: its rare tokens singly, of its frequent ones the pairs in one class, or they too singly
    where a scheme has no classes. tokens: those that other sets hold too, in the order of prefixes, with their
    frequencies df; the set's own tokens come before all of them."""
    own, found = n - len(tokens), []
    longest = prefix_length(n, percent) + max(c for _, c in schemes(n, percent)) - own
    found.append(common.mix(tokens[: max(0, longest)][df[: max(0, longest)] <= rare_limit]))
    for number, c in schemes(n, percent):
        length = max(0, prefix_length(n, percent) + c - own)
        often = tokens[:length][df[:length] > rare_limit]
        seed = common.mix(np.array([number + 1], np.uint64))[0]
        if not c:
            found.append(common.mix(often ^ seed))
            continue
        cls = (common.mix(often ^ seed) % np.uint64(c)).astype(np.int64)
        order = np.lexsort((often, cls))
        often, cls = common.mix(often[order] ^ seed), cls[order]
        for step in range(1, len(often)):  # pairs within a class: places that are step apart
            same = cls[step:] == cls[:-step]
            if not same.any():
                break
            found.append(common.mix(often[:-step][same] * np.uint64(3) + often[step:][same]))
    return np.concatenate(found)


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (column doc_id, distinct)."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ids; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), _lists(shingle_sets(piece, width))], names=["doc_id", "tokens"])

    return pick(docs.select("doc_id", "text"), ids).mapInArrow(run, "doc_id bigint, tokens array<bigint>")


def combinations(sets: DataFrame, percent: int, rare_limit: int) -> DataFrame:
    """(key, rep, n): one row per rare token or token combination of each set's extended prefix.

    Prefixes follow the tokens' frequencies among these sets, the least first, so a set reaches its frequent tokens
    only if nearly all of its tokens are shared ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (rep, n, shared) in enumerate(zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("shared"), strict=True)):
                tokens, df = (shared.values.field(c).to_numpy(zero_copy_only=False) for c in ("token", "df"))
                keys = np.unique(combination_keys(tokens.view(np.uint64), df, n, percent, rare_limit))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), rep), pa.int64()), pa.array(np.full(len(keys), n), pa.int64())], names=["key", "rep", "n"])

    tokens = sets.select("doc_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # What a set may hold of its own and still reach a shared token: its prefix and, at most, the next band's classes.
    ratio = 100 / percent
    classes = F.lit(ratio * ratio * (1 - 1 / ratio) / 4) * F.col("n") + F.lit(((ratio + 2) * (1 - 1 / ratio) + 1) / 4)
    reach = F.col("n") - F.size("shared") < F.col("n") - _overlap(F.col("n"), percent) + 1 + classes
    ordered = tokens.join(often, "token").groupBy(F.col("doc_id").alias("rep"), "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    return ordered.where(reach).mapInArrow(run, "key bigint, rep bigint, n bigint")


def _overlap(n: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * n / F.lit(100)).cast("bigint")


def _extension(n: Column) -> Column:
    return F.lit(1) + F.floor(n / F.lit(32)).cast("bigint")


def _sizes_fit(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def grouped(rows: DataFrame) -> DataFrame:
    """rows (key, rep, n) of keys with two members or more, with the key's size and its centre, the least member.

    Sizes and centres are aggregated before the shuffle; the join back splits hot keys (AQE), a window would not.
    """
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("rep", "n")).alias("c"))
    stats = stats.where("df > 1").select("key", "df", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"))
    return rows.join(stats, "key")


def sketch_filter(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches share what linked sets must share."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # A sketch of length L guarantees L - prefix + 1 shared tokens; the pair is held to the lesser guarantee.
    sure = [F.size(f"{x}s") - (F.col(f"{x}n") - _overlap(F.col(f"{x}n"), percent)) for x in "ab"]
    shared = F.size(F.array_intersect("as", "bs"))
    return both.where(_sizes_fit(F.col("an"), F.col("bn"), percent) & (shared >= F.least(*sure))).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) on the whole sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"{x}t"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("at", "bt")).cast("bigint")
    union = F.size("at") + F.size("bt") - shared
    return both.select("a", "b", shared.alias("i"), union.alias("u")).select("a", "b", (F.col("i") * 100 >= F.col("u") * percent).alias("linked"))


def few_pairs(groups: DataFrame, labels: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a rare token's group, of at most the rare limit, that lie in different components, differ little
    in size and were not compared yet."""
    rows = groups.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    l, r = (rows.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("rep", "n", "component")]) for x in "lr")
    met = l.join(r, "key").where((F.col("l_rep") < F.col("r_rep")) & (F.col("l_component") != F.col("r_component")) & _sizes_fit(F.col("l_n"), F.col("r_n"), percent))
    return met.select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b")).distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")


def open_members(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(home, rep, n, component): who must still be compared, and with whom.

    A group that holds several components has one of them as its home, the largest over all documents, so that the
    groups of one cluster of near copies share a home and a member has one row there however many groups it is in.
    Members outside their home's component are the open ones: any pair that is still open has one of them.
    """
    sized = labels.join(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    rows = groups.select("key", "rep", "n").join(sized.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("key", "rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(F.struct("size", "component")).alias("main"))
    mixed = mixed.where("c1 <> c2").select("key", F.col("main.component").alias("home"))
    return rows.join(mixed, "key").select("home", "rep", "n", "component").distinct()


def block_links(percent: int):
    """Reader of rows sorted by (home, block, role): a block's outside members (role 0), then all members (role 1).

    With a, b tokens of two sets in the home's least set of m, and D their differences from it, the sets share
    a + b - m + |D1 & D2| tokens. The block stays in memory, the members stream past it.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flat(batch):
        column = batch.column("d")
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        return take("rep"), take("n"), take("component"), take("m"), values, offsets - offsets[0]

    def index(parts):
        rep, n, comp, m = (np.concatenate([p[i] for p in parts]) for i in range(4))
        sizes = np.concatenate([np.diff(p[5]) for p in parts])
        tokens = np.concatenate([p[4] for p in parts])
        owner = np.repeat(np.arange(len(rep)), sizes)
        order = np.argsort(tokens, kind="stable")
        words, first = np.unique(tokens[order], return_index=True)
        return rep, n, comp, (n + m - sizes) // 2, words, np.append(first, len(tokens)), owner[order]

    def compare(block, rows, seen):
        rep, n, comp, own, words, first, owner = block
        y_rep, y_n, y_comp, m, values, offsets = rows
        shared = np.zeros((len(y_rep), len(rep)), np.int64)
        if len(words) and len(values):
            at = np.minimum(np.searchsorted(words, values), len(words) - 1)
            hit = np.flatnonzero(words[at] == values)
            row = np.repeat(np.arange(len(y_rep)), np.diff(offsets))[hit]
            low, size = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
            ends = np.cumsum(size)
            steps = np.searchsorted(ends, np.arange(0, int(size.sum()), POSTINGS), side="right")
            for p, q in itertools.pairwise([*np.unique(steps).tolist(), len(size)]):
                part, begin = size[p:q], int(row[p])
                flat_at = np.arange(int(part.sum())) + np.repeat(low[p:q] - np.cumsum(part) + part, part)
                place = np.repeat(row[p:q] - begin, part) * len(rep) + owner[flat_at]
                lines = int(row[q - 1]) - begin + 1
                shared[begin : begin + lines] += np.bincount(place, minlength=lines * len(rep)).reshape(lines, len(rep))
        y_own = (y_n + m - np.diff(offsets)) // 2
        both = shared + own[None, :] + (y_own - m)[:, None]
        linked = (both * 100 >= percent * (n[None, :] + y_n[:, None] - both)) & (comp[None, :] != y_comp[:, None])
        for y, u in zip(*np.nonzero(linked), strict=True):
            key = (int(u), int(y_comp[y]))
            if key not in seen:
                seen.add(key)
                yield int(min(rep[u], y_rep[y])), int(max(rep[u], y_rep[y]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, seen = None, [], None, set()
        for batch in batches:
            centre, number, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("home", "block", "role"))
            change = np.flatnonzero((centre[1:] != centre[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1
            edges = sorted({*change.tolist(), *range(0, batch.num_rows, STREAM_ROWS), batch.num_rows})
            found = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if (centre[lo], number[lo]) != key:
                    key, held, block, seen = (centre[lo], number[lo]), [], None, set()
                rows = flat(batch.slice(lo, hi - lo))
                if role[lo] == 0:
                    held.append(rows)
                    continue
                if held and block is None:
                    block = index(held)
                if block is not None:
                    found += compare(block, rows, seen)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    return run


def residual_links(members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components among open members, exactly, at least one for every two components of a home
    that a link joins. Nothing is emitted for pairs that do not link."""
    ids = members.select(F.col("rep").alias("doc_id")).unionByName(members.select(F.col("home").alias("doc_id"))).distinct()
    sets = common.materialise(full_sets(docs, common.materialise(ids, "ids"), width).dropDuplicates(["doc_id"]), "sets")
    side = lambda k, t: sets.select(F.col("doc_id").alias(k), F.col("tokens").alias(t))
    rows = members.join(side("rep", "t"), "rep").join(side("home", "c"), "home")
    outside = F.col("component") != F.col("home")
    rows = rows.select("home", "rep", "n", "component", outside.alias("outside"), F.size("c").cast("bigint").alias("m"), F.concat(F.array_except("t", "c"), F.array_except("c", "t")).alias("d"))
    rows = common.materialise(rows, "differences")
    common.drop_table(sets)
    stats = rows.where("outside").groupBy("home").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("d")).alias("t"))
    blocks = F.greatest(F.ceil(F.col("k") / F.lit(BLOCK_ROWS)), F.ceil(F.col("t") / F.lit(BLOCK_TOKENS))).cast("int")
    dealt = rows.join(stats.select("home", blocks.alias("blocks")), "home")
    columns = ["home", "block", "role", "rep", "n", "component", "m", "d"]
    open_ones = dealt.where("outside").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("role", F.lit(0))
    everyone = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    both = open_ones.select(*columns).unionByName(everyone.select(*columns)).repartition(common.parts(docs.sparkSession), "home", "block")
    links = both.sortWithinPartitions("home", "block", "role").mapInArrow(block_links(percent), "a bigint, b bigint")
    links = common.materialise(links, "residual")
    common.drop_table(rows)
    return links


def rekeyed(docs: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """docs with a key of its own, above all ids, in place of every null doc_id and of a doc_id that an earlier text
    (by hash) has; and those rows' (key, doc_id). None if every doc_id stands for one set. sigs: signatures of docs."""
    least = F.min(F.struct("fp1", "fp2"))
    clash = sigs.groupBy("doc_id").agg(least.alias("f"), F.max(F.struct("fp1", "fp2")).alias("g")).where("doc_id is null or f <> g").select("doc_id")
    if clash.isEmpty():
        return None
    clash = common.materialise(clash.withColumnRenamed("doc_id", "clashing"), "clashing")
    same = F.col("doc_id").eqNullSafe(F.col("clashing"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    found = docs.join(clash, same, "left_semi")
    first = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("clashing")).agg(F.min(text).alias("least_text"))
    first = found.select("*", text.alias("text_hash")).join(first, same, "left").withColumn("first", F.coalesce(F.col("text_hash") == F.col("least_text"), F.lit(False)))
    last = sigs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    # Written, since the keys must be the same whenever they are read.
    key = F.when(F.col("first"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.lit(last + 1))
    odd = common.materialise(first.select(*docs.columns, key.alias("key")), "rekeyed")
    rest = docs.join(clash, same, "left_anti").withColumn("key", F.col("doc_id"))
    rows = rest.unionByName(odd)
    return rows.withColumn("doc_id", F.col("key")).drop("key"), odd.select("key", "doc_id")


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, rare_limit: int = RARE_LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id): set size, and the least doc_id that links reach.

    Rows with a null doc_id are documents of their own, as are different texts of one doc_id. component_id is null only
    where links reach no other doc_id than null.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sigs = common.materialise(signatures(docs, width, percent), "shingles")
    odd = rekeyed(docs, sigs)
    if odd is None:
        return key_components(docs, sigs, width, percent, rare_limit)
    rows, keys = odd
    common.drop_table(sigs)
    sigs = common.materialise(signatures(rows, width, percent), "shingles")
    found = common.materialise(key_components(rows, sigs, width, percent, rare_limit), "rekeyed-components")
    found = found.withColumnRenamed("doc_id", "key")
    # The least id behind the keys of a component; only rows with another key than their id can lower it.
    moved = found.join(keys, "key").groupBy("component_id").agg(F.min("doc_id").alias("least_id"))
    least_key = keys.where("doc_id is null or doc_id <> key").agg(F.min("key")).first()[0]
    own = F.when(F.col("component_id") < F.lit(least_key), F.col("component_id"))
    out = found.join(keys.distinct(), "key", "left").withColumn("doc_id", F.when(F.col("key") < F.lit(least_key), F.col("key")).otherwise(F.col("doc_id")))
    return out.join(moved, "component_id", "left").select("doc_id", "n_shingles", F.least(own, F.col("least_id")).alias("component_id"))


def key_components(docs: DataFrame, sigs: DataFrame, width: int, percent: int, rare_limit: int = RARE_LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents whose doc_id is never null and stands for one text. sigs, their
    signatures, is a table of materialise() and deleted."""
    folded = common.materialise(sigs.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "folded")
    reps = sigs.join(folded, (F.col("doc_id") == F.col("rep")) & (sigs.fp1 == folded.fp1) & (sigs.fp2 == folded.fp2)).where(F.size("sketch") > 0)
    reps = common.materialise(reps.select("rep", "n", "sketch").dropDuplicates(["rep"]), "representatives")
    full, sigs = sigs, common.materialise(sigs.select("doc_id", "n", "fp1", "fp2"), "sizes")
    common.drop_table(full)

    length = F.least(F.size("sketch"), (F.col("n") - _overlap(F.col("n"), percent) + _extension(F.col("n"))).cast("int"))
    tokens = reps.select("rep", "n", F.explode(F.slice("sketch", F.lit(1), length)).alias("key"))
    groups = common.materialise(grouped(tokens), "token-groups")

    # Documents that may share frequent tokens only.
    need = _extension(_overlap(F.col("n"), percent))
    crowded = groups.where(F.col("df") > rare_limit).groupBy("rep", "n").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= need)
    crowded = common.materialise(crowded.select(F.col("rep").alias("doc_id")), "crowded")
    columns = ["key", "rep", "n", "centre", "centre_n"]
    sets = common.materialise(full_sets(docs, crowded, width).dropDuplicates(["doc_id"]), "crowded-sets")
    keyed = grouped(combinations(sets, percent, rare_limit))
    few = groups.where(F.col("df") <= rare_limit).select(*columns, F.lit(False).alias("crowd"))
    rows = common.materialise(few.unionByName(keyed.select(*columns, F.lit(True).alias("crowd"))), "groups")
    for spent in (groups, crowded, sets):
        common.drop_table(spent)

    stars = rows.where(F.col("rep") != F.col("centre")).where(_sizes_fit(F.col("n"), F.col("centre_n"), percent))
    checked = _checked(stars.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), docs, reps, width, percent)
    labels = connected_components(checked.where("linked"), "a", "b")
    links = checked.where("linked").select("a", "b")
    pairs = few_pairs(rows.where("not crowd"), labels, checked, percent)
    more = _checked(pairs, docs, reps, width, percent).where("linked").select("a", "b")
    members = common.materialise(open_members(rows.where("crowd"), labels), "open")
    common.drop_table(rows)
    common.drop_table(reps)
    if not members.isEmpty():
        more = more.unionByName(residual_links(members, docs, width, percent))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), "a", "b")

    out = sigs.select("doc_id", "n", "fp1", "fp2").join(folded, ["fp1", "fp2"], "left")
    out = out.join(labels, out.rep == labels.node, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def _checked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    likely = common.materialise(sketch_filter(pairs, reps, percent), "likely")
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    ids = common.materialise(ids, "ids")
    sets = common.materialise(full_sets(docs, ids, width).dropDuplicates(["doc_id"]), "sets")
    out = common.materialise(verify(likely, sets, percent), "checked")
    for spent in (likely, ids, sets):
        common.drop_table(spent)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs that are their group's least doc_id; all columns kept.

    A null doc_id counts as an id of its own above all others: such a row stays unless its group has a row that comes
    before it; so does any text of a doc_id but the first by hash. Of rows that repeat a doc_id and its text one stays.
    Rows without words stay. An empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sigs = common.materialise(signatures(plain, width, percent), "shingles")
    kind, names = docs.schema["doc_id"].dataType, docs.columns
    odd = rekeyed(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), sigs)
    rows, keys = odd or (docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), None)
    if odd:
        common.drop_table(sigs)
        sigs = common.materialise(signatures(rows, width, percent), "shingles")
    groups = key_components(rows.select("doc_id", "text"), sigs, width, percent)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    kept = common.materialise(kept, "kept")
    out = rows.join(kept.select("doc_id"), "doc_id", "left_semi")
    repeated = kept.where("times > 1").select("doc_id")
    if not repeated.isEmpty():
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    if keys is None:
        return out.select(*names).withColumn("doc_id", F.col("doc_id").cast(kind))
    back = keys.where("doc_id is null or doc_id <> key").select(F.col("key").alias("moved_key"), F.col("doc_id").alias("moved_id"))
    out = out.join(back, F.col("doc_id") == F.col("moved_key"), "left")
    doc_id = F.when(F.col("moved_key").isNull(), F.col("doc_id")).otherwise(F.col("moved_id")).cast(kind)
    return out.select(*[doc_id.alias("doc_id") if c == "doc_id" else F.col(c) for c in names])
