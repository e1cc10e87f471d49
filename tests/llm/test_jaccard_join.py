import re

import numpy as np
import pyarrow as pa
import pytest

from keystrata.llm import jaccard_join as j
from keystrata.llm.components import connected_components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=260, words=(4, 120)):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = list(rng.choice(vocabulary, 40))
    rows, texts = [], []
    for i in range(n):
        kind = rng.integers(0, 6)
        if kind < 3 and texts:
            t = list(texts[rng.integers(0, min(len(texts), 12))])
            for _ in range(rng.integers(0, 1 + len(t) // 12)):
                t[rng.integers(0, len(t))] = str(rng.choice(vocabulary))
        elif kind == 3:
            t = passage + list(rng.choice(vocabulary, rng.integers(0, 30)))
        else:
            t = list(rng.choice(vocabulary, rng.integers(*words)))
        texts.append(t)
        rows.append((i * 7 % 1009, " ".join(t)))
    return rows


EDGE = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE\ttwo"), (2005, "one two three four"), (2006, "a b"), (2007, "x " * 3000), (2008, "X " * 2000)]


@pytest.mark.parametrize("seed,width,percent,rare", [(1, 4, 85, 24), (2, 4, 85, 2), (3, 5, 80, 1), (4, 5, 80, 24)])
def test_components_match_brute_force(spark, seed, width, percent, rare):
    rows = corpus(seed) + EDGE
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, j.jaccard_components(df, width, percent, rare).collect()))
    assert got == brute(rows, width, percent)


def test_keep_one_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0), (2, "a b c d e f", 1), (3, None, 2), (4, None, 3)], "doc_id long, text string, key int")
    assert sorted(r[0] for r in j.keep_one(df).collect()) == [1, 3, 4]
    assert j.keep_one(df).columns == df.columns
    assert j.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_share_a_combination():
    """Whatever the tokens' frequencies, own tokens first, two linked sets have a key in common."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(600):
        n, percent, rare = int(rng.integers(1, 400)), int(rng.choice([80, 85, 90])), int(rng.choice([1, 24]))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        drop = rng.integers(0, 1 + (100 - percent) * n // 100)
        sets = [base[int(drop) :], np.concatenate((base, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + (100 - percent) * n // 100)), dtype=np.uint64)))]
        df = {int(t): int(rng.choice([2, 30, 4000])) for t in base}
        keys = []
        for s in sets:
            shared = np.array(sorted((df[int(t)], int(t)) for t in s if int(t) in df), dtype=object).reshape(-1, 2)
            keys.append(j.combination_keys(shared[:, 1].astype(np.uint64), shared[:, 0].astype(np.int64), len(s), percent, rare))
        both = np.intersect1d(*sets).size
        if 100 * both >= percent * np.union1d(*sets).size:
            linked += 1
            assert np.intersect1d(*keys).size
    assert linked > 200


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, connected_components(edges, "a", "b").collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("postings,stream", [(1, 1), (7, 3), (1 << 20, 512)])
def test_block_links_in_parts(monkeypatch, postings, stream):
    """However finely postings and rows are cut, the links are those of a plain comparison."""
    monkeypatch.setattr(j, "POSTINGS", postings)
    monkeypatch.setattr(j, "STREAM_ROWS", stream)
    rng, percent = np.random.default_rng(9), 80
    centre = set(range(40))
    sets = [centre - set(rng.choice(40, rng.integers(0, 9)).tolist()) | set((100 + rng.choice(12, rng.integers(0, 7))).tolist()) for _ in range(30)]
    rows = [(role, i + 1, len(s), i + 1, len(centre), sorted(s ^ centre)) for role in (0, 1) for i, s in enumerate(sets) if role or i % 2]
    types = [("role", pa.int32()), ("rep", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("m", pa.int64()), ("d", pa.list_(pa.int64()))]
    arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)]
    zero = pa.array([0] * len(rows), pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, *arrays], names=["home", "block", *[t[0] for t in types]])
    got = {(a, b) for out in j.block_links(percent)(iter([batch.slice(0, 11), batch.slice(11)])) for a, b in zip(*out.to_pydict().values(), strict=True)}
    linked = lambda s, t: 100 * len(s & t) >= percent * len(s | t)
    want = {(i + 1, k + 1) for i, s in enumerate(sets) for k, t in enumerate(sets) if i < k and (i % 2 or k % 2) and linked(s, t)}
    assert got == want and 0 < len(want)


def test_keep_one_with_null_ids_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (None, c + " end", "x"), (3, c, "x"), (3, c, "x"), (5, "alone", "x"), (5, "alone", "x"), (None, "", "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = j.keep_one(df)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(None, a, "x"), (None, b, "x"), (3, c, "x"), (5, "alone", "x"), (None, "", "x"), (7, None, "x")], key=str)
    assert out.schema == df.schema


def test_different_texts_of_one_id_are_different_documents(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = lambda t: t.replace("30 ", "30 new ")
    rows = [(1, a), (2, near(a)), (2, b), (2, b), (9, near(b)), (None, c), (None, near(c)), (4, near(c) + " end"), (None, "alone with a null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id) for r in j.jaccard_components(df, 4, 80).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 2), (2, 2), (9, 2), (None, 4), (None, 4), (4, 4), (None, None)], key=str)
    left = sorted(map(tuple, j.keep_one(df, 4, 80).collect()), key=str)
    assert (1, a) in left and (4, near(c) + " end") in left and (None, "alone with a null id") in left and len(left) == 4
    assert [i for i, t in left if t in (b, near(b))] in ([2], [9])


def test_a_thousand_near_copies(spark):
    """One cluster whose members differ in a few words each, many just below the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(1000):
        t = list(base)
        for at in rng.choice(90, int(rng.integers(0, 6)), replace=False):
            t[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(map(tuple, j.jaccard_components(df, 5, 80).collect()))
    assert got == brute(rows, 5, 80)
