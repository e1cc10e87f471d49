import collections
import math
import re
import zlib

import numpy as np

from keystrata.llm import language_model as m


def brute(rows):
    lower = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
    toks = {i: [("w", w) for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t))] + ["end"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = collections.Counter(t for i in toks for t in toks[i] if not held[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(x), sum(c[t] > 0 for t in x), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in x)) for i, x in toks.items()}


def test_base_scores_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "HEAD_WORDS", 5)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "c", "longer", "é", "x1"], rng.integers(1, 30))) + f" rare{i % 11}") for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\x1f only\nonce"), (103, "deep " * 60000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int").repartition(4)
    want = brute(rows)
    got = {r.doc_id: r for r in m.score(df).collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4] and math.isclose(g.base_score, w[4], rel_tol=1e-9)
        assert g.score < 0
    assert m.score(df.limit(0)).count() == 0


def test_distribution_sums_to_one():
    rng = np.random.default_rng(1)
    n_words = m.FREQUENT + 500
    counts = np.sort(rng.integers(1, 1000, n_words))[::-1]
    hashes = rng.permutation(np.arange(1, n_words + 1)).astype(np.uint64) * np.uint64(2654435761)
    group = (hashes & np.uint64(m.GROUP)).astype(int)
    v = m.Vocabulary(hashes, counts, int(counts.sum()), n_words, np.bincount(group, weights=counts + 1, minlength=64))
    model = m.Maxent(v)
    model.class_table[:] = rng.normal(0, 0.5, model.class_table.shape)
    model.word_table[:] = rng.normal(0, 0.5, model.word_table.shape)
    ids = np.stack([np.full(m.FREQUENT, 7), np.arange(m.FREQUENT)], 1).reshape(-1)
    logs = model.log_probabilities(ids, np.arange(0, 2 * m.FREQUENT + 1, 2))[1::2]
    tail = model.log_probabilities(np.stack([np.full(64, 7), m.FREQUENT + np.arange(64)], 1).reshape(-1), np.arange(0, 129, 2))[1::2]
    words = np.bincount(group[m.FREQUENT :], weights=counts[m.FREQUENT :] + 1, minlength=64) + 1  # one unseen word a group
    total = np.exp(logs).sum() + (np.exp(tail) * words / v.rest).sum()
    assert abs(total - 1) < 1e-4


def test_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = m.score(docs).toPandas()
    h = out[out.held_out]
    per = lambda c, x: x[c].sum() / x.n_tokens.sum()
    print("LM held", per("score", h), per("base_score", h), "train", per("score", out[~out.held_out]), (h.score > h.base_score).mean())
    assert per("score", h) > per("base_score", h) + 0.12


def test_partitions_and_row_order_have_no_say(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_TOKENS", 10_000)
    monkeypatch.setattr(m, "SCALE_TOKENS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a null id"), (None, None), (3, "another text of a known id")], docs.schema))
    one, two = (m.score(docs.repartition(n)).toPandas().sort_values(["doc_id", "n_tokens", "base_score"]) for n in (2, 64))
    n = int(one.train_tokens.iloc[0])
    assert m.shard_count(n, m.ROUNDS) > 2 and m.scale(n) > 1
    assert np.allclose(one.score, two.score, rtol=0, atol=1e-5) and np.allclose(one.base_score, two.base_score, rtol=1e-12)


def test_equal_counts_fill_the_head_by_hash(spark, monkeypatch):
    monkeypatch.setattr(m, "HEAD_WORDS", 4)
    counts = spark.createDataFrame([(h, 9 if h == 7 else 2) for h in (7, -3, 5, 11, 2, -8)], "h long, c long")
    hashes, number = m.frequent_words(counts)
    assert hashes.view(np.int64).tolist() == [7, 2, 5, 11] and number.tolist() == [9, 2, 2, 2]


def test_the_model_grows_with_the_corpus():
    sizes = []
    for n in (10**6, 10**8, 10**10):
        model = m.Maxent(m.Vocabulary(np.arange(9, dtype=np.uint64), np.arange(9, 0, -1), n, 9, np.zeros(64) + 9))
        sizes.append((len(model.flat()), model.start, m.shard_count(n, 2)))
    assert all(a < b for x, y in zip(sizes[:2], sizes[1:3], strict=True) for a, b in zip(x, y, strict=True))
    assert m.scale(10**14) == m.MOST_SCALE
    assert sizes[2][0] * sizes[2][2] / 10**10 < 2 * sizes[1][0] * sizes[1][2] / 10**8
