import zlib

import numpy as np
import pyarrow.parquet as pq

from keystrata.llm import quality_model as q
from keystrata.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    out = {r.doc_id: r for r in t.toxicity(docs, labels).collect()}
    assert len(out) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held)
    y, p = (np.array(x) for x in zip(*((truth[i], out[i].predicted) for i in held), strict=True))
    recall, precision = (p[y == 1]).mean(), (y[p == 1]).mean()
    print("toxicity", len(y), recall, precision)
    assert recall > 0.8 and precision > 0.9  # about one label in seven has no toxic word at all


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    out = {r.doc_id: r for r in q.classify(docs).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    y, p = (np.array(x) for x in zip(*((truth[i], out[i].kept) for i in truth), strict=True))
    print("quality", p[y == 1].mean(), 1 - p[y == 0].mean())
    assert p[y == 1].mean() > 0.98 and p[y == 0].mean() < 0.1


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a\nb " * 9000, 1), (3, "a", 1), (4, "you idiot", 1), (None, "x", 2)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (3, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert t.toxicity(docs, labels).count() == 6 and q.classify(docs).count() == 6
    assert t.toxicity(docs, labels.limit(0)).where("score < 0.5").count() == 6
    assert t.toxicity(docs.limit(0), labels).count() == 0 and q.classify(docs.limit(0)).count() == 0


def test_em_finds_accurate_labellers():
    rng = np.random.default_rng(2)
    good = rng.random(20000) < 0.8
    vote = np.zeros((20000, len(q.STATISTICS)), np.int8)
    for j in range(len(q.STATISTICS)):
        right = rng.random(20000) < (0.95 if j < 4 else 0.8)
        vote[:, j] = np.where(rng.random(20000) < 0.3, 0, np.where(right == good, 1, -1))
    code, count = np.unique(q.pattern_code(vote), return_counts=True)
    assert (q.pattern_votes(code) == q.pattern_votes(q.pattern_code(q.pattern_votes(code)))).all()
    post, tables, prior = q.fit_labellers(code, count)
    labels = dict(zip(code.tolist(), post > 0.5, strict=True))
    got = np.array([labels[c] for c in q.pattern_code(vote).tolist()])
    assert (got == good).mean() > 0.95 and abs(prior - 0.8) < 0.05


def test_em_overrules_lone_bad_votes_on_the_tables():
    docs, labels = (pq.read_table(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    found = [q.statistics(b)[:2] for b in docs.select(["doc_id", "text"]).to_batches(max_chunksize=1000)]
    vote = q.votes(*(np.concatenate(x) for x in zip(*found, strict=True)))
    code, back, count = np.unique(q.pattern_code(vote), return_inverse=True, return_counts=True)
    post, _, _ = q.fit_labellers(code, count)
    good = post[back] > 0.5
    quality = dict(zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True))
    truth = np.array([quality.get(i, -1) for i in docs["doc_id"].to_pylist()])
    bad, fine = (vote < 0).sum(axis=1), (vote > 0).sum(axis=1)
    assert good[truth == 1].mean() > 0.99 and good[truth == 0].mean() < 0.02
    # Neither "no labeller voted bad" nor the majority, where EM starts.
    lone = (bad == 1) & (truth >= 0)
    assert (good != (bad == 0)).sum() > 50 and (good != (fine >= bad)).mean() > 0.05
    assert good[lone & (truth == 1)].mean() > 0.9 and good[lone & (truth == 0)].mean() < 0.1


def test_non_negative_risk_ignores_positives_hidden_in_unlabelled():
    rng = np.random.default_rng(4)
    text = lambda bad: np.unique(np.append(rng.integers(10, 400, 20), [1, 2][rng.integers(0, 2)] if bad else 5))
    p = [text(True) for _ in range(400)]
    hidden = rng.random(2000) < 0.3
    u = [text(h) for h in hidden]
    chosen = t.choose(p, u, 0.3)
    w, b = t.fit_nnpu(p, u, 0.3, chosen)
    dense = np.zeros(1 << t.BITS)
    dense[chosen] = w
    got = np.array([dense[x].sum() + b > 0 for x in u])
    assert (got == hidden).mean() > 0.97
