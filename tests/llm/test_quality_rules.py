import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa
import zstandard

from keystrata.llm import quality_rules as q

SQUEEZE = zstandard.ZstdCompressor(level=q.LEVEL).compress
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed]


def run(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = q.measure(batch, SQUEEZE)
    return [[c[i].as_py() for c in out[1:7]] for i in range(len(texts))]


EDGE = ["", None, " ", "a", "a b c d e a b c d e x", "x\ny\nx\n \n \nx", "é# ü|\x0bz w", "\n".join(["the same line here now"] * 9), "a\x00b " * 20, "a" * 5000]


def test_counts_on_edge_cases():
    assert run(EDGE) == [brute(t) for t in EDGE]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té#　", max_size=80), min_size=1, max_size=5))
def test_counts_on_random_texts(texts):
    assert run(texts) == [brute(t) for t in texts]


def test_bands_reject_repetition_and_noise_and_keep_prose():
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    prose = " ".join(rng.choice(vocabulary, 900))
    noise = rng.bytes(6000)
    verdict = lambda b: q.compression_verdict(b, SQUEEZE)[0]
    assert verdict(prose.encode())
    assert not verdict(noise)
    assert not verdict(b"buy now! " * 400)
    assert not verdict(prose.encode()[:4096] + b"buy now! " * 3000)
    assert verdict(b"short")


@pytest.mark.parametrize("rows", [[], [(1, None, "x"), (1, None, "x"), (2, "hello " * 30, "y")]])
def test_table_cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert q.quality_rules(df).count() == len(rows)
    assert q.filter_documents(df).columns == df.columns
    assert q.filter_documents(df).count() == 0


def test_the_last_partial_chunk_counts():
    noise = np.random.default_rng(2).bytes(3000)
    assert q.compression_verdict(b"a" * q.CHUNK_BYTES + noise, SQUEEZE)[2:] == (2, 2)
    assert q.compression_verdict(b"a" * q.CHUNK_BYTES + b"short", SQUEEZE)[2:] == (2, 1)


def test_bands_part_labelled_texts_that_the_word_rule_keeps(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    bad, good = ([r.kept for r in rows if r.quality == k] for k in (0, 1))
    assert 3 * bad.count(False) > len(bad) and 200 * good.count(False) <= len(good)


def test_short_texts_have_bands_too():
    squeeze = zstandard.ZstdCompressor(level=q.LEVEL).compress
    verdict = lambda t: q.compression_verdict(t.encode(), squeeze)[0]
    assert verdict("We saw the old mill by the river again in May.") and verdict("one two three four five six seven eight nine ten")
    assert not verdict("ha " * 30) and not verdict("-=" * 60) and verdict("tiny")
