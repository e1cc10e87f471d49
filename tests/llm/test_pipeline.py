import sys

import numpy as np
import public_tokenizers
import sentencepiece
import zstandard

import corpus_pipeline
from keystrata.llm import quality_rules as q

from .test_jaccard_join import brute as jaccard
from .test_quality_rules import brute as counts

SF = "/root/testdata/sf0.001"


def cut(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            gone[k : k + length] |= b[k : k + length] in seen
            seen.add(b[k : k + length])
        if not gone.any():
            out.append((i, t))
            continue
        kept, at = [], 0
        for ch in t:
            size = len(ch.encode())
            if not gone[at : at + size].all():
                kept.append(ch)
            at += size
        if "".join(kept).strip():
            out.append((i, "".join(kept)))
    return out


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    squeeze = zstandard.ZstdCompressor(level=q.LEVEL).compress
    docs = [(i, t) for i, t in docs if not counts(t)[-1] and q.compression_verdict(t.encode(), squeeze)[0]]
    one = {i for i, _, c in jaccard(docs, 5, 80) if i == c}
    docs = cut([(i, t) for i, t in docs if i in one])
    windows = {tuple(t.split()[k : k + 13]) for t in items for k in range(len(t.split()) - 12)}
    docs = [(i, t) for i, t in docs if not any(tuple(t.split()[k : k + 13]) in windows for k in range(len(t.split()) - 12))]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: lib.encode(t, add_bos=True, add_eos=True) for i, t in docs}
    out = corpus_pipeline.run(spark, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(list(got[i].ids) == want[i] and got[i].text == lib.decode(want[i]) and got[i].n_tokens == len(want[i]) for i in want)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids"]


def test_registered_queries():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= set(names)


def test_library_does_not_import_llm():
    import subprocess

    code = "import sys; sys.modules['keystrata.llm'] = None; import __spark_entry__ as e; assert 'smj_customer_orders' in e.queries() and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).returncode == 0
