import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keystrata.llm import token_files as t

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ENC = t.WordEncoder(PATH, cache_units=60)
EDGE = ["", " ", "a", "It's WE'LL don't", "x\n\ny  z\t", "É é Σ ΑΣ İ ǅ", "½ Ⅷ ٣ 12a", "<|endoftext|> a<|startoftext|>b <|", "\x00 \x85 \xa0 　", "日本語 한 😀", "a" * 2000, "the&&& |###", "ſ ĸ ŉ ªº"]


@pytest.mark.parametrize("text", EDGE)
def test_encoder_edges(text):
    assert ENC.encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abS'l \n<|>éÉ"), st.characters(codec="utf-8")), max_size=50))
def test_encoder_random(text):
    assert ENC.encode(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12), st.sampled_from(["byte", "bit"]), st.sampled_from([1, 7, 64]))
def test_file_round_trip(docs, planes, block):
    sink = io.BytesIO()
    w = t.PlaneWriter(sink, planes, block)
    for i, d in enumerate(docs):
        w.add(i * 3, np.array(d, "<u4"))
    w.close()
    r = t.PlaneReader(sink)
    assert [(i, x.tolist()) for i, x in r.documents()] == [(i * 3, d) for i, d in enumerate(docs)]
    flat = [x for d in docs for x in d]
    for a, b in ((0, len(flat)), (len(flat) // 3, len(flat) // 2)):
        assert r.ids(a, b).tolist() == flat[a:b]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_table_round_trip(spark, planes):
    rows = [(9, "The end", "q"), (3, None, "q"), (5, "", "q"), (7, "w " * 70000, "q"), (5, "b", "q"), (1, "It's", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(map(tuple, t.token_round_trip(spark, df, PATH, planes=planes).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert t.token_round_trip(spark, df.limit(0), PATH).count() == 0


def test_null_ids_come_first(spark):
    rows = [(9, "The end"), (None, "b"), (0, "x"), (None, None), (-4, "y"), (None, "a " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, t.token_round_trip(spark, df, PATH).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = LIB.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
