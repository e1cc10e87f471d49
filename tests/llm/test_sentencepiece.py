import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import sentencepiece_codec as s

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = s.OffsetCodec(PATH, cache_units=50)
EDGE = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb c", "▁x ▁▁y", "é😀ﬁ́ \x00 <s></s> ▁", "x" * 3000, "the  \t end 　z", "<0x41> <unk>"]


def check(text):
    ids, spans = CODEC.encode(text)
    assert ids.tolist() == LIB.encode(text, add_bos=True, add_eos=True)
    assert CODEC.decode(ids) == LIB.decode(ids.tolist())
    assert (spans[:, 0] <= spans[:, 1]).all() and spans[-1, 1] == len(text.encode())
    assert (spans[1:, 0] == spans[:-1, 1]).all()


@pytest.mark.parametrize("text", EDGE)
def test_edges(text):
    check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the \n▁é"), st.characters(codec="utf-8")), max_size=60))
def test_random(text):
    check(text)


def test_spans_agree_with_library():
    text = "Héllo wörld, these are 12 pieces ▁of text 😀."
    ids, spans = CODEC.encode(text)
    proto = LIB.encode(text, return_type="proto")
    ends = [p.end for p in proto.pieces]
    mine = spans[1:-1, 1].tolist()
    known = [i for i, x in enumerate(ids[1:-1].tolist()) if not LIB.is_byte(x)]
    assert [mine[i] for i in known] == [ends[i] for i in known]


def compiled(pairs):
    """A double-array map of one-byte keys only, built by hand for the look-up's test."""
    texts, units = b"", [0] * 1024
    units[0] = 256 << 10
    for key, new in pairs.items():
        leaf = 600 + key
        units[256 ^ key] = key | 1 << 8 | (leaf ^ 256 ^ key) << 10
        units[leaf] = len(texts) | 1 << 31
        texts += new + b"\0"
    blob = np.array(units, np.uint32).tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_character_map_alignment():
    codec = s.OffsetCodec(PATH)
    codec.map = s.CharacterMap(compiled({ord("A"): b"aa", ord("\t"): b" "}))
    assert codec.map.longest(b"xA", 1) == (1, b"aa") and codec.map.longest(b"xA", 0) is None
    codec.squeeze_spaces = True
    normal, align = codec.normalise(" \tAb  c\t")
    assert normal == " aab c" and align.tolist() == [2, 2, 2, 3, 4, 6, 7]
    ids, spans = codec.encode(" \tAb  c\t")
    assert ids.tolist()[1:-1] == codec.segmenter.encode(" aab c") and spans[-1].tolist()[1] == 7


def test_query_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "a b", "k"), (3, "a b", "k"), (4, "long words " * 5000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(r)[:4] for r in s.round_trip(df, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = LIB.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert s.round_trip(df.limit(0), PATH).count() == 0
    assert s.spans_of(df, PATH).count() == 5
