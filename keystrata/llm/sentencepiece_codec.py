"""SentencePiece encoding and decoding with byte offsets into the original text.

Normalisation walks the model's compiled character map (a double-array trie) by longest prefix and records, for every
normalised byte, the source byte it came from. The normalised text is cut at word boundaries no vocabulary piece
crosses, each unit is merged once by the library's own segmenter (loaded with its normaliser switched off) and kept
in a bounded cache, and every piece is projected through the alignment to the bytes of the original text.

A model with an empty character map aligns byte for byte; then only the marker of the dummy prefix has no source.
Empty or null text gives the begin and end ids alone. Texts of any length are encoded whole; repeated rows each get
their own result, extra columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Units kept in each of the cache's two generations.
CACHE_UNITS = 200_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint, covered_bytes bigint"


def wire_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of each field of a serialized protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: byte strings to replacements, looked up by longest prefix."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:] and what replaces it."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        end = self.texts.index(0, found[1])
        return found[0], self.texts[found[1] : end]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class UnitCache(dict):
    """Bounded two-generation cache: what an older generation holds moves up when it is used."""

    def __init__(self, make, size: int = CACHE_UNITS):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class OffsetCodec:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec: dict[int, object] = {}
        for number, value in wire_fields(model):
            if number == 3:
                spec |= dict(wire_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze_spaces = bool(spec.get(4, 1))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # A second normaliser message is merged into the first: no map, no prefix, spaces kept, markers escaped.
        off = bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 1])
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([0x1A, len(off)]) + off)
        lib = self.library
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        plain = [p for i, p in enumerate(pieces) if not lib.is_control(i) and not lib.is_unknown(i) and not lib.is_byte(i)]
        #: Units may be cut before a space that follows something else only if no piece spans such a place.
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        self.piece_bytes = np.array([0 if lib.is_control(i) else 1 if lib.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        self.unknown = lib.unk_id() if not any(lib.is_byte(i) for i in range(lib.vocab_size())) else -1
        self.cache = UnitCache(self._segment, cache_units)
        self.words = UnitCache(lambda w: self._segment(" " + w), cache_units)
        self.ends = array("I", [lib.bos_id()]).tobytes(), array("I", [lib.eos_id()]).tobytes()

    def _segment(self, unit: str) -> bytes:
        return array("I", self.segmenter.encode(unit)).tobytes()

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text with plain spaces, and for each of its bytes and its end the source byte.

        The alignment is None where it is the identity but for a dummy prefix.
        """
        if not text:
            return "", None
        if not self.map.units and not self.squeeze_spaces and MARK not in text:
            return (" " + text if self.dummy_prefix else text), None
        data, out, align = text.encode(), bytearray(), []
        at, mark = 0, MARK.encode()
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, new = hit
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + size]
            for byte in new.replace(mark, b" "):
                if self.squeeze_spaces and byte == 32 and (not out or out[-1] == 32):
                    continue
                out.append(byte)
                align.append(at)
            at += size
        end = at
        if self.squeeze_spaces:
            while out and out[-1] == 32:
                end = align.pop()
                out.pop()
        if not out:
            return "", None
        if self.dummy_prefix:
            out[:0] = b" "
            align[:0] = [align[0]]
        return out.decode(), np.array([*align, end], np.int64)

    def encode_normalised(self, normal: str) -> bytes:
        if not normal:
            return b""
        if not self.cuttable:
            return self._segment(normal)
        if normal[0] == " " and "  " not in normal and normal[-1] != " ":
            return b"".join(map(self.words.__getitem__, normal[1:].split(" ")))
        return b"".join(map(self.cache.__getitem__, re.findall(" *[^ ]+| +", normal)))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, and a (n, 2) array of byte spans in the original text (empty for those two)."""
        normal, align = self.normalise(text)
        body = self.encode_normalised(normal)
        ids = np.frombuffer(self.ends[0] + body + self.ends[1], "<u4")
        places = np.cumsum(self.piece_bytes[ids])
        if self.unknown >= 0 and len(ids) > 2 and (ids == self.unknown).any():
            places = self._places_with_unknown(normal, ids)
        if align is not None:
            edge = align[np.minimum(places, len(align) - 1)]
            low = np.concatenate(([0], edge[:-1]))
        else:
            edge = np.maximum(places - (self.dummy_prefix and bool(normal)), 0)
            low = np.concatenate(([0], edge[:-1]))
        return ids, np.stack((low, edge), 1)

    def _places_with_unknown(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """Ends of pieces for models without byte pieces, where an unknown piece has any length."""
        found, at, data = [0], 0, self.segmenter.encode(normal, out_type=str)
        for piece in data:
            at += len(piece.replace(MARK, " ").encode())
            found.append(at)
        return np.array([*found, at], np.int64)[: len(ids)]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_CODECS: dict[str, OffsetCodec] = {}


def codec(path: str) -> OffsetCodec:
    """One codec a worker process."""
    if path not in _CODECS:
        _CODECS[path] = OffsetCodec(path)
    return _CODECS[path]


def spans_of(docs: DataFrame, path: str) -> DataFrame:
    """Per document its ids and the byte spans of its pieces: (doc_id, ids array<int>, starts array<int>, ends array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for piece in common.pieces(batches):
            done = [c.encode(t or "") for t in piece.column("text").to_pylist()]
            lists = [[d[0].astype(np.int32) for d in done], [d[1][:, 0].astype(np.int32) for d in done], [d[1][:, 1].astype(np.int32) for d in done]]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both, with the spans' digest and the bytes that some piece covers: SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for piece in common.pieces(batches):
            rows = []
            for text in piece.column("text").to_pylist():
                ids, spans = c.encode(text or "")
                decoded = c.decode(ids).encode()
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), zlib.crc32(spans.astype("<u4").tobytes()), int((spans[:, 1] - spans[:, 0]).sum())))
            a, b, d, e, f = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b), pa.array(d), pa.array(e, pa.int64()), pa.array(f, pa.int64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with text replaced by what its ids decode to, and new columns n_tokens and ids (the last two; columns of
    docs with these names give way). Null text stays null with the begin and end ids."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    common.bounded_batches(docs.sparkSession)
    kept = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for piece in common.pieces(batches):
            done = [(t, c.encode(t or "")[0]) for t in piece.column("text").to_pylist()]
            columns = list(piece.columns)
            columns[at] = pa.array([None if t is None else c.decode(i) for t, i in done], pa.string())
            cuts = np.concatenate(([0], np.cumsum([len(i) for _, i in done])))
            flat = np.concatenate([i for _, i in done]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cuts), pa.int64()), lists], names=[*names, "n_tokens", "ids"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(run, schema)
