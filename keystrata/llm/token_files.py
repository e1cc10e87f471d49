"""Token ids as plane-shuffled binary files, and back.

File format. Ids are cut into blocks of BLOCK_IDS. A block is transposed into byte planes (all lowest bytes, then all
second bytes, ..) or bit planes; planes that are zero throughout are left out, every other plane is compressed by
zstandard on its own. After the blocks come a document table (ids, lengths and one byte each that is 0 for a null id,
compressed) and a chunk index: for every block its offset, number of ids, plane kind, number of planes and the planes' sizes. The last 16 bytes are the
index's offset and size. A reader seeks to any id range through the index and holds one block at a time.

Files are made per range of doc_id, ascending, in the shared folder, under a name of their own that is moved into
place when complete; a retried task writes the same bytes. Null text counts as empty and yields the end id alone;
rows that repeat a doc_id stay, ordered by their text; null ids come first, ordered likewise; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import io
import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sentencepiece_codec import UnitCache

MAGIC = b"KSPLANE2"
BLOCK_IDS = 1 << 16
LEVEL = 3
CACHE_UNITS = 200_000

# Planes -----------------------------------------------------------------------------------------------------------


def shuffle_block(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """The block's planes, lowest first, without the zero planes above the highest one used."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max(initial=0))
    if planes == "byte":
        table = ids.view(np.uint8).reshape(-1, 4).T
        return [table[i].tobytes() for i in range((top.bit_length() + 7) // 8)]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(top.bit_length())]


def unshuffle_block(data: list[bytes], n: int, planes: str = "byte") -> np.ndarray:
    if planes == "byte":
        table = np.zeros((n, 4), np.uint8)
        for i, plane in enumerate(data):
            table[:, i] = np.frombuffer(plane, np.uint8)
        return table.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for i, plane in enumerate(data):
        bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    def __init__(self, sink, planes: str = "byte", block_ids: int = BLOCK_IDS):
        self.sink, self.planes, self.block_ids = sink, planes, block_ids
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        self.pending: list[np.ndarray] = []
        self.held = self.offset = self.total = 0
        self.index = io.BytesIO()
        self.blocks = 0
        self.doc_ids, self.lengths, self.present = array("q"), array("q"), bytearray()
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.block_ids:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        full = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for at in range(0, full, self.block_ids):
            block = ids[at : min(at + self.block_ids, full)]
            data = [self.squeeze(p) for p in shuffle_block(block, self.planes)]
            self.index.write(struct.pack("<QIBB", self.offset, len(block), self.planes == "bit", len(data)))
            self.index.write(struct.pack(f"<{len(data)}I", *map(len, data)))
            self.blocks += 1
            for plane in data:
                self._put(plane)
        self.pending = [ids[full:]]
        self.held = len(ids) - full

    def close(self) -> None:
        self._blocks(last=True)
        docs = self.squeeze(self.doc_ids.tobytes() + self.lengths.tobytes() + self.present)
        at = self.offset
        self._put(docs)
        index = struct.pack("<QQQQ", at, len(docs), len(self.doc_ids), self.blocks) + self.index.getvalue()
        where = self.offset
        self._put(index)
        self._put(struct.pack("<QQ", where, len(index)))


class PlaneReader:
    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        where, length = struct.unpack("<QQ", self._at(size - 16, 16))
        index = self._at(where, length)
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token plane file")
        self.expand = zstandard.ZstdDecompressor().decompress
        at, n, self.n_docs, blocks = struct.unpack_from("<QQQQ", index)
        docs = self.expand(self._at(at, n)) if self.n_docs else b""
        table = np.frombuffer(docs, "<i8", 2 * self.n_docs)
        self.doc_ids, self.lengths = table[: self.n_docs], table[self.n_docs :]
        self.present = np.frombuffer(docs, np.uint8, self.n_docs, 16 * self.n_docs).astype(bool)
        self.blocks, place = [], 32
        for _ in range(blocks):
            offset, count, bit, planes = struct.unpack_from("<QIBB", index, place)
            sizes = struct.unpack_from(f"<{planes}I", index, place + 14)
            place += 14 + 4 * planes
            self.blocks.append((offset, count, "bit" if bit else "byte", sizes))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, i: int) -> np.ndarray:
        offset, count, planes, sizes = self.blocks[i]
        data = self._at(offset, sum(sizes))
        cuts = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        return unshuffle_block([self.expand(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], count, planes)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1 of the file, through the chunk index."""
        ends = np.cumsum([b[1] for b in self.blocks])
        found, i = [], int(np.searchsorted(ends, first, side="right"))
        while first < last:
            begin = int(ends[i] - self.blocks[i][1])
            found.append(self.block(i)[first - begin : last - begin])
            first, i = int(ends[i]), i + 1
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id or None, ids) in file order, a block in memory at a time."""
        held, i = np.zeros(0, "<u4"), 0
        for doc_id, n, present in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.present.tolist(), strict=True):
            got = [held]
            have = len(held)
            while have < n:
                got.append(self.block(i))
                have += len(got[-1])
                i += 1
            held = np.concatenate(got) if len(got) > 1 else held
            yield doc_id if present else None, held[:n]
            held = held[n:]


# Encoding ------------------------------------------------------------------------------------------------------------

# The pre-tokenizer's pattern for models that lower-case and drop white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level models: bytes that print stay, the others follow from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, a unit (what stands between plain spaces) at a time.

    The library's normaliser and pre-tokenizer never join what a space parts, so a text's ids are its units' ids in
    order. Prose without other punctuation is split on its spaces and marks alone. Units go to the whole tokenizer unless they are plain (letters below U+0180, in composed form, no special
    token); those are cut by the same pattern here and only new words reach the library's model.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.plain_rules = self._known(spec)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(WORD_PATTERN)
        self.plain = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-ſ\n]+")
        #: Prose of letters, spaces, line ends and lone full stops and commas needs no pattern at all.
        self.not_prose = re.compile(r"[^A-Za-zÀ-ÖØ-öø-įı-ſ \n.,]|[.,][.,]")
        self.words = UnitCache(self._word, cache_units)
        self.units = UnitCache(self._unit, cache_units)

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether the file has the rules that the fast way restates."""
        norm = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return norm == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern", {}).get("Regex") == WORD_PATTERN and pre[0].get("invert") is True and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"]

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.alphabet.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if self.plain_rules and self.plain.fullmatch(unit) and "İ" not in unit and not ("<" in unit and any(s in unit for s in self.specials)) and unicodedata.is_normalized("NFC", unit):
            return b"".join(map(self.words.__getitem__, self.pattern.findall(unit.lower())))
        return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.plain_rules and not self.not_prose.search(text):
            words = text.lower().replace(".", " . ").replace(",", " , ").split()
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
        if self.plain_rules:
            return np.frombuffer(b"".join(map(self.units.__getitem__, text.split(" "))), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# Tables to files and back -----------------------------------------------------------------------------------------------

INDEX_SCHEMA = "file string, part int, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, planes: str = "byte", n_parts: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into files below folder, in ascending doc_id order; the files' index as a table.

    One exchange by ranges of doc_id carries the texts; each task then encodes and writes its range as a stream.
    """
    n_parts = n_parts or common.parts(docs.sparkSession)
    uri = common.file_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(uri)
        enc, writer, sink = encoder(path), None, None
        end = np.array([end_id], "<u4")
        for piece in common.pieces(batches):
            if writer is None:
                store.create_dir(base, recursive=True)
                draft = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
                sink = store.open_output_stream(draft)
                writer = PlaneWriter(sink, planes)
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                writer.add(doc_id, np.concatenate((enc.encode(text or ""), end)))
        if writer is not None:
            writer.close()
            sink.close()
            name = f"part-{part:06d}.ksp"
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [len(writer.lengths)], "n_tokens": [writer.total]})

    # Null ids are ranged by how their texts begin, so that they need not meet in one task.
    begins = F.when(F.col("doc_id").isNull(), F.substring("text", 1, 64))
    ranged = docs.select("doc_id", "text").repartitionByRange(n_parts, F.col("doc_id"), begins)
    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, INDEX_SCHEMA)


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that index names."""
    uri = common.file_uri(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: the running sum sees as many rows as there are files, not documents.
    placed = index.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    rows = []
                    for doc_id, ids in PlaneReader(source).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                a, b, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(a, pa.int64()), "start": pa.array(b, pa.int64()), "n_tokens": pa.array(c, pa.int64()), "ids_crc32": pa.array(d, pa.int64())})

    dealt = placed.repartition(common.parts(index.sparkSession), "part")
    return dealt.select("file", "start").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, planes: str = "byte") -> DataFrame:
    """Write docs as token files in the shared folder and read every document back from them."""
    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    index = common.materialise(write_tokens(docs, path, folder, end_id, planes), "token-index")
    return read_tokens(index, folder)
