"""Token files: ids in fixed-size blocks, transposed to byte or bit planes, each plane compressed, with a chunk index.

File layout (all numbers little-endian)::

    b"TMPLANE1"
    block 0 planes | block 1 planes | ...           one zstandard frame per plane
    documents: zstandard frame of int64 ids, then uint32 token counts, then one byte per null id
    index: zstandard frame of JSON {"width", "planes", "block", "chunks": [[offset, n_ids, crc32, [plane bytes...]]...],
           "documents": [offset, bytes, n_docs], "n_ids"}
    uint64 offset of the index, uint32 bytes of the index, b"TMPLANE1"

Planes of higher bytes and bits hold few different values and compress well; a reader needs only the chunks of the ids it
wants.  One file holds one range of doc_ids; ranges are cut by exact prefix sums of text sizes, so equal input gives equal
files.  Files get their names only after their task has ended (see ``common.commit``).

A null or empty text is the end id alone.  Null doc_ids come first.  Repeated ids keep one entry per row (in order of their
text hash), and an id that many rows share spans files; only rows with equal id and text stay in one file.  An empty table
gives one empty file or none, and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import (MANIFEST, MANIFEST_ARROW, by_range, commit, dealt, file_system, fresh_path, range_cuts, range_of,
                                 read_only_columns, slices, stage, worker_state)

MAGIC = b"TMPLANE1"
BLOCK = 1 << 16
SHARD_BYTES = 16 << 20
LEVEL = 3
END_ID = 2
SPECIAL = "<|endoftext|>"
# Entries of a worker's unit cache, half of them the older ones that are dropped next; its size changes no id.
CACHE = 1_000_000
# Letters below this code point are letters in every Unicode version.
LATIN_END = "\u0250"
# ASCII characters that are neither letters, digits nor white space.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


# ---- ids of a text -------------------------------------------------------------------------------------------------

def byte_letters() -> dict[int, int]:
    """Latin-1 code point -> letter that stands for this byte in byte-level vocabularies (printable bytes stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + i for i, b in enumerate(others)}}


class Units(dict):
    """Ids, as bytes, of the stretches of a text between single spaces; filled on demand, bounded.

    In byte-level vocabularies that split at a blank before a word, a space between two non-blank characters is always a
    boundary, and so are the edge between a word and the signs behind it and a single line feed between non-blanks.  A
    text's ids are those of its stretches.  Words and signs go straight to the model; every other stretch goes through the
    whole tokenizer.  ``None`` marks a stretch that touches other white space: its text is encoded whole.
    """

    def __init__(self, tokenizer, lead: str, dtype, bare: Units | None = None) -> None:
        super().__init__()
        self.tokenizer, self.lead, self.dtype = tokenizer, lead, dtype
        self.model, self.letters = tokenizer.model, byte_letters()
        self.blank, self.code = chr(self.letters[32]), "H" if dtype.itemsize == 2 else "I"
        self.bare = self if bare is None else bare
        self.older: dict[str, bytes | None] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a text that the tokenizer does not cut before its model."""
        if text.isalpha() and text.isascii():
            letters = text
        elif text[0] == " " and text[1:].isalpha() and text.isascii():
            letters = self.blank + text[1:]
        else:
            letters = text.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, unit: str) -> bytes | None:
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        found = self.older.get(unit)
        if found is None:
            if unit.isalpha():
                found = self.piece(self.lead + unit) if unit.isascii() or max(unit) < LATIN_END else self.encode(self.lead + unit)
            elif unit and not unit[0].isspace() and not unit[-1].isspace():
                found = self.cut(unit)
        self[unit] = found
        return found

    def cut(self, unit: str) -> bytes:
        word = unit.rstrip(SIGNS)
        if word.isalpha():
            return self[word] + self.bare[unit[len(word):]]
        if not word:
            return self.piece(self.lead + unit)
        lines = unit.split("\n")
        if len(lines) > 1 and all(part and not part[0].isspace() and not part[-1].isspace() for part in lines):
            return b"".join([self[lines[0]], *(part for line in lines[1:] for part in (self.line_feed, self.bare[line]))])
        return self.encode(self.lead + unit)

    @cached_property
    def line_feed(self) -> bytes:
        return self.piece("\n")


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.by_units = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and kind["model"]["type"] == "BPE" and not kind.get("normalizer") and not kind["model"].get("dropout"))
        self.first = Units(self.tokenizer, "", self.dtype)
        self.rest = Units(self.tokenizer, " ", self.dtype, self.first)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_units and SPECIAL not in text:
            units = text.split(" ")
            head = self.first[units[0]]
            del units[0]
            with suppress(TypeError):  # a stretch without ids of its own
                return head + b"".join(map(self.rest.__getitem__, units))
        return self.first.encode(text)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it and its cache live as long as the worker."""
    found = worker_state().setdefault("encoders", {})
    if path not in found:
        found[path] = Encoder(path)
    return found[path]


# ---- the file format -----------------------------------------------------------------------------------------------

def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Planes of a block, least significant first."""
    width = ids.dtype.itemsize
    table = ids.view(np.uint8).reshape(-1, width).T
    if planes == "byte":
        return [np.ascontiguousarray(row).tobytes() for row in table]
    return [np.packbits((row >> bit) & 1, bitorder="little").tobytes() for row in table for bit in range(8)]


def from_planes(parts: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    out = np.zeros((n, width), np.uint8)
    for k, part in enumerate(parts):
        raw = np.frombuffer(part, np.uint8)
        if planes == "byte":
            out[:, k] = raw
        else:
            out[:, k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (k % 8)
    return out.reshape(-1).view(f"<u{width}")


class Writer:
    """Writes one file; holds one block of ids, and the document table of its range."""

    def __init__(self, stream, dtype: np.dtype, planes: str, block: int) -> None:
        import zstandard
        self.stream, self.dtype, self.planes, self.block = stream, dtype, planes, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.hash, self.at, self.n_ids = hashlib.sha256(), 0, 0
        self.chunks, self.pending, self.held = [], [], 0
        self.doc_ids, self.counts = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // self.dtype.itemsize)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block * self.dtype.itemsize:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        data, size = b"".join(self.pending), self.block * self.dtype.itemsize
        stop = len(data) if last else len(data) - len(data) % size
        for begin in range(0, stop, size):
            raw = data[begin:min(begin + size, stop)]
            parts = [self.zip.compress(p) for p in to_planes(np.frombuffer(raw, self.dtype), self.planes)]
            self.chunks.append([self.at, len(raw) // self.dtype.itemsize, zlib.crc32(raw), [len(p) for p in parts]])
            self._put(b"".join(parts))
            self.n_ids += len(raw) // self.dtype.itemsize
        self.pending = [data[stop:]] if stop < len(data) else []
        self.held = len(data) - stop

    def close(self) -> None:
        self._blocks(last=True)
        null = bytes(d is None for d in self.doc_ids)
        table = self.zip.compress(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + null)
        documents = [self.at, len(table), len(self.doc_ids)]
        self._put(table)
        index = self.zip.compress(json.dumps({"width": self.dtype.itemsize, "planes": self.planes, "block": self.block,
                                              "chunks": self.chunks, "documents": documents, "n_ids": self.n_ids}).encode())
        begin = self.at
        self._put(index)
        self._put(struct.pack("<QI", begin, len(index)) + MAGIC)


class Reader:
    """Reads a file by its chunk index; ``ids(a, b)`` decodes only the chunks that hold ids ``a`` to ``b - 1``."""

    def __init__(self, stream, size: int) -> None:
        import zstandard
        self.stream, self.zip = stream, zstandard.ZstdDecompressor()
        tail = self._read(size - 20, 20)
        begin, length = struct.unpack("<QI", tail[:12])
        if tail[12:] != MAGIC:
            raise ValueError("not a token file")
        self.index = json.loads(self.zip.decompress(self._read(begin, length)))
        self.firsts = np.cumsum([0, *(c[1] for c in self.index["chunks"])])
        self._last: tuple[int, np.ndarray | None] = (-1, None)

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        at, length, n = self.index["documents"]
        raw = self.zip.decompress(self._read(at, length)) if n else b""
        ids, counts, null = np.frombuffer(raw[:8 * n], "<i8"), np.frombuffer(raw[8 * n:12 * n], "<u4"), raw[12 * n:]
        return [None if empty else i for i, empty in zip(ids.tolist(), null, strict=True)], counts.astype(np.int64)

    def chunk(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            at, n, crc, sizes = self.index["chunks"][k]
            raw = io.BytesIO(self._read(at, sum(sizes)))
            ids = from_planes([self.zip.decompress(raw.read(s)) for s in sizes], n, self.index["width"], self.index["planes"])
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"chunk {k} is damaged")
            self._last = (k, ids)
        return self._last[1]

    def ids(self, a: int, b: int) -> Iterator[np.ndarray]:
        k = int(np.searchsorted(self.firsts, a, "right")) - 1
        while a < b:
            first = int(self.firsts[k])
            part = self.chunk(k)[a - first:b - first]
            yield part
            a, k = a + len(part), k + 1


# ---- Spark jobs ----------------------------------------------------------------------------------------------------

def write(documents: DataFrame, tokenizer: str, *, end_id: int = END_ID, planes: str = "byte", block: int = BLOCK,
          shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode every text, in ascending doc_id order, to token files; returns the folder and the manifest."""
    folder = folder or fresh_path(documents.sparkSession, "token-files")
    rows = read_only_columns(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    sizes = stage(rows.select("doc_id", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("bytes")), "token-sizes")
    cuts = range_cuts(sizes, "doc_id", "bytes", shard_bytes, "tie")
    ranged = by_range(rows.withColumn("shard", range_of(F.col("doc_id"), cuts, F.col("tie"))),
                      "shard", cuts, "doc_id", "tie").select("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        fs, root = file_system(folder)
        shard = writer = stream = temp = None

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "piece": 0, "temp": temp, "name": f"tokens-{shard:05d}.tmp1", "records": len(writer.counts),
                "items": writer.n_ids, "bytes": writer.at, "sha256": writer.hash.hexdigest()}], schema=MANIFEST_ARROW)

        for batch in slices(batches):
            for s, d, text in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "text")), strict=True):
                if s != shard:
                    if writer:
                        yield finish()
                    shard, temp = s, f"_temporary-{s:05d}-{uuid.uuid4().hex}"
                    fs.create_dir(root)
                    stream = fs.open_output_stream(f"{root}/{temp}")
                    writer = Writer(stream, encode.dtype, planes, block)
                writer.add(d, encode(text) + end)
        if writer:
            yield finish()

    return folder, commit(ranged.mapInArrow(run, MANIFEST), folder, "token-files")


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files; ``start`` counts the ids of all before."""
    # One row per file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = dealt(stage(manifest.select("name", "bytes", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("start")), "token-starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, size, start in zip(*(batch[c].to_pylist() for c in ("name", "bytes", "start")), strict=True):
                with fs.open_input_file(f"{root}/{name}") as stream:
                    reader = Reader(stream, size)
                    ids, counts = reader.documents()
                    ends = np.cumsum(counts)
                    crcs = []
                    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                        crc = 0
                        for part in reader.ids(a, b):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(ends - counts + start), pa.array(counts), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
