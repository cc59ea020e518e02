"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with whole documents' ids (little-endian, 16 bits where the vocabulary
allows, else 32), then a skippable frame with the index of documents, then the seek table: a skippable frame with each
frame's packed size, plain size and the low 32 bits of its XXH64, as in the public seekable format. ``zstd -d`` gives the
plain ids; readers fetch the tail, look a document up and decompress its frame alone.
"""

from __future__ import annotations

import array
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, resolve, shared_folder, store

FRAME_BYTES = 256 << 10
FILE_BYTES = 128 << 20
#: A file has so many documents at most: their index is held until it is closed.
FILE_DOCS = 1 << 20
CACHE_PARTS = 1_000_000
# Fixed values of the public zstandard formats.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
# The public pattern of byte-level tokenizers, with letters and digits in one run: the tokenizer divides those itself.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W_]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\u024f]")
# The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

MANIFEST = "part long, file string, first_id long, last_id long, n_docs long, n_ids long"


class Encoder:
    """Ids of whole texts, as the tokenizer gives them, with each distinct part encoded once.

    A byte-level tokenizer never joins what its pattern divides, so a text's ids are those of its parts, and the tokenizer
    sees a part but once. A worker keeps its encoder from task to task; a full cache keeps what it has, which is mostly what
    is frequent. Texts beyond the Latin blocks, where character classes differ between libraries, are encoded whole, as are
    texts that hold an added token, which gives its own id, and all texts with other kinds of tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        told = json.loads(self.tokenizer.to_str())
        self.by_part = not told["normalizer"] and (told["pre_tokenizer"] or {}).get("type") == "ByteLevel" and told["pre_tokenizer"]["use_regex"] and not told["pre_tokenizer"]["add_prefix_space"]
        added = [re.escape(x["content"]) for x in told["added_tokens"] if x["content"]]
        self.not_by_part = re.compile("|".join([_NOT_LATIN.pattern, *added]))
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts. A run of letters is one word of the byte-level model, which is asked for it directly."""
        out, rest, words = {}, [], self.tokenizer.model
        for x in parts:
            if x.isalpha() or x[:1] == " " and x[1:].isalpha():
                out[x] = array.array(self.code, [t.id for t in words.tokenize(x.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
            else:
                rest.append(x)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            out |= zip(some, self._whole(some), strict=True)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_PARTS.findall(t) if self.by_part and not self.not_by_part.search(t) else None for t in texts]
        new: set[str] = set()
        for parts in split:
            if parts:
                new.update(parts)
        fresh = self._ids([x for x in new if x not in self.parts])
        self.parts |= fresh
        find = self.parts.__getitem__
        out = [b"".join(map(find, parts)) if parts is not None else self._whole([text])[0] for parts, text in zip(split, texts, strict=True)]
        if len(self.parts) > CACHE_PARTS:
            for x in fresh:
                del self.parts[x]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Bytes of one file; documents go in one by one."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.frames, self.docs, self.pending, self.size, self.packed = dtype, [], [], [], 0, 0
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> bytes:
        """Take a document; returns a finished frame, or nothing yet."""
        self.docs.append((doc_id, len(self.frames), self.size // self.dtype.itemsize, len(ids) // self.dtype.itemsize))
        self.pending.append(ids)
        self.size += len(ids)
        return self.flush() if self.size >= FRAME_BYTES else b""

    def flush(self) -> bytes:
        if not self.size:
            return b""
        plain = b"".join(self.pending)
        packed = self.compressor.compress(plain)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.size = [], 0
        self.packed += len(packed)
        return packed

    def tail(self) -> bytes:
        ids = np.array([d or 0 for d, *_ in self.docs], "<i8")
        known = np.array([d is not None for d, *_ in self.docs], "u1")
        rest = [np.array([d[k] for d in self.docs], "<u8") for k in (1, 2, 3)]
        head = struct.pack("<BQ", self.dtype.itemsize, len(self.docs))
        index = self.compressor.compress(b"".join([head, ids.tobytes(), known.tobytes(), *(r.tobytes() for r in rest)]))
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        entries = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)])
        table = entries + struct.pack("<IBI", len(self.frames) + 1, CHECKSUMS, FOOTER_MAGIC)
        return index + struct.pack("<II", SEEK_MAGIC, len(table)) + table


class Reader:
    """A file by URI; opens it, reads its tail, and then only the frames that are asked for."""

    def __init__(self, uri: str):
        fs, path = resolve(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * frames, end - 9 - 12 * frames), "<u4").reshape(-1, 3)
        self.packed, self.plain, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(self.file.read_at(int(self.packed[-1]) - 8, int(self.at[-2]) + 8))
        width, n = struct.unpack_from("<BQ", raw)
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(raw, "<i8", n, 9)
        self.known = np.frombuffer(raw, "u1", n, 9 + 8 * n).astype(bool)
        self.frame, self.offset, self.count = (np.frombuffer(raw, "<u8", n, 9 + 9 * n + 8 * n * k).astype(np.int64) for k in range(3))

    def plain_frame(self, k: int) -> np.ndarray:
        data = self.unpack.decompress(self.file.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.plain[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, self.dtype)

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids) in file order; of wanted ids only, if given."""
        before = np.concatenate(([0], np.cumsum(self.count)))
        rows = range(len(self.ids)) if wanted is None else np.flatnonzero(np.isin(self.ids, list(wanted)) & self.known)
        have, frame = -1, None
        for i in rows:
            if have != self.frame[i]:
                have = int(self.frame[i])
                frame = self.plain_frame(have)
            yield (int(self.ids[i]) if self.known[i] else None), int(before[i]), frame[self.offset[i] : self.offset[i] + self.count[i]]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode the texts of docs (doc_id, text, ...), append end_id to each and write them in ascending doc_id order.

    Returns the manifest: part, file, first_id, last_id, n_docs, n_ids, and base, the ids of all files before. Ranges of
    ids are dealt to tasks and sorted there; a task rolls its file over at file_bytes. Files whose attempt isn't in the
    manifest don't count.

    Null text is empty text: its document is end_id alone. Null ids come first. Rows with one id stay together, in order
    of a hash of their text. An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark) + "/tokens"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], encoder.dtype).tobytes()
        out = writer = name = None

        def close() -> pa.RecordBatch:
            out.write(writer.flush())
            out.write(writer.tail())
            out.close()
            ids = [d[0] for d in writer.docs]
            row = {"part": (part << 32) + done, "file": name, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(ids), "n_ids": sum(d[3] for d in writer.docs)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            for at in range(0, len(ids), 256):
                for doc_id, data in zip(ids[at : at + 256], encoder.encode(column[at : at + 256].to_pylist()), strict=True):
                    if out is None:
                        name = f"{folder}/{part:06d}-{done:05d}-{uuid.uuid4().hex}.ids.zst"
                        fs, path = resolve(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out, writer = fs.open_output_stream(path, compression=None), Writer(encoder.dtype)
                    if frame := writer.add(doc_id, data + end):
                        out.write(frame)
                    if writer.packed >= file_bytes or len(writer.docs) >= FILE_DOCS:
                        yield close()
                        out, done = None, done + 1
        if out is not None:
            yield close()

    schema = pa.schema([("part", pa.int64()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = store(ordered.mapInArrow(write, MANIFEST), "manifest")
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_tokens(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Read the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Only frames that hold doc_ids are decompressed where those are given; files whose range holds none are not opened.
    """
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        low, high = min(wanted, default=0), max(wanted, default=-1)
        manifest = manifest.filter((F.coalesce("first_id", F.lit(low)) <= high) & (F.coalesce("last_id", F.lit(high)) >= low))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows: list[tuple] = []
                held = 0
                for doc_id, before, ids in Reader(row["file"]).documents(wanted):
                    rows.append((doc_id, row["base"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    held += len(ids)
                    if len(rows) == 4096 or held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(schema)], schema.types, strict=True)], schema=schema)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = manifest.select("file", "base").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(read, shape)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs in the file format and read the files back; see write_tokens and read_tokens."""
    return read_tokens(write_tokens(docs, tokenizer, end_id))
