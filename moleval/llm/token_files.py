"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending order of ids: one frame per document
(several for one of more than ``FRAME_IDS`` ids), each frame the document's ids as
little-endian unsigned 32-bit integers.  Two skippable frames follow: the
documents (ids, nulls, numbers of ids), and the seek table of the public
zstandard seekable format (compressed size, plain size and XXH64 checksum of
every frame), so a plain zstandard reader can read a whole file and
:func:`directory` and :func:`fetch` read and decompress the frames of the wanted
documents alone.

Spark range-partitions the documents by id, and a task encodes and writes one
file; the list of files is a Parquet table, whose commit makes the files visible
(a failed or repeated task leaves files that no list names).

Null and empty texts have the end id alone; null ids come first; documents of
one id stand in order of their texts' hash; an empty table gives an empty list
of files.  A frame that does not match its checksum fails the read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moleval.llm.words import _offsets, blocks
from moleval.session import checkpoint_dir

FRAME_IDS = 1 << 22             # ids of one frame at most
CACHED = 1 << 19                # chunks of text whose ids a worker remembers, and those of one block
ENCODED = 1 << 13               # chunks encoded by one call
OUT_BYTES = 4 << 20             # ids of one Arrow batch when files are read
# --- fixed values of the zstandard seekable format ---
SKIPPABLE_DOCUMENTS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
# --- end of fixed values ---
FOOTER = struct.Struct("<IBI")  # frames, flags, magic
FILE_SCHEMA = "part int, name string, n_docs bigint, n_ids bigint"
DIRECTORY_SCHEMA = "doc_id bigint, name string, start bigint, n_ids bigint, offset bigint, sizes array<bigint>, checksums array<bigint>"

# bytes after a space that are no white space for certain: visible ASCII, and leads of two-byte characters from U+00C0 on
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE0] = True
_LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True
_OTHER = _VISIBLE & ~_LETTER & ~_DIGIT
_OTHER[0x7F:] = False


class Encoder:
    """Ids of texts by a file of the tokenizers library, every distinct chunk encoded once.

    A byte-level pre-tokenizer starts a token at every space that a visible
    character follows (the rest of a run of white space is a token before it), and
    between a letter and a digit or other sign, and a digit and a letter or other
    sign.  A text may be cut there and its chunks encoded alone.  Texts that hold an
    added token's string, and tokenizers of another kind, are encoded uncut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"          # Spark runs a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.cuts = (made["normalizer"] is None and made["post_processor"] is None and made["truncation"] is None and made["padding"] is None
                     and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}                         # chunk -> its place in the lists below
        self.first, self.flat, self.again = np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(0, bool)

    def _make_room(self) -> None:
        """Keep the chunks that were met in several blocks."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > CACHED:
            return self._forget()
        chunks, size = list(self.known), np.diff(self.first)[keep]
        self.known = {chunks[i]: n for n, i in enumerate(keep.tolist())}
        self.flat = self.flat[_ranges(self.first[keep], size)]
        self.first, self.again = np.concatenate(([0], np.cumsum(size))), np.zeros(len(keep), bool)

    def _begins(self, texts: pa.Array, off: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """First bytes of the chunks; a text begins one."""
        cut = np.zeros(len(buf) + 1, bool)
        if self.cuts and len(buf) > 1:
            cut[:len(buf) - 1] = (buf[:-1] == 32) & _VISIBLE[buf[1:]]
            cut[off[1:] - 1] = False                            # a text's last character is followed by nothing
            letter, digit, other = _LETTER[buf], _DIGIT[buf], _OTHER[buf]
            letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)     # U+00C0 to U+00FF but for two signs
            cut[1:-1] |= (letter[:-1] & (digit[1:] | other[1:])) | (digit[:-1] & (_LETTER[buf[1:]] | other[1:]))
            for content in self.added:
                for i in np.flatnonzero(pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)):
                    cut[off[i]:off[i + 1]] = False
        cut[off] = True
        return np.flatnonzero(cut[:-1])

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Place of every chunk in ``first``/``flat``; unknown ones are encoded, as one list, and added."""
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(self.known) > CACHED:
            self._make_room()
            return self._places(chunks)
        self.again[at[at >= 0]] = True
        if not len(new):
            return at
        at[new] = len(self.first) - 1 + np.arange(len(new))
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        lists = [[chunks[i] for i in new[a:a + ENCODED]] for a in range(0, len(new), ENCODED)]
        parts, sizes = [self.flat], []
        for part in lists:
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(e.ids, "<u4"))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
            self.known.update(zip(part, range(len(self.known), len(self.known) + len(part))))
        self.flat = np.concatenate(parts)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of text i are ``ids[first[i]:first[i + 1]]``."""
        off, buf = _offsets(texts)
        begin = self._begins(texts, off, buf)
        if not len(begin):
            return np.zeros(len(off), np.int64), np.zeros(0, "<u4")
        bounds = np.append(begin, len(buf)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        place = self._places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        begin_ids = self.first[place]
        many = self.first[place + 1] - begin_ids
        upto = np.concatenate(([0], np.cumsum(many)))
        ids = self.flat[_ranges(begin_ids, many)]
        return upto[np.searchsorted(begin, off)], ids


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i]`` to ``begin[i] + size[i]`` of every i, one after the other."""
    upto = np.concatenate(([0], np.cumsum(size)))
    short = np.int32 if max(upto[-1], begin.max(initial=0)) < 1 << 30 else np.int64
    return np.repeat((begin - upto[:-1]).astype(short), size) + np.arange(upto[-1], dtype=short)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """One file of documents; ``close`` writes the documents and the seek table."""

    def __init__(self, folder: str, name: str, frame_ids: int = FRAME_IDS):
        fs, path = _place(folder)
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{name}", compression=None)
        self.frame_ids, self.packer = frame_ids, zstandard.ZstdCompressor(level=1)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for a in range(0, max(len(ids), 1), self.frame_ids):
            plain = ids[a:a + self.frame_ids].astype("<u4", copy=False).tobytes()
            packed = self.packer.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        ids, null, many = (np.array(c, t) for c, t in zip(zip(*self.docs, strict=True), ("<i8", "u1", "<i8"), strict=True))
        self.out.write(_skippable(SKIPPABLE_DOCUMENTS, struct.pack("<Q", len(ids)) + ids.tobytes() + many.tobytes() + null.tobytes()))
        self.out.write(_skippable(SKIPPABLE_SEEK_TABLE, np.array(self.frames, "<u4").tobytes() + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)))
        self.out.close()
        return len(ids), int(many.sum())


class FrameFile:
    """A written file, opened for single frames."""

    def __init__(self, folder: str, name: str):
        fs, path = _place(folder)
        self.name, self.file = name, fs.open_input_file(f"{path}/{name}")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(document ids, numbers of ids, frames as rows of compressed size, plain size, checksum) from the end of the file."""
        end = self.file.size()
        frames, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{self.name} has no seek table")
        table = np.frombuffer(self._at(end - FOOTER.size - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        offset = int(table[:, 0].astype(np.int64).sum())
        _, size = struct.unpack("<II", self._at(offset, 8))
        body = self._at(offset + 8, size)
        n = struct.unpack_from("<Q", body)[0]
        ids, many, null = np.frombuffer(body, "<i8", n, 8), np.frombuffer(body, "<i8", n, 8 + 8 * n), np.frombuffer(body, "u1", n, 8 + 16 * n)
        return pa.array(ids, mask=null.astype(bool)), many, table

    def ids(self, offset: int, sizes: Iterable[int], checksums: Iterable[int]) -> bytes:
        """Ids of the document whose frames begin at ``offset``."""
        out = []
        for size, want in zip(sizes, checksums, strict=True):
            plain = zstandard.ZstdDecompressor().decompress(self._at(offset, size))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != want:
                raise ValueError(f"{self.name}: the frame at {offset} does not match its checksum")
            out.append(plain)
            offset += size
        return b"".join(out)


def fresh_folder(spark: SparkSession, name: str = "tokens") -> str:
    """A new folder in the shared checkpoint folder, with the scheme of its store."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text",
          frame_ids: int = FRAME_IDS) -> None:
    """Encode ``text`` by the file ``tokenizer`` (on every machine) and write the ids, with ``end_id`` after each document, below ``folder``."""
    d = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("text"))
    keys = ["i", F.xxhash64("text")]
    # one id, or one text, may hold many rows: a third key deals them out
    ranged = d.repartitionByRange(*keys, F.rand(17)).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([] if end_id is None else [end_id], "<u4")
        part = TaskContext.get().partitionId()
        name, out = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst", None
        for b in blocks(batches, "text"):
            out = out or FrameWriter(folder, name, frame_ids)
            first, ids = _encoder(tokenizer).encode(b.column(1))
            for k, i in enumerate(b.column(0).to_pylist()):
                out.add(i, np.concatenate((ids[first[k]:first[k + 1]], end)))
        if out:
            docs_, ids_ = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([docs_]), pa.array([ids_])], ["part", "name", "n_docs", "n_ids"])

    ranged.mapInArrow(encode, FILE_SCHEMA).write.parquet(f"{folder}/_files")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document: id, file, ids of all documents before it, number of ids, and its frames.  Reads the tables at the files' ends only."""
    files = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/_files")
    n = max(1, files.count())
    # one row per file
    placed = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).select("name", "base").repartition(n, "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, many, frames = FrameFile(folder, name).tables()
                # frames of a document: their plain sizes add up to its ids
                plain, packed = np.concatenate(([0], np.cumsum(frames[:, 1].astype(np.int64)))), np.concatenate(([0], np.cumsum(frames[:, 0].astype(np.int64))))
                start = np.cumsum(many) - many
                if (many > 0).all():
                    first = np.searchsorted(plain, 4 * np.append(start, many.sum()))
                else:                                           # a document without ids still has a frame
                    first = np.arange(len(many) + 1) if len(frames) == len(many) else _first_frames(many, frames[:, 1] // 4)
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(frames[:, c].astype(np.int64))) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids), pa.string()), pa.array(base + start), pa.array(many),
                                                  pa.array(packed[first[:-1]]), *lists], ["doc_id", "name", "start", "n_ids", "offset", "sizes", "checksums"])

    return placed.mapInArrow(read, DIRECTORY_SCHEMA)


def _first_frames(many: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """First frame of each document (and the end), walking both lists."""
    first, at = [0], 0
    for m in many.tolist():
        left = m
        while True:
            left -= int(ids[at])
            at += 1
            if left <= 0:
                break
        first.append(at)
    return np.array(first)


def fetch(wanted: DataFrame, folder: str) -> DataFrame:
    """The ids (binary) of rows of a :func:`directory`; only their frames are read and decompressed."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: FrameFile | None = None
        for b in batches:
            rows, size = [], 0
            for r in b.to_pylist():
                if opened is None or opened.name != r["name"]:
                    opened = FrameFile(folder, r["name"])
                ids = opened.ids(r["offset"], r["sizes"], r["checksums"])
                rows.append((r["doc_id"], r["start"], ids))
                size += len(ids)
                if size >= OUT_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return wanted.select("doc_id", "name", "start", "offset", "sizes", "checksums").mapInArrow(read, "doc_id bigint, start bigint, ids binary")


def _batch(rows: list) -> pa.RecordBatch:
    cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["doc_id", "start", "ids"])
