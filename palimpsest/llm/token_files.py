"""Token-ID files: one zstandard frame a document, a trailing seek table with a checksum a frame.

A file is a series of frames that any zstandard decoder reads, and two skippable frames that it passes over:

    frame of document 0, frame of document 1, ..., skippable frame with the document ids, skippable frame with the seek table

The seek table is that of the public "zstd seekable format": for each frame its compressed size, its decompressed size and
the low 32 bits of the xxh64 of its content (little-endian u32 each); then the number of frames (u32), a descriptor byte
(0x80: there are checksums) and the magic 0x8F92EAB1. A frame's content is the document's ids as little-endian u32. So a
reader loads the table, and then reads and decompresses only the frames of the documents that it was asked for.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, in_short_batches, missing, shared_path, small
from palimpsest.llm.hashing import of_spans, pieces

SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Words whose ids a worker keeps: 1 << 19 take about 30 MB.
CACHE_WORDS = 1 << 19
#: Bytes of words, so that a few very long ones don't fill the memory.
CACHE_BYTES = 1 << 23
#: Slots of the table that finds them.
SLOTS = 1 << 20
#: Bytes of texts that are encoded at once, if no text is longer.
CHUNK = 1 << 18
NO_ID = -(2**63)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*://|file:/", path) else (pafs.LocalFileSystem(), path)


class WordIds:
    """Encodes texts with a byte-level BPE of the tokenizers library, each word but once.

    Such a tokenizer cuts a text into pieces by the kinds of its characters and encodes them apart. Some of these cuts can be
    told from two or three bytes: before a space that follows anything but white space, before a point or comma after an
    ASCII letter, and after a single line break, before ASCII characters other than white space. So a text is cut there, and its ids are those of
    its parts one after the other. Parts are found by a 64-bit hash in a table and compared with what is kept there byte by
    byte; the library encodes those that aren't there, many at once, and the bytes that each id stands for tell where a part ends.

    A special token in a text gets its own id, as the library has it.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            if token.lstrip or token.rstrip or token.single_word or re.search(r"[\s.,]", token.content):
                raise ValueError(f"a cut could fall at the added token {token.content!r}")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # the alphabet has a character for each byte
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.starts, self.sizes, self.begins, self.lengths = (np.zeros(1024, np.int32) for _ in range(4))
        self.pool, self.bytes = np.zeros(4096, np.uint32), np.zeros(4096, np.uint8)
        self.n = self.filled = self.held = self.entered = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each part, -1 if it isn't there."""
        found = np.full(len(hashes), -1, np.int64)
        rest, slot = np.arange(len(hashes)), (hashes >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        while len(rest):
            there = self.keys[slot]
            hit = there == hashes[rest]
            found[rest[hit]] = self.numbers[slot[hit]]
            more = ~hit & (there != 0)
            rest, slot = rest[more], (slot[more] + 1) & (SLOTS - 1)
        return found

    def keep(self, parts: list[bytes]) -> np.ndarray:
        """Encodes new parts and keeps their ids and bytes; returns their numbers."""
        ids, sizes = self.library(parts)
        raw, lengths = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)
        n, k, b = self.n + len(parts), self.filled + len(ids), self.held + len(raw)
        if n > len(self.starts):
            self.starts, self.sizes, self.begins, self.lengths = (_longer(x, n) for x in (self.starts, self.sizes, self.begins, self.lengths))
        self.pool, self.bytes = _longer(self.pool, k), _longer(self.bytes, b)
        self.pool[self.filled : k], self.bytes[self.held : b] = ids, raw
        for at, size, begin, many in ((self.starts, self.sizes, self.filled, sizes), (self.begins, self.lengths, self.held, lengths)):
            size[self.n : n] = many
            at[self.n : n] = begin + np.cumsum(many) - many
        numbers = np.arange(self.n, n)
        self.n, self.filled, self.held = n, k, b
        return numbers

    def enter(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Puts parts into the table, each hash once."""
        self.entered += len(hashes)
        slot = (hashes >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            mine = free & (self.keys[slot] == hashes)
            self.numbers[slot[mine]] = number[mine]
            hashes, number, slot = hashes[~mine], number[~mine], (slot[~mine] + 1) & (SLOTS - 1)

    def others(self, data: np.ndarray, starts: np.ndarray, spans: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Which parts are others than those kept under their numbers, by their bytes."""
        kept = np.repeat(self.begins[numbers] - starts, spans) + np.arange(len(data))
        return np.maximum.reduceat(self.bytes.take(kept, mode="clip") != data, starts) | (self.lengths[numbers] != spans)

    def library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has. Parts that begin with a space and end otherwise go together."""
        together = [k for k, p in enumerate(parts) if p[:1] == b" " and p[1:].isalpha()]
        lone = sorted(set(range(len(parts))) - set(together))
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
        for at in range(0, len(together), 2000):
            some = together[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join([parts[k] for k in some]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, want = np.cumsum(self.bytes_of[ids]), np.cumsum([len(parts[k]) for k in some])
            cuts = np.searchsorted(ends, want) + 1
            if not np.array_equal(ends[cuts - 1], want):
                raise ValueError("the tokenizer joins words")
            for k, x in zip(some, np.split(ids, cuts[:-1]), strict=True):
                found[k] = x
        if lone:
            for k, got in zip(lone, self.tokenizer.encode_batch_fast([parts[k].decode() for k in lone], add_special_tokens=False), strict=True):
                found[k] = np.array(got.ids, np.uint32)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def encode(self, data: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Little-endian u32 ids of texts that lie one after the other; data: UTF-8 bytes, ends: where each ends."""
        if not len(data):
            return [b""] * len(ends)
        if self.n > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        white = WHITE[data]
        if (data >= 0xC2).any():
            white |= wide_white(data)
        before, before2 = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], before2[2:] = white[:-1], white[:-2]
        last = np.zeros(len(data), np.uint8)
        last[1:] = data[:-1]
        cut = (data == 32) & ~before | ((data == 46) | (data == 44)) & LETTER[last] | (last == 10) & ~before2 & ~white & (data < 128)
        first = np.concatenate([[0], ends[:-1]])
        heads = np.zeros(len(data) + 1, bool)
        heads[first] = True
        cut[heads[:-1]] = True
        cut[1:][heads[:-2] & (last[1:] == 10)] = False  # a line break that begins a text has nothing before it
        cut[heads[:-1]] = True
        starts = np.flatnonzero(cut)
        spans = np.diff(np.append(starts, len(data)))
        hashes = of_spans(data, starts)
        numbers = self.find(hashes)
        if (lost := numbers < 0).any():
            new, at, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
            kept = self.keep(_cut_out(data, starts, spans, np.flatnonzero(lost)[at]))
            numbers[lost] = kept[back]
            free = max(0, SLOTS * 3 // 4 - self.entered)  # a text may have more words than there are slots
            self.enter(new[:free], kept[:free])
        if (other := self.others(data, starts, spans, numbers)).any():  # another part has this hash
            numbers[other] = self.keep(_cut_out(data, starts, spans, np.flatnonzero(other)))
        sizes = self.sizes[numbers]
        upto = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[numbers] - upto + sizes, sizes) + np.arange(upto[-1])].astype("<u4", copy=False)
        # ids before each text: those of the parts that begin before it ends
        stop = np.concatenate([[0], upto])[np.searchsorted(starts, ends)].tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * z] for a, z in zip([0, *stop[:-1]], stop, strict=True)]


def _longer(x: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def _cut_out(data: np.ndarray, starts: np.ndarray, spans: np.ndarray, which: np.ndarray) -> list[bytes]:
    raw = memoryview(data)
    return [bytes(raw[a : a + n]) for a, n in zip(starts[which].tolist(), spans[which].tolist(), strict=True)]


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def wide_white(data: np.ndarray) -> np.ndarray:
    """True at the last byte of a white space character beyond ASCII."""
    out = np.zeros(len(data), bool)
    if len(data) > 1:
        out[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    if len(data) > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out[2:] |= general | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return out


_tables: dict[str, WordIds] = {}


def encoder(tokenizer_path: str) -> WordIds:
    """One for each worker process: tasks that follow find the words again."""
    if tokenizer_path not in _tables:
        _tables[tokenizer_path] = WordIds(tokenizer_path)
    return _tables[tokenizer_path]


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents as frames; close() adds the ids and the seek table."""

    def __init__(self, stream, level: int = 1):
        self.stream, self.sizes, self.ids, self.compress = stream, [], [], zstandard.ZstdCompressor(level=level).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.stream.write(frame)
        self.sizes.append((len(frame), len(ids), checksum(ids)))
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        table = np.array(self.sizes, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.sizes), 0x80, SEEKABLE)
        for magic, content in ((SKIPPABLE_IDS, ids), (SKIPPABLE_TABLE, table)):
            self.stream.write(struct.pack("<II", magic, len(content)) + content)


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str):
        fs, at = file_system(path)
        self.stream = fs.open_input_file(at)
        self.stream.seek(self.stream.size() - 9)
        n, descriptor, magic = struct.unpack("<IBI", self.stream.read(9))
        if magic != SEEKABLE or descriptor != 0x80:
            raise ValueError(f"{path}: no seek table")
        self.stream.seek(self.stream.size() - 9 - 12 * n - 8 - 8 * n)
        raw = self.stream.read(8 * n + 8 + 12 * n)
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.sizes = np.frombuffer(raw, "<u4", 3 * n, 8 * n + 8).reshape(n, 3)
        self.ends = np.cumsum(self.sizes[:, 0], dtype=np.int64)
        self.path, self.decompress = path, zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self.doc_ids)

    def frame(self, k: int) -> bytes:
        size, content, check = (int(x) for x in self.sizes[k])
        self.stream.seek(int(self.ends[k]) - size)
        data = self.decompress(self.stream.read(size), max_output_size=content) if content else b""
        if len(data) != content or checksum(data) != check:
            raise ValueError(f"{self.path}: frame {k} is damaged")
        return data

    def read(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this doc_id."""
        lo, hi = np.searchsorted(self.doc_ids, doc_id), np.searchsorted(self.doc_ids, doc_id, "right")
        return [np.frombuffer(self.frame(k), "<u4") for k in range(lo, hi)]


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, *, end_id: int | None = 2, level: int = 1) -> DataFrame:
    """Encodes every text and writes the ids to files in ascending doc_id order; returns (shard, path, n_docs, n_tokens).

    The rows are dealt out by ranges of doc_id, so file k holds what comes before file k + 1. Each task writes one file
    under a name of its own and renames it; a task that is run again, on another executor too, writes the same bytes to
    the same place.

    Null text: as empty, so only the end id. Null doc_id: first in order, one after the other. Rows with the same doc_id
    follow each other in the order of their texts' hashes; each is a document of its own. No rows: no files.
    """
    missing(docs, "doc_id", "text")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    end = b"" if end_id is None else struct.pack("<I", end_id)
    file_system(out)[0].create_dir(file_system(out)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = file_system(out)
        name = f"{root}/shard-{shard:07d}.zst"
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/.{shard}-{uuid.uuid4().hex}"
        n_docs, n_tokens, writer, cache = 0, 0, None, encoder(tokenizer_path)
        stream = None
        for batch in batches:
            if stream is None and batch.num_rows:
                stream = fs.open_output_stream(temporary)
                writer = TokenFileWriter(stream, level)
            doc_ids = batch.column(0).to_pylist()
            for at, to, data, ends in pieces(batch.column(1), CHUNK):
                for doc_id, ids in zip(doc_ids[at:to], cache.encode(data, ends), strict=True):
                    ids += end
                    writer.add(doc_id, ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4
        if stream is not None:
            writer.close()
            stream.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out}/shard-{shard:07d}.zst"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    docs = in_short_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    # with the hash, rows of one doc_id or without one don't all go to one file
    rows = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame, *, frames: int = 5000) -> DataFrame:
    """Every document of the files: doc_id, shard, nth (in its file), start (ids of all documents before it), n_tokens, ids (binary).

    A task reads at most ``frames`` frames of a file at once and skips the rest by the seek table.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    jobs = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    jobs = jobs.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(frames).cast("long"))))
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                file = TokenFile(job["path"])
                starts = job["start"] + np.concatenate([[0], np.cumsum(file.sizes[:, 1] // 4, dtype=np.int64)])
                for at in range(job["first"], min(job["first"] + frames, len(file)), 500):
                    to = min(at + 500, job["first"] + frames, len(file))
                    data = [file.frame(k) for k in range(at, to)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if x == NO_ID else int(x) for x in file.doc_ids[at:to]], pa.int64()),
                        "shard": pa.array([job["shard"]] * (to - at), pa.int64()), "nth": pa.array(range(at, to), pa.int64()),
                        "start": pa.array(starts[at:to]), "n_tokens": pa.array(file.sizes[at:to, 1].astype(np.int64) // 4), "ids": pa.array(data, pa.binary()),
                    })

    return jobs.select("shard", "path", "start", "first").repartition(parts).mapInArrow(read, "doc_id long, shard long, nth long, start long, n_tokens long, ids binary")


def fetch(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The ids of the documents asked for, from the files that may hold them: doc_id, ids. Other frames stay compressed."""
    ids = small(doc_ids.select("doc_id").distinct())
    jobs = manifest.select("path")
    rows = jobs.mapInArrow(_listed, "path string, nth long, doc_id long").join(ids, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, TokenFile] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] not in files:
                    files = {row["path"]: TokenFile(row["path"])}
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([row["doc_id"]], pa.int64()), "ids": pa.array([files[row["path"]].frame(row["nth"])], pa.binary())})

    return rows.select("path", "nth", "doc_id").mapInArrow(read, "doc_id long, ids binary")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file = TokenFile(path)
            yield pa.RecordBatch.from_pydict({"path": [path] * len(file), "nth": pa.array(range(len(file)), pa.int64()), "doc_id": pa.array(file.doc_ids)})


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def encode_to_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 2) -> tuple[str, DataFrame]:
    """Writes to a new folder in the shared one; returns it and the manifest."""
    out = shared_path(spark, "token-ids")
    return out, write_token_files(docs, out, tokenizer_path, end_id=end_id)
