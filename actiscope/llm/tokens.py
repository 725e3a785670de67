"""Token-id output: fixed-width bit packing with block offsets.

Documents are range-partitioned by id; each partition encodes its texts in order and writes one file.  File layout, numbers little-endian:

    magic "BITPACK1" | blocks | footer | footer size (8 bytes) | magic

A block holds BLOCK ids (the last fewer), each in `bits` bits, most significant first; `bits` is the least width that holds the
vocabulary.  The footer has bits, block length, number of ids and documents, then as int64 arrays the document ids, a null mark for each, the
documents' starts (documents + 1) and the blocks' byte offsets.  A reader unpacks any range of ids with numpy from the blocks that cover it.

The tokenizers library encodes distinct stretches of text: a text is cut before a space, tab or newline that follows another character; where all white
space is of those three kinds, the byte-level splitting pattern never joins characters across such a cut, so the ids are those of the whole
text. Texts with other white space, with control characters or with "<|" are encoded in one piece.

Defined cases: a null text is empty; an empty one has the end id only; null ids come first in the order; rows that repeat an id are rows of
their own, in order of a hash of their text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import filesystem, publish, ragged, scratch, slices, sums, table, utf8

MAGIC = b"BITPACK1"
BLOCK = 4096


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, most significant first, zero bits up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    bit = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count).reshape(count, bits)
    return (bit.astype(np.uint32) << np.arange(bits - 1, -1, -1, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Blocks to a stream as ids come, the footer at the end."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.offsets, self.rest = out.write(MAGIC) or len(MAGIC), [], np.zeros(0, np.uint32)
        self.at = len(MAGIC)
        self.docs: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.null.append(null)
        self.lengths.append(lengths)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            self._write(ids[a : a + self.block])
        self.rest = ids[full:]

    def _write(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if len(self.rest):
            self._write(self.rest)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype("<i8")
        docs, starts = join(self.docs), np.r_[0, np.cumsum(join(self.lengths))].astype("<i8")
        foot = struct.pack("<IIQQ", self.bits, self.block, int(starts[-1]), len(docs))
        foot += docs.tobytes() + join(self.null).tobytes() + starts.tobytes() + np.array(self.offsets, "<i8").tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return len(docs), int(starts[-1])


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(max(0, end - 16))
        tail = file.read(16)
        if end < 40 or tail[8:] != MAGIC:
            raise ValueError("not a file of packed ids, or cut off")
        size = struct.unpack("<Q", tail[:8])[0]
        if size > end - 24:
            raise ValueError("the footer is damaged")
        file.seek(end - 16 - size)
        foot = file.read(size)
        self.bits, self.block, self.n_ids, n = struct.unpack_from("<IIQQ", foot)
        body = np.frombuffer(foot, "<i8", offset=24)
        self.docs, self.null, self.starts, self.offsets = body[:n], body[n : 2 * n].astype(bool), body[2 * n : 3 * n + 1], body[3 * n + 1 :]
        if len(self.offsets) != -(-self.n_ids // self.block):
            raise ValueError("the footer is damaged")

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1 of the file."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        count = min(b * self.block, self.n_ids) - a * self.block
        self.file.seek(int(self.offsets[a]))
        if self.block * self.bits % 8:
            raise ValueError("blocks must end on whole bytes")
        return unpack(self.file.read(-(-count * self.bits // 8)), self.bits, count)[first - a * self.block : last - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The stretches that texts (bytes, offsets) are cut into, how many each text has, and which texts are left whole."""
    n = np.diff(at)
    lead = np.r_[data, np.zeros(2, np.uint8)].astype(np.int32)
    one, two, three = lead[:-2], lead[1:-1], lead[2:]
    odd = ((one < 32) & (one != 9) & (one != 10)) | (one == 127) | ((one == 60) & (two == 124))
    wide = ((one == 0xC2) & (two <= 0xA0)) | ((one == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((one == 0xE3) & (two == 0x80) & (three == 0x80)) | ((one == 0xEF) & (two == 0xBB))
    wide |= (one == 0xE2) & (((two == 0x80) & ((three < 0x90) | (three > 0xA7))) | (two == 0x81))
    whole = sums((odd | wide).astype(np.int64), at) > 0
    space = (data == 32) | (data == 9) | (data == 10)
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[np.repeat(whole, n)] = False
    begin[at[:-1][n > 0]] = True
    first = np.flatnonzero(begin)
    stretches = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[first, len(data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return stretches, sums(begin.astype(np.int64), at), whole


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct stretch encoded once while it is remembered."""

    MOST = 1_200_000
    JOIN = 2000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = np.zeros(self.vocabulary, np.int64)  # a byte-level token has a character for each byte
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], alone: set[str]) -> None:
        """Stretches that begin with white space and end without are encoded many in a row and told apart by their tokens' bytes."""
        joint = [w for w in new if w[0] in " \n\t" and w[-1] not in " \n\t" and w not in alone]
        lone = [w for w in new if not (w[0] in " \n\t" and w[-1] not in " \n\t" and w not in alone)]
        flat, sizes = [], []
        for a in range(0, len(joint), self.JOIN):
            part = joint[a : a + self.JOIN]
            ids = self._encode(["".join(part)])[0]
            ends = np.cumsum(self.width[ids])
            wanted = np.cumsum(np.fromiter((len(w.encode()) for w in part), np.int64, len(part)))
            cut = np.searchsorted(ends, wanted)
            if len(ends) and ends[-1] == wanted[-1] and (ends[cut] == wanted).all():
                sizes.append(np.diff(np.r_[-1, cut]))
            else:  # a tokenizer that isn't byte-level
                each = self._encode(part)
                ids, sizes = np.concatenate(each), [*sizes, np.array([len(x) for x in each])]
            flat.append(ids)
        each = self._encode(lone)
        flat += each
        sizes.append(np.array([len(x) for x in each], np.int64))
        size = np.concatenate(sizes).astype(np.int64)
        self.known.update(zip(joint + lone, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(size) - size]
        self.size, self.pool = np.r_[self.size, size], np.concatenate([self.pool, *flat])

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as bytes and offsets, and how many each text has."""
        if len(self.known) > self.MOST:
            self._clear()
        parts, counts, whole = chunks(data, at)
        coded = parts.dictionary_encode()
        words = coded.dictionary.to_pylist()
        raw = data.tobytes()
        alone = {raw[at[i] : at[i + 1]].decode() for i in np.flatnonzero(whole)}
        if new := [w for w in words if w not in self.known]:
            self._learn(new, alone)
        where = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        size = self.size[where]
        edge = np.r_[0, np.cumsum(counts)]
        total = np.r_[0, np.cumsum(size)]
        return self.pool[ragged(self.start[where], size)], total[edge[1:]] - total[edge[:-1]]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker process: tasks that follow each other use what is remembered."""
    return Encoder(path)


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the files into a shared folder; part, path, docs, ids of each, in order of id."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "ids")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches, "text", 4 << 20)
        first = next(batches, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        bits = max(1, (max(encode.vocabulary, end_id + 1) - 1).bit_length())
        store, top = filesystem(folder)
        done = []

        def write(out) -> None:
            w = Writer(out, bits)
            b = first
            while b is not None:
                ids, n = encode(*utf8(b.column("text")))
                ends = np.cumsum(n + 1)
                whole = np.full(int(ends[-1]), end_id, np.uint32)
                whole[ragged(ends - n - 1, n)] = ids
                null = b.column("id").is_null().to_numpy(zero_copy_only=False)
                w.add(b.column("id").fill_null(0).to_numpy(), null.astype(np.int64), whole, n + 1)
                b = next(batches, None)
            done.extend(w.close())

        path = f"part-{part:06d}.ids"
        publish(store, f"{top}/{path}", write)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{path}"]), pa.array(done[:1], pa.int64()), pa.array(done[1:], pa.int64())], ["part", "path", "docs", "ids"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    made = ordered.mapInArrow(work, "part int, path string, docs long, ids long")
    made.write.parquet(f"{folder}/_files")
    return spark.read.schema(made.schema).parquet(f"{folder}/_files")


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, read back from the files that write_ids lists."""
    # One row per file, so this window is small.
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("before", F.coalesce(F.sum("ids").over(w), F.lit(0))).select("path", "before")
    # A stated number of partitions: adaptive execution would join them, as it sees the paths' few bytes and not the files'.
    listed = listed.repartition(max(1, files.count()), F.col("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as file:
                    r = Reader(file)
                    step = np.searchsorted(r.starts, np.arange(0, r.n_ids + (4 << 20), 4 << 20), side="left")
                    for a, z in zip(step[:-1], step[1:], strict=True):
                        if a == z:
                            continue
                        z = min(z, len(r.docs))
                        at = r.starts[a : z + 1]
                        ids = r.ids(int(at[0]), int(at[-1])).astype("<u4")
                        raw, at = memoryview(ids.tobytes()), at - at[0]
                        sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(r.docs[a:z], mask=r.null[a:z]), pa.array(r.starts[a:z] + before), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(work, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))
