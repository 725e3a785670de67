"""What the operators of this subpackage share: scratch tables, Arrow text access, folds.

Scratch tables are written under ``spark.checkpoint.dir``, which the whole cluster sees, so a lost
executor costs a re-read and never a result.  Only a session on one machine may name no such folder:
a local one is made and set.  `dropped` deletes scratch tables that nothing will read any more.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: What counts as white space between words, and so what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in slices of about so many bytes, whatever the batch size of the session.
SLICE_BYTES = 3 << 20
#: The same for work that takes tens of bytes of memory a byte of text: a worker's peak is little above what it holds anyway.
FINE_BYTES = 512 << 10
#: Bytes of an Arrow batch between Spark and a worker.
BATCH_BYTES = 6 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded(spark: SparkSession) -> None:
    """Holds Arrow batches to about BATCH_BYTES, unless the session has its own bound: long texts would make them large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's own default
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The frame as a table in the shared folder, read back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a frame of `written`; frames derived from it can't be computed any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that clash with no column of the frame, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system and path of a Hadoop-style URI (``file:/x`` and plain paths too)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def publish(fs: pafs.FileSystem, path: str, write) -> None:
    """Calls write(stream) on a file of its own, then renames it: a retried task replaces, never appends."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0))


def _give_back() -> None:
    """Returns to the system what a worker's earlier task has freed: workers are used again."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, whose worker gives back at its end what it has freed: it stays, idle, while other stages run. `slices` does so by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each holds about `most` bytes; one text is never cut."""
    _give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    _give_back()


def strings(col: pa.Array) -> list[str]:
    """Texts as a list, null as empty."""
    return pc.fill_null(col, "").to_pylist()


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows (rows + 1); null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length of each row, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between consecutive offsets, empty ranges 0."""
    total = np.zeros((len(at) - 1, *x.shape[1:]), np.result_type(x.dtype, np.int64) if x.dtype.kind in "biu" else np.float64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        total[full] = np.add.reduceat(x, at[full], axis=0, dtype=total.dtype)
    return total


def list_array(flat: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, kind))


def binary_array(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of bytes out of one byte array and its offsets."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def bit_map(values: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^bits bits over the low bits of a long column v; 2^(bits - 6) rows at most reach the driver."""
    word = F.col("v").bitwiseAND((1 << (bits - 6)) - 1)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(v, {bits - 6}) & 63 AS INT))")
    got = values.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def in_map(found: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether each value's bit is set: always, if it was among the values."""
    v = v.astype(np.int64)
    bit = v >> (len(found).bit_length() - 1) & 63
    return (found[v & (len(found) - 1)] >> bit.astype(np.uint64) & np.uint64(1)).astype(bool)


def kept(docs: DataFrame, text_col: str, test, extra: dict[str, Column] | None = None) -> DataFrame:
    """The rows of docs whose slice test(batch, text column, extra columns...) marks; columns as before.

    extra: columns computed for the test, under names that clash with none.
    """
    bounded(docs.sparkSession)
    names = docs.columns
    added = fresh(docs, *(f"kept_{i}" for i in range(len(extra or {}))))
    for name, column in zip(added, (extra or {}).values(), strict=True):
        docs = docs.withColumn(name, column)
    schema = docs.select(*names).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, FINE_BYTES):
            mark = test(b.column(text_col), *[b.column(n) for n in added])
            yield b.select(names).filter(pa.array(mark))

    return docs.mapInArrow(work, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
