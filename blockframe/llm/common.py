"""Helpers shared by the text operators: splitting, memoised encoding, scratch tables."""

from __future__ import annotations

import contextlib
import itertools
import os
import uuid
import weakref
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: bytes of [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Python workers hold little: large freed arrays go back to the system (smaller ones don't, as fetching their pages anew costs a third of the time), and one thread computes
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "TOKENIZERS_PARALLELISM": "false"}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when it lies beside them and is not installed."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local one only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='blockframe-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/blockframe-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within leave no shuffle files: these go as soon as a table is complete, not when the driver happens to collect its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    path = scratch(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


#: paths of tables that written() has made
_written: dict[int, str] = {}


def discard(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing will read again."""
    path = _written.get(id(df))
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, for sizing shards and partitions by the data."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the n + 1 offsets of its elements (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


class Words:
    """Words of a batch of texts: data[starts[i]:ends[i]] is word i; first[d]:first[d+1] are those of text d."""

    def __init__(self, texts: pa.Array, space: np.ndarray = SPACE, lower: bool = False):
        data, offs = raw(texts)
        if lower:
            data = LOWER[data]
        keep = ~space[data]
        begin = keep.copy()
        begin[1:] &= ~keep[:-1]
        inner = offs[:-1][offs[:-1] < len(data)]
        begin[inner] = keep[inner]
        self.starts = np.flatnonzero(begin)
        at = np.flatnonzero(begin[keep])
        #: the words' bytes without what lies between them
        self.packed = data[keep]
        self.offsets = np.append(at, len(self.packed))
        self.ends = self.starts + np.diff(self.offsets)
        self.first = np.searchsorted(self.starts, offs)
        self.data, self.text_offsets = data, offs
        self.n = len(self.starts)

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.packed)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Word codes, and the distinct words that they number."""
        d = self.array().dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte of data over each text."""
        return sums(flags, self.text_offsets)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that rows `index` of a ragged array take, one after another, and the offsets of the result."""
    lengths = offsets[index + 1] - offsets[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return np.repeat(offsets[index] - out[:-1], lengths) + np.arange(out[-1]), out


def starts(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The distinct values of a sorted array, and where the run of each begins, with the end."""
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[cut], [*cut.tolist(), len(values)]


class Memo:
    """Ids of distinct words by an encoder that is run once for each word that it has not met lately.

    At most `bound` words are remembered; beyond it the memory starts anew, which
    costs time and changes no result."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bound: int = 1_000_000):
        self.encode, self.bound = encode, bound
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.offsets = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def find(self, words: pa.Array) -> np.ndarray:
        """Row of each of some distinct words in self.ids / self.offsets, which hold until the next call."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count and len(self.words) + at.null_count > self.bound:
            self.clear()
            at = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        row = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            row[new] = len(self.words) + np.arange(len(new))
            ids, lengths = [self.ids], []
            for i in range(0, len(new), 50_000):
                part = words.take(pa.array(new[i : i + 50_000]))
                got = self.encode([x.decode("utf-8", "replace") for x in part.to_pylist()])
                lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
                ids.append(np.fromiter(itertools.chain.from_iterable(got), np.int32, int(lengths[-1].sum())))
                self.words = pa.concat_arrays([self.words, part])
            self.ids = np.concatenate(ids)
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(lengths))])
        return row


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each holds about `most` bytes of a column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def hot_join(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """big (of so many rows) with small's columns, where their key is equal. small has a key once, with `n`: in how many rows of big it is, at most.

    Keys that more than a thousandth of big's rows have are sent to all tasks, so that none gathers the rows of one;
    there are at most 1,000 of them. The others meet by a join on the key."""
    most = max(100, rows // 1000)
    hot, cold = F.broadcast(small.where(F.col("n") > most).drop("n")), small.where(F.col("n") <= most).drop("n")
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key))


def packed(b: pa.RecordBatch) -> bytes:
    """A batch as one compressed value, for moving many small rows as one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as f:
        return f.read_next_batch()


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file, in `folder` or where the installed vocabulary package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
