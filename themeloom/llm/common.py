"""Shared pieces: scratch tables in the cluster's shared folder, Arrow buffers, vectorised tokenising."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="themeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed where they run, and bounds their batches.

    Texts are long and rows many, so batches go by bytes, unless the session's settings say otherwise.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.sparkContext.getConf().get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive any executor.

    drop() removes one as soon as nothing needs it; what is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.unions = spark, {}, {}
        ready(spark)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/themeloom-{uuid.uuid4().hex}"
        df.write.parquet(path)
        jpath, fs = self._fs(path)
        fs.deleteOnExit(jpath)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(sc._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            parts, _ = self.unions.pop(id(df), ([], None))
            self.drop(*parts)
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                jpath, fs = self._fs(path)
                fs.delete(jpath, True)

    def rounds(self, make: Callable[[int], DataFrame], n: int) -> DataFrame:
        """The union of make(0) to make(n - 1), written one after the other: only one of them has its shuffle files on disk at a time."""
        parts = []
        for i in range(n):
            parts.append(self.write(make(i)))
            self.free()
        out = reduce(DataFrame.union, parts)
        self.unions[id(out)] = (parts, out)
        return out

    def free(self) -> None:
        """Lets go of the shuffle files of plans that have run: Spark deletes them once the JVM has collected what refers to them, which by itself may take as long as
        the job."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int, width: int, limit: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if rows of that width stay under limit bytes; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows * width <= limit else df


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary column; a null is an empty range."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column of equal-width rows of a 2-d array."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.shape[1] * rows.itemsize)
    keep = np.ones(len(flat), bool) if valid is None else valid
    return ragged(flat[keep].reshape(-1), np.where(keep, flat.shape[1], 0), keep)


def ragged(data: np.ndarray, lengths: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column from bytes in a row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    mask = None if valid is None or valid.all() else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def chunks(offsets: np.ndarray, most: int):
    """Ranges of rows that hold about that many bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one kind over 0; a run ends with its row."""
    n = len(kinds)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kinds[at[:-1]] > 0
    return at[:-1][keep], at[1:][keep]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its words of 8 bytes, each mixed with its place, in a sum. Equal hashes prove nothing; see distinct()."""
    lengths = ends - starts
    out = mix(mix(words_at(data, starts, lengths)))
    if len(long := np.flatnonzero(lengths > 8)):
        n = (lengths[long] - 1) // 8  # words after the first
        first = n.cumsum() - n
        k = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n) + 1
        words = words_at(data, np.repeat(starts[long], n) + 8 * k, np.repeat(lengths[long], n) - 8 * k)
        out[long] += np.add.reduceat(mix(mix(words ^ (k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))), first)
    return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def alike_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of data have the very bytes of those of other."""
    out = words_at(data, starts, lengths) == words_at(other, at, lengths)
    if len(rest := np.flatnonzero(out & (lengths > 8))):
        n = lengths[rest] - 8
        same = gather(data, starts[rest] + 8, n) == gather(other, at[rest] + 8, n)
        out[rest] = np.logical_and.reduceat(same, n.cumsum() - n)
    return out


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span of each distinct string of bytes, and the place among them of every span. keys: spans_hash; the bytes are compared, so two strings of
    one hash stay two."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    back = back.reshape(-1)
    rep = first[back]
    same = lengths == lengths[rep]
    at = np.flatnonzero(same & (rep != np.arange(len(rep))))
    same[at] = alike_spans(data, starts[at], data, starts[rep[at]], lengths[at])
    more: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(~same).tolist():
        text = data[starts[i] : starts[i] + lengths[i]].tobytes()
        if text not in more:
            more[text] = len(first) + len(extra)
            extra.append(i)
        back[i] = more[text]
    return np.concatenate([first, np.array(extra, first.dtype)]), back


def words_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each span as one number, 0 beyond its end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    view = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    return view[starts] & _MASKS[np.minimum(lengths, 8)]


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of these spans in a row."""
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    return data[np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in order of their first column, put together anew so that no value of it is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0)
        n = len(key)
        if held and key[n - 1].equals(held[0].column(0)[0]):
            held.append(batch)  # the group goes on
            continue
        new = np.flatnonzero(np.array(pc.not_equal(key.slice(1), key.slice(0, n - 1)))) + 1
        cut = int(new[-1]) if len(new) else 0
        if held or cut:
            yield merged([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield merged(held)


def merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches([b for b in batches if b.num_rows])
