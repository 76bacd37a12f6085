"""Moving packed numpy columns through a shuffle, and fixed-size sketches that are safe to broadcast.

A shuffle of packed Arrow batches (one row per map task and reduce bucket) costs a few bytes an entry, where rows of
(hash, id) would cost sixteen and a JVM object each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.llm.tokens import mix

U = np.uint64
BLOB = "bucket int, blob binary"


def pack(**columns: np.ndarray | pa.Array) -> bytes:
    arrays = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else _arrow(v) for k, v in columns.items()}
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _arrow(v: np.ndarray) -> pa.Array:
    if v.ndim == 2:
        v = np.ascontiguousarray(v)
        width = v.shape[1] * v.itemsize
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(v), [None, pa.py_buffer(v)])
    return pa.array(v)


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, name: str, dtype: type) -> np.ndarray:
    """A fixed-width binary column as a 2-d array."""
    c = batch.column(name)
    width = c.type.byte_width
    flat = np.frombuffer(c.buffers()[1], dtype=np.uint8)[c.offset * width : (c.offset + len(c)) * width]
    return flat.view(dtype).reshape(len(c), -1)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioning into n puts one into each partition."""
    found: dict[int, int] = {}
    start = 0
    while len(found) < n:
        rows = spark.range(start, start + 16 * n, 1, 1).select("id", F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p")).collect()
        for r in rows:
            found.setdefault(r["p"], r["id"])
        start += 16 * n
    return [found[i] for i in range(n)]


def exchange(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket")


def sketch_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], slices: int = 16) -> np.ndarray:
    """Reduce one fixed-size array per task to one array. Its size is set by a parameter, never by the data, so the
    driver may hold it. Slices are merged by several tasks; the driver only joins them."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = partial(batches)
        parts = np.array_split(whole, slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([pack(v=p) for p in parts], pa.binary())], names=["bucket", "blob"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = column(unpack(blob), "v")
                have[k] = merge(have[k], v) if k in have else v
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([pack(v=v) for v in have.values()], pa.binary())], names=["bucket", "blob"])

    merged = df.mapInArrow(local, BLOB).repartition(min(slices, 4), "bucket").mapInArrow(reduce, BLOB)
    got = {r["bucket"]: column(unpack(bytes(r["blob"])), "v") for r in merged.collect()}
    # a table without partitions has no task to say zero
    return np.concatenate([got[k] for k in sorted(got)]) if got else partial(iter(()))


class Bloom:
    """A Bloom filter of fixed size over 64-bit keys: 2^log2_bits bits in 64-byte blocks, three probes a key in one block."""

    def __init__(self, log2_bits: int, bits: np.ndarray | None = None):
        self.log2_bits = log2_bits
        self.bits = np.zeros(1 << (log2_bits - 6), dtype=np.uint64) if bits is None else bits

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) + U(0x9E3779B97F4A7C15))
        word = (h & U(len(self.bits) - 1)).astype(np.int64)
        m = (U(1) << ((h >> U(40)) & U(63))) | (U(1) << ((h >> U(46)) & U(63))) | (U(1) << ((h >> U(52)) & U(63)))
        return word, m

    def add(self, keys: np.ndarray) -> None:
        word, m = self._at(keys)
        np.bitwise_or.at(self.bits, word, m)

    def has(self, keys: np.ndarray) -> np.ndarray:
        word, m = self._at(keys)
        return (self.bits[word] & m) == m


def bloom_of(df: DataFrame, log2_bits: int) -> Bloom:
    """Bloom filter of the first (bigint) column; its size is the parameter's, whatever the number of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        b = Bloom(log2_bits)
        for x in batches:
            keys = x.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(keys):
                b.add(keys.astype(np.int64).view(np.uint64))
        return b.bits

    return Bloom(log2_bits, sketch_sum(df, partial, np.bitwise_or))


def share(spark: SparkSession, value: object) -> Broadcast:
    return spark.sparkContext.broadcast(value)


def rows(names: list[str], *columns: np.ndarray | pa.Array | list, types: list[pa.DataType] | None = None) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=types[i] if types else None) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, names=names)
