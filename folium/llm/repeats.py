"""Which keys occur in more than one place of the corpus: the filter that precedes exact repeat detection.

Each chunk sends its distinct 64-bit keys to buckets; a bucket answers each chunk with those of its keys
that another chunk sent too. What repeats inside a chunk the chunk sees itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

ROWS = "bucket long, chunk long, blob binary"
ANSWERS = "chunk long, bucket long, blob binary"


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents in order of doc_id: ids, offsets and the bytes of the texts."""
    names = R.chunk_ids()
    for b in R.slices(batches, "text"):
        ids = R.id_values(b.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        data, off = R.flat_utf8(b.column("text").take(pa.array(order)))
        payload = R.squeeze((ids[order], off, data.tobytes()))
        yield pa.record_batch([[next(names)], [payload]], schema=pa.schema([("chunk", pa.int64()), ("payload", pa.binary())]))


def text_chunks(docs: DataFrame) -> DataFrame:
    """chunk, payload: docs packed and dealt out by chunk."""
    spark = R.attach(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(pack_texts, "chunk long, payload binary").repartition(R.partitions(spark), "chunk")


def unpack_texts(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, bytes]:
    return R.unsqueeze(payload.as_buffer())


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, and the places of its keys in order of the keys."""
    to = bucket_of(keys, n)
    order = np.lexsort((keys, to))
    count = np.bincount(to, minlength=n)
    end = np.cumsum(count)
    for i in np.flatnonzero(count).tolist():
        yield i, order[end[i] - count[i] : end[i]]


def key_rows(chunk: int, keys: np.ndarray, n: int) -> pa.RecordBatch:
    own, blobs = [], []
    for i, at in by_bucket(keys, n):
        own.append(i)
        blobs.append(R.squeeze(R.byte_planes(keys[at], 8)))
    return pa.record_batch([pa.array(own, pa.int64()), pa.array([chunk] * len(own), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])


def shared_keys(table: pa.Table) -> pa.Table:
    """For each chunk, those of its keys in this bucket that another chunk has too."""
    parts = [R.from_planes(R.unsqueeze(x)).view(np.uint64) for x in table.column("blob").to_pylist()]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    rows = [(c, b, R.squeeze(R.byte_planes(k, 8))) for c, b, p in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), parts, strict=True) if len(k := p[np.isin(p, twice, assume_unique=True)])]
    return pa.table({"chunk": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([x[1] for x in rows], pa.int64()), "blob": pa.array([x[2] for x in rows], pa.binary())})


def answered(right: pa.Table) -> np.ndarray:
    """All keys of shared_keys() for a chunk, sorted."""
    parts = [R.from_planes(R.unsqueeze(x)).view(np.uint64) for x in right.column("blob").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def within(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def repeated_keys(chunks: DataFrame, keys_of: Callable[[tuple], np.ndarray], n: int) -> DataFrame:
    """chunk, bucket, blob: the keys of each chunk that other chunks share. keys_of: an unpacked chunk's distinct keys."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                yield key_rows(chunk, keys_of(unpack_texts(payload)), n)

    return chunks.mapInArrow(send, ROWS).groupBy("bucket").applyInArrow(shared_keys, ANSWERS)
