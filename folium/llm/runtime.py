"""Shared ground of the training-data operators: sizes, checkpoints, packed chunks, word hashes.

Several operators use one exchange pattern, "packed chunks":

* a map task cuts its rows into *chunks* of a few MB of text and writes each as one compressed row;
* for each chunk, the distinct keys (words, k-mers, anchors ...) go to buckets by their hash, one
  compressed row for each (chunk, bucket), so a key costs a chunk at most one entry however often
  it occurs there: hot keys are aggregated before the shuffle and cannot make a reducer skewed;
* the reducer of a bucket answers each chunk; a cogroup by chunk joins text and answers again.

Nothing is gathered on the driver, and a task never holds more than a chunk or a bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import SparkSession

from ..storage import attach, checkpointed, shared_dir  # noqa: F401  used by the operators

#: Text bytes in one packed chunk.
CHUNK_BYTES = 8 << 20
#: Stands for a null id inside the packed arrays; it sorts after every real id.
NULL_ID = np.iinfo(np.int64).max

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unsqueeze(b: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_1
        x = (x ^ (x >> U64(27))) * MIX_2
        return x ^ (x >> U64(31))


def byte_planes(x: np.ndarray, width: int) -> list[bytes]:
    """The lowest `width` bytes of unsigned integers, plane by plane: high planes compress to nothing."""
    v = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [v[:, i].tobytes() for i in range(width)]


def from_planes(planes: list[bytes]) -> np.ndarray:
    n = len(planes[0]) if planes else 0
    v = np.zeros((n, 8), np.uint8)
    for i, p in enumerate(planes):
        v[:, i] = np.frombuffer(p, np.uint8)
    return v.reshape(-1).view("<u8").astype(np.int64)


def flat_utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and len + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def id_values(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of text; a longer text stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n)
        k = max(1, -(-int(end[-1]) // limit))
        cuts = np.unique(np.r_[0, np.searchsorted(end, end[-1] * np.arange(1, k) / k, "right"), len(n)])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(i, j - i)


def chunk_ids() -> Iterator[int]:
    """Ids of a map task's chunks: the same in every attempt of the task."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    n = 0
    while True:
        yield base | n
        n += 1


class WordHashes(dict):
    """64-bit hashes of words, kept for words that come again; bounded, as a worker keeps it for its life."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


#: One for all operators, since a worker may run several after each other.
WORD_HASHES = WordHashes()


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive entries that start at each place; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        n, out, odd = len(h) - k + 1, np.zeros(len(h) - k + 1, U64), GOLDEN
        for i in range(k):
            out += h[i : i + n] * odd
            odd = odd * GOLDEN
    return mix(out)


def spread(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lens[i] - 1 of all i, one after the other."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lens)


#: Bytes that end a word: blank and \x09 to \x0D.
WHITE = np.array([i == 0x20 or 0x09 <= i <= 0x0D for i in range(256)])


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of all documents as one Arrow column, and len + 1 places where each document's begin."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(off), np.int64)
    solid = ~WHITE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    doc = off[:-1][off[1:] > off[:-1]]
    begin[doc] = solid[doc]
    at = np.flatnonzero(begin)
    text = data[solid]
    place = np.cumsum(solid)[at] - 1
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(place, len(text)).astype(np.int32)), pa.py_buffer(text)])
    return words, np.searchsorted(at, off)
