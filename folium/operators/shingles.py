"""Sets of hashed word shingles in Arrow batches: packed for buckets that count them, and compared.

A *post* has the shingles that a batch of texts sends to one bucket, in order of their keys, with the place in the batch of the
text that has each. A bucket is a range of keys, the first 40 bits of the hashes: a shingle that only shares these
with others seems less rare than it is, which loses nothing. Texts are compared by all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalized

KEY_BITS = 40
#: Bytes of text whose shingles are packed at once.
BATCH_BYTES = 16 << 20
CODEC = pa.Codec("zstd", compression_level=1)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    """64-bit hashes of words, kept for words that come again; bounded, as a worker keeps it for its life."""

    LIMIT = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(t: str, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a normalised text: text.shingles()."""
    words = t.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out, odd = np.full(len(h) - k + 1, k, np.uint64), ODD[0]
    with np.errstate(over="ignore"):
        for i in range(k):
            out += h[i : len(h) - k + 1 + i] * odd
            odd = odd * ODD[0]
        return np.unique(mixed(out))


def digest(c: Column) -> Column:
    """128 bits of the normalised text; null without words."""

    def of(c: pa.Array) -> pa.Array:
        texts = (normalized(x) if x else "" for x in c.to_pylist())
        return pa.array([blake2b(t.encode(), digest_size=16).digest() if t else None for t in texts], pa.binary())

    return F.arrow_udf(of, "binary")(c)


def compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def decompressed(blob: bytes) -> bytes:
    return CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, byte plane by byte plane: high planes compress to nothing."""
    n = len(columns[0])
    planes = np.stack([c.astype("<u8") for c in columns]).view(np.uint8).reshape(len(columns), n, 8).transpose(0, 2, 1)
    return compressed(planes.tobytes())


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(decompressed(blob), np.uint8).reshape(columns, 8, -1)
    return list(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8").reshape(columns, -1).astype(np.int64))


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def spread(count: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + count[i] - 1 of all i, one after the other."""
    return np.arange(count.sum()) + np.repeat(start - np.cumsum(count) + count, count)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches in pieces of about BATCH_BYTES of text, each with a name that is the same in every attempt of the task."""
    name = TaskContext.get().partitionId() << 32
    for b in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        cuts = np.searchsorted(end, np.arange(BATCH_BYTES, end[-1], BATCH_BYTES), "right") if len(end) else []
        cuts = np.unique(np.r_[0, cuts, len(end)]).astype(int).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield name, b.slice(i, j - i)
            name += 1


def rows(ids: pa.DataType, names: list[str], posts: list[tuple], known: pa.Table | None = None) -> pa.Table:
    """Posts (bucket, batch, blob), and after them the rows of `known` (bucket, batch, id, at, n), in these columns."""
    out = {"bucket": pa.array([x[0] for x in posts], pa.int64()), "batch": pa.array([x[1] for x in posts], pa.int64()), "blob": pa.array([x[2] for x in posts], pa.binary())}
    out |= {"id": pa.nulls(len(posts), ids), "at": pa.nulls(len(posts), pa.int64()), "n": pa.nulls(len(posts), pa.int64())}
    tables = [pa.table(out)]
    if known is not None:
        tables.append(known.append_column("blob", pa.nulls(len(known), pa.binary())).select(tables[0].column_names))
    return pa.concat_tables(tables).select(names)


def posts(size: int, n: int) -> Callable:
    """To each of n buckets the shingles of a piece of texts (id, text); and id and number of shingles of each text."""
    bounds = np.array([(i << KEY_BITS) // n for i in range(1, n)], np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in pieces(batches):
            sets = [shingle_set(normalized(x), size) if x else np.zeros(0, np.uint64) for x in b.column("text").to_pylist()]
            count = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(count)
            key = (np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, own = key[order], np.repeat(np.arange(len(sets)), count)[order]
            cut = np.r_[0, np.searchsorted(key, bounds), len(key)].tolist()
            sent = [(i, name, packed(steps(key[x:y]), own[x:y])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
            known = {"bucket": (name + has) % n, "batch": np.full(len(has), name), "id": b.column("id").take(pa.array(has)), "at": has, "n": count[has]}
            yield from rows(b.column("id").type, ["bucket", "batch", "blob", "id", "at", "n"], sent, pa.table(known)).to_batches()

    return send


def parted(table: pa.Table) -> tuple[list[tuple], pa.Table]:
    """Posts (bucket, batch, blob), in order, and the other rows (bucket, batch, id, at, n)."""
    none = pc.is_null(table.column("blob"))
    sent = table.filter(pc.invert(none))
    posts = zip(sent.column("bucket").to_pylist(), sent.column("batch").to_pylist(), sent.column("blob").to_pylist(), strict=True)
    return sorted(posts, key=lambda x: x[:2]), table.filter(none).select(["bucket", "batch", "id", "at", "n"])


def rarities(table: pa.Table) -> pa.Table:
    """Of a bucket's posts the shingles that several texts have: their places in the post, the texts, and how rare they are, in powers of two."""
    posts, known = parted(table)
    ready = [unpacked(x[2], 2) for x in posts]
    if ready:
        _, at, count = np.unique(np.concatenate([np.cumsum(k) for k, _ in ready]), return_inverse=True, return_counts=True)
        df = count.astype(np.int32)[at]
    out, i = [], 0
    for (bucket, batch, _), (k, own) in zip(posts, ready, strict=True):
        mine = df[i : i + len(k)]
        place = np.flatnonzero(mine > 1)
        if len(place):
            out.append((bucket, batch, packed(steps(place), own[place], np.log2(mine[place]).astype(np.int64))))
        i += len(k)
    return rows(table.schema.field("id").type, ["batch", "bucket", "blob", "id", "at", "n"], out, known)


def probes(threshold: float, n: int) -> Callable:
    """For each bucket the places, in its post of this batch, of shingles that are probes; and the texts as they came.

    The order of shingles is the same for all texts: by rarity, then by key. Those of one text only come first. They
    meet nothing, so only their number counts.
    """

    def choose(table: pa.Table) -> pa.Table:
        posts, known = parted(table)
        ready, out = [unpacked(x[2], 3) for x in posts], []
        if ready:
            bucket = np.repeat([x[0] for x in posts], [len(x[0]) for x in ready])
            place, own, cls = (np.concatenate(x) for x in ([np.cumsum(x[0]) for x in ready], [x[1] for x in ready], [x[2] for x in ready]))
            at = known.column("at").to_numpy()
            total = np.zeros(at.max() + 1, np.int64)
            total[at] = known.column("n").to_numpy()
            most = total - np.ceil(total * threshold - 1e-9).astype(np.int64) + 1
            left = most - (total - np.bincount(own, minlength=len(total)))
            chosen = np.flatnonzero(left[own] > 0)
            chosen = chosen[np.lexsort((place[chosen], bucket[chosen], cls[chosen], own[chosen]))]
            doc = own[chosen]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            chosen = np.sort(chosen[rank < left[doc]])
            name, bucket = posts[0][1], bucket[chosen]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(bucket) else []
            out = [(int(bucket[i]), name, packed(steps(place[chosen[i:j]]))) for i, j in zip(edge, [*edge[1:], len(bucket)], strict=True)]
        return rows(table.schema.field("id").type, ["bucket", "batch", "blob", "id", "at", "n"], out, known)

    return choose


def incidences(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts that have a shingle that is a probe of some text, with its key; and the texts as they came, without a key."""
    asked, known = parted(right)
    sent = {x[1]: x[2] for x in parted(left)[0]} if asked else {}
    ready = {batch: unpacked(blob, 2) for batch, blob in sent.items()}
    places = {x[1]: np.cumsum(unpacked(x[2], 1)[0]) for x in asked}
    key = {batch: np.cumsum(x[0]) for batch, x in ready.items()}
    probed = np.unique(np.concatenate([np.zeros(0, np.int64), *(key[batch][at] for batch, at in places.items())]))
    out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]]
    for batch, k in key.items() if len(probed) else ():
        at = np.flatnonzero(probed[np.minimum(np.searchsorted(probed, k), len(probed) - 1)] == k)
        own = np.zeros(len(k), bool)
        own[places.get(batch, [])] = True
        out.append([k[at], np.full(len(at), batch), ready[batch][1][at], own[at]])
    names = ["key", "batch", "at", "probe"]
    table = pa.table({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(names)})
    for name in ("id", "n"):
        table = table.append_column(name, pa.nulls(len(table), known.schema.field(name).type))
    known = known.append_column("key", pa.nulls(len(known), pa.int64())).append_column("probe", pa.nulls(len(known), pa.bool_()))
    return pa.concat_tables([table, known.select(table.column_names)])


def squeezed(c: Column) -> Column:
    """The normalised text, compressed."""

    def of(c: pa.Array) -> pa.Array:
        texts = (normalized(x or "").encode() for x in c.to_pylist())
        return pa.array([compressed(t) for t in texts], pa.binary())

    return F.arrow_udf(of, "binary")(c)


def similar(threshold: float, size: int) -> Callable:
    """a, b and similarity of texts (id, t, asks, asked): of each that asks with those asked that are larger, or as large and of a larger id.

    What a text has in common with all others at once is counted by the lists of the texts that have each of its shingles.
    """

    def compare(table: pa.Table) -> pa.Table:
        sets = [shingle_set(decompressed(t).decode(), size) for t in table.column("t").to_pylist()]
        n = np.array([len(s) for s in sets])
        order = pc.sort_indices(pa.table({"n": n, "id": table.column("id")}), [("n", "ascending"), ("id", "ascending")]).to_numpy()
        n, sets, asks, asked = n[order], [sets[i] for i in order], table.column("asks").to_numpy()[order], table.column("asked").to_numpy()[order]
        _, key = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.flatnonzero(np.repeat(asked, n))
        have = np.repeat(np.arange(len(sets)), n)[at[np.argsort(key[at], kind="stable")]]
        count = np.bincount(key[at], minlength=key.max() + 1)
        a, b, similarity = [], [], []
        cut, end = np.cumsum(n), np.cumsum(count)
        for i in np.flatnonzero(asks):
            k = key[cut[i] - n[i] : cut[i]]
            k = k[count[k] > asked[i]]
            if len(k) < n[i] * threshold - 1e-9:
                continue
            common = np.bincount(have[spread(count[k], end[k] - count[k])], minlength=len(sets))
            common[: i + 1] = 0
            found = np.flatnonzero(common / n[i] >= threshold)
            a.append(np.full(len(found), i))
            b.append(found)
            similarity.append(common[found] / n[i])
        ids, none = table.column("id").take(pa.array(order)), np.zeros(0, np.int64)
        a, b = (ids.take(pa.array(np.concatenate([none, *x]))) for x in (a, b))
        return pa.table({"a": a, "b": b, "similarity": np.concatenate([np.zeros(0), *similarity])})

    return compare
