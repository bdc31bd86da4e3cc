"""Operator 7: n-gram Jaccard join by prefix trees, and the components of its links.

A document's set holds the hashes of its distinct 4-word shingles. Two documents link when
100 * |intersection| >= percent * |union|.

1. *Order.* Chunks send their distinct shingles to buckets, which count the sets that have each. The global
   order of shingles is by that count, rarest first (in classes), then by hash.
2. *Distribution, without loss.* Sets that link share percent of the larger one, so they share one of the first
   100 - percent of each in the global order. Shingles that only one set has come first: most documents have
   so many that they are done here; a passage or line that many documents share comes last and brings none
   together. The others send the rest of their prefix to the buckets of its hashes. There, and before in each
   chunk, the sets of one shingle are chained in order of size as far as sizes let them link. Links go back to
   the chunks of their documents, which keep a spanning forest; its components are the candidate groups.
3. *Equal sets* count once: the smallest doc_id stands for all of them.
4. *Prefix tree.* The sets of a candidate group, in the order of their items' counts in the group, are stored
   in a compressed trie. A probe walks down it for all stored sets at once, carrying the overlap of the path;
   a subtree is left where the overlap so far and the lengths that remain, in the probe and below, can't
   reach the threshold, or where all of it is linked with the probe already.
5. A group of more than `group_items` hashes is no single task: large_groups() first connects its near copies in
   bounded parts, then joins pairs of blocks, but never blocks of one connected part with each other.

Defined results: texts are taken as bytes with A-Z lower-cased; null and blank texts have an empty set
and link with nothing. A repeated row gets the result of its twin; rows that share a doc_id but not the
text get the component of their own set. A row without doc_id gets its n_shingles, but links with nothing
and has no component_id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats as P
from . import runtime as R
from .components import connected_components

SHINGLE, PERCENT = 4, 85
GROUP_ITEMS = 1 << 20
#: Entries of a tree's labels as bit sets, before they are packed.
MAX_BITS = 1 << 27
MET = "doc_id long, n_shingles long, f1 long, f2 long, rep long, link long"

SHORT = np.uint64(0xA0761D6478BD642F)
#: Bits of a shingle's hash that its count does without: a collision makes a shingle seem less rare, which loses nothing.
DROPPED, U0, U64_1 = np.uint64(16), np.uint64(0), np.uint64(1)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles; of the whole sequence, if it is shorter."""
    h = R.WORD_HASHES.of(text.lower().split())
    if len(h) >= k:
        return np.unique(R.rolling(h, k))
    return R.mix(R.rolling(h, len(h)) ^ SHORT) if len(h) else np.zeros(0, np.uint64)


def rarity(count: np.ndarray) -> np.ndarray:
    """The class of shingles that so many sets have: 0 for one, and up with the logarithm."""
    return np.where(count < 2, 0, 1 + np.minimum(254, 4 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def prefixes(flat: np.ndarray, cls: np.ndarray, own: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Places in flat of the shingles that sets send: of the first in the global order, those that other sets have.

    flat: the sets one after the other; cls: the class of each shingle; own: its set; size: of each set. Sets that
    link have percent of the larger one in common, so each has one of those among its first, however the order is,
    if that is one for all sets: by class, then by hash. Where the first are all its own, a set links with none.
    """
    most = size - -(-size * percent // 100) + 1
    alone = np.bincount(own[cls == 0], minlength=len(size))
    at = np.flatnonzero((alone < most)[own] & (cls > 0))
    at = at[np.lexsort((flat[at], cls[at], own[at]))]
    o = own[at]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else at
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
    return at[rank < (most - alone)[o]]


def chains(key: np.ndarray, size: np.ndarray, ids: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours in size, of those with one key, if their sizes let them link; any two that may link are connected."""
    order = np.lexsort((ids, size, key))
    k, n, i = key[order], size[order], ids[order]
    ok = (k[1:] == k[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (i[1:] != i[:-1])
    return i[1:][ok], i[:-1][ok]


def thinned(key: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Places of the smallest and largest set of each key in each class of sizes, in order of the keys.

    Sizes of a class let any two link, and the others of a chunk are chained to these, so a key that many of
    its documents have costs a chunk a few entries.
    """
    order = np.lexsort((size, key))
    k, c = key[order], np.floor(2 * np.log(np.maximum(size[order], 1)) / np.log(100 / min(percent, 99))).astype(np.int64)
    edge = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, bool)
    return order[edge | np.r_[edge[1:], True][: len(k)]]


def spanning_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b) and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        m, old = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(label, x, m)
        np.minimum.at(label, y, m)
        label = label[label]
        if (label == old).all():
            return nodes, nodes[label]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all nodes of (a, b) to the smallest that they reach."""
    if not len(a):
        return a, b
    nodes, low = spanning_labels(a, b)
    return nodes[nodes != low], low[nodes != low]


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins and ends among sorted 64-bit keys: equal ranges of their values."""
    cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(keys, cuts), len(keys)]


def packed(keys: np.ndarray, width: int) -> list[bytes]:
    """Sorted keys as the byte planes of their differences."""
    return R.byte_planes(np.diff(keys, prepend=U0), width)


def unpacked(planes: list[bytes]) -> np.ndarray:
    return np.cumsum(R.from_planes(planes).view(np.uint64), dtype=np.uint64)


class ChunkSets:
    """The sets of a chunk's documents, one after the other, and the distinct keys of those that stand for equal ones."""

    def __init__(self, chunk: tuple, shingle: int):
        self.ids, off, data = chunk
        sets = [shingle_set(data[i:j], shingle) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        self.size = np.array([len(s) for s in sets], np.int64)
        with np.errstate(over="ignore"):
            self.prints = np.array([(R.mix(s).sum(), R.mix(s ^ SHORT).sum()) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        known: dict[tuple, int] = {}
        for i, (n, doc_id, (x, y)) in enumerate(zip(self.size.tolist(), self.ids.tolist(), self.prints.tolist(), strict=True)):
            if n and doc_id != R.NULL_ID:
                known.setdefault((n, x, y), i)
        self.reps = np.fromiter(known.values(), np.int64, len(known))  # of equal sets that with the smallest id, as ids are sorted
        self.flat = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in self.reps)])
        self.own = np.repeat(np.arange(len(self.reps)), self.size[self.reps])
        self.keys, self.at, self.count = np.unique(self.flat >> DROPPED, return_inverse=True, return_counts=True)


def _send_keys(shingle: int, n: int) -> Callable:
    """Each chunk's distinct keys, with the number of its sets that have each, to the buckets of their ranges."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column("chunk").to_pylist(), b.column("payload"), strict=True):
                x = ChunkSets(P.unpack_texts(payload), shingle)
                cut = ranges(x.keys << DROPPED, n).tolist()
                rows = [(i, R.squeeze((packed(x.keys[a:b], 8), R.byte_planes(x.count[a:b], 3)))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "chunk", "blob"])

    return send


def rarities(table: pa.Table) -> pa.Table:
    """The class of each key that a chunk sent to this bucket, in the order in which it sent them."""
    parts = [(unpacked(k), R.from_planes(c)) for k, c in (R.unsqueeze(x) for x in table.column("blob").to_pylist())]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    cls = rarity(np.bincount(at, np.concatenate([c for _, c in parts])))[at]
    cut = np.cumsum([0, *(len(k) for k, _ in parts)])
    blobs = [R.squeeze(cls[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def _send_prefixes(percent: int, shingle: int, n: int) -> Callable:
    """Each chunk's documents, the links between those whose prefixes meet there, and what other chunks need of the prefixes."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {b: R.unsqueeze(x.as_buffer()) for b, x in zip(right.column("bucket").to_pylist(), right.column("blob"), strict=True)}
        rows = []
        for chunk, payload in zip(left.column("chunk").to_pylist(), left.column("payload"), strict=True):
            x = ChunkSets(P.unpack_texts(payload), shingle)
            cls = np.frombuffer(b"".join(told[b] for b in sorted(told)), np.uint8)
            at = prefixes(x.flat, cls[x.at], x.own, x.size[x.reps], percent) if len(x.flat) else x.own
            key, doc = x.flat[at], x.reps[x.own[at]]
            size, ids = x.size[doc], x.ids[doc]
            rows.append((chunk % n, chunk, R.squeeze(("documents", x.ids, x.size, x.prints, *forest(*chains(key, size, ids, percent))))))
            sent = thinned(key, size, percent)
            key, size, ids = key[sent], size[sent], ids[sent]
            cut = ranges(key, n).tolist()
            rows += [(i, chunk, R.squeeze(("prefixes", packed(key[a:b], 8), R.byte_planes(size[a:b], 5), R.byte_planes(ids[a:b], 8)))) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return send


def _meet(percent: int) -> Callable:
    """To each chunk, a forest of the links of its documents that prefixes make in this bucket; and its documents as they came."""

    def meet(table: pa.Table) -> pa.Table:
        rows, parts = [], []
        for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob"), strict=True):
            kind, *x = R.unsqueeze(blob.as_buffer())
            if kind == "documents":
                rows.append((chunk, blob.as_py()))
            else:
                parts.append((chunk, unpacked(x[0]), R.from_planes(x[1]), R.from_planes(x[2])))
        if parts:
            a, b = forest(*chains(*(np.concatenate([x[i] for x in parts]) for i in (1, 2, 3)), percent))
            for chunk, _, _, ids in parts if len(a) else ():
                own = np.unique(ids)
                at = np.minimum(np.searchsorted(a, own), len(a) - 1)
                at = at[a[at] == own]
                if len(at):
                    rows.append((chunk, R.squeeze(("links", a[at], b[at]))))
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return meet


def representatives(ids: np.ndarray, size: np.ndarray, prints: np.ndarray) -> pa.Array:
    """For each document of a chunk the first one, in order of the ids, that has the same set; null without a set or an id."""
    _, first, same = np.unique(np.column_stack([size, prints]), axis=0, return_index=True, return_inverse=True)
    return pa.array(ids[first][same.reshape(-1)], mask=(ids == R.NULL_ID) | (size == 0))


def gathered(table: pa.Table) -> pa.Table:
    """The documents of a chunk, and a forest of all links of theirs: no more rows than it has documents and they have partners."""
    out, links = [], []

    def row(doc: np.ndarray, *rest: np.ndarray | pa.Array | None) -> None:
        out.append(pa.table([R.id_column(doc), *(pa.nulls(len(doc), pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in rest)], names=["doc_id", "n_shingles", "f1", "f2", "rep", "link"]))

    for blob in table.column("blob"):
        kind, *x = R.unsqueeze(blob.as_buffer())
        if kind == "documents":
            row(x[0], x[1], x[2][:, 0], x[2][:, 1], representatives(x[0], x[1], x[2]), None)
        links.append(x[-2:])
    a, b = forest(*(np.concatenate([x[i] for x in links]) for i in (0, 1)))
    row(a, None, None, None, None, b)
    return pa.concat_tables(out)


class PrefixTree:
    """Sorted sets as paths of a compressed trie, its nodes in arrays so that a probe visits many at once.

    Items are numbers in the global order. A node's label is flat[at : at + size], its sets are those of the
    places lo .. hi - 1 in the lexicographic order, and low and high are the smallest and largest of their sizes.
    Where they are small enough, labels are also kept as bit sets, to count what they share with a probe.
    """

    def __init__(self, sets: list[np.ndarray], keep: np.ndarray):
        """keep: which items several sets have; the others never count as shared."""
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        rows = [sets[i] for i in self.order]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows)
        base = np.cumsum(self.size) - self.size
        shared = [0, *map(self.common, rows[:-1], rows[1:]), 0]
        nodes, below = [], []  # (depth, lo, hi), and the nodes below each

        def add(depth: int, lo: int, hi: int, children: list[int]) -> int:
            nodes.append((depth, lo, hi))
            below.append(children)
            return len(nodes) - 1

        stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
        for i in range(len(rows)):
            after = shared[i + 1]
            if after > stack[-1][0]:
                stack.append((after, i, []))
            stack[-1][2].append(add(len(rows[i]), i, i + 1, []))
            while stack[-1][0] > after:
                depth, lo, children = stack.pop()
                node = add(depth, lo, i + 1, children)
                if stack[-1][0] >= after:
                    stack[-1][2].append(node)
                else:
                    stack.append((after, lo, [node]))
        below.append(stack[0][2])  # the root's
        self.after = np.cumsum([0, *map(len, below)])
        self.under = np.array([x for children in below for x in children], np.int64)
        depth, self.lo, self.hi = np.array(nodes, np.int64).T
        start = np.zeros(len(nodes), np.int64)
        for i, children in enumerate(below[:-1]):
            start[children] = depth[i]
        self.start, self.label, self.at = start, depth - start, base[self.lo] + start
        self.low, self.high = (np.array([f(self.size[i:j]) for i, j in zip(self.lo, self.hi, strict=True)]) for f in (np.min, np.max))
        self.leaf = self.after[1:-1] == self.after[:-2]
        self.last = self.flat[np.maximum(self.at + self.label - 1, 0)] if len(self.flat) else self.at  # of an empty label, the item above
        self.bits = self.as_bits(keep) if len(nodes) * int(keep.sum()) <= MAX_BITS else None

    def as_bits(self, keep: np.ndarray) -> np.ndarray:
        self.keep, self.column = keep, np.cumsum(keep) - 1
        item = self.flat[R.spread(self.label, self.at)]
        row = np.repeat(np.arange(len(self.label)), self.label)
        dense = np.zeros((len(self.label), -(-max(1, int(keep.sum())) // 64) * 64), bool)
        dense[row[keep[item]], self.column[item[keep[item]]]] = True
        return np.packbits(dense, axis=1).view(np.uint64)

    def counts(self, nodes: np.ndarray, member: np.ndarray, probe: np.ndarray) -> np.ndarray:
        """How many items of each node's label the probe has."""
        size = self.label[nodes]
        if self.bits is None:
            total = np.r_[0, np.cumsum(member[self.flat[R.spread(size, self.at[nodes])]])]
            end = np.cumsum(size)
            return total[end] - total[end - size]
        row = np.zeros(self.bits.shape[1] * 64, bool)
        row[self.column[probe[self.keep[probe]]]] = True
        return np.bitwise_count(self.bits[nodes] & np.packbits(row).view(np.uint64)).sum(axis=1, dtype=np.int64)

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        """How many items two sets have alike from the start."""
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def linked(self, probe: np.ndarray, percent: int, group: np.ndarray, own: int, universe: int) -> np.ndarray:
        """Places of the sets that the probe links to, without those of subtrees that are all of its group already.

        group: a number for each place, equal where sets are known to be connected. The walk goes down level by
        level from the root. A node's label is counted once for all sets below it, and what the path to it shares
        is carried along. A subtree is left where that and the shorter of what remains, in the probe beyond the
        label and in the largest set below, can't reach the threshold with the smallest set below.
        """
        n, member, found = len(probe), np.zeros(universe, bool), []
        member[probe] = True
        strange = np.r_[0, np.cumsum(group != group[own])]
        node, shared = np.array([len(self.label)]), np.zeros(1, np.int64)
        while len(node):
            count = self.after[node + 1] - self.after[node]
            shared = np.repeat(shared, count)
            node = self.under[R.spread(count, self.after[node])]
            ok = (strange[self.hi[node]] > strange[self.lo[node]]) & ((100 + percent) * (shared + np.minimum(n - shared, self.high[node] - self.start[node])) >= percent * (n + self.low[node]))
            node, shared = node[ok], shared[ok]
            shared = shared + self.counts(node, member, probe)
            rest = n - np.searchsorted(probe, self.last[node], "right")
            ok = (100 + percent) * (shared + np.minimum(rest, self.high[node] - self.start[node] - self.label[node])) >= percent * (n + self.low[node])
            node, shared = node[ok], shared[ok]
            found.append(self.lo[node[self.leaf[node]]])  # nothing remains below a leaf: the bound was its overlap
        at = np.concatenate(found) if found else node
        return at[group[at] != group[own]]


def linked(ids: list[int], sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[int]:
    """For each of the sets the smallest id that links reach within this group. known: equal where sets are connected already."""
    if len(sets) < 2:
        return list(ids)
    items, flat, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.argsort(-count, kind="stable")  # the order: items that most sets have come first, so that paths are shared
    number = np.empty(len(items), np.int64)
    number[common] = np.arange(len(items))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    numbered = [np.sort(x) for x in np.split(number[flat], cuts)]
    tree = PrefixTree(numbered, count[common] > 1)
    group = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1][tree.order]
    for place, i in enumerate(tree.order.tolist()):
        hit = np.unique(group[tree.linked(numbered[i], percent, group, place, len(items))])
        hit = hit[hit != group[place]]
        if len(hit):
            group[np.isin(group, hit)] = group[place]
    low = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(low, group, np.array(ids, np.int64)[tree.order])
    out = np.empty(len(sets), np.int64)
    out[tree.order] = low[group]
    return out.tolist()


def _with_sets(shingle: int) -> Callable:
    """The sets of texts, and the smallest of two hashes of theirs, which sets that link mostly have alike."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set((x or "").encode(), shingle) for x in b.column("text").to_pylist()]
            keys = [[int(x[0] >> U64_1), int(R.mix(x ^ SHORT).min() >> U64_1)] if len(x) else [] for x in found]
            yield pa.record_batch([b.column("id"), b.column("component"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "component", "items", "keys"])

    return sets


def _join_group(percent: int) -> Callable:
    """id and low of the rows that reach a smaller id in a group; v, where there is one, is equal for rows known to be connected."""

    def join(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        low = linked(ids, [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()], percent, table.column("v").to_pylist() if "v" in table.column_names else None)
        return pa.table({"id": table.column("id"), "low": pa.array(low, pa.int64())}).filter(pa.array([x != y for x, y in zip(ids, low, strict=True)], pa.bool_()))

    return join


LINKS = "id long, low long"


def large_groups(sets: DataFrame, percent: int, group_items: int) -> DataFrame:
    """id and component_id of the rows of sets (id, component, items, keys) that reach a smaller id; a group of any size.

    1. Sets with one key are dealt out in parts of `group_items` hashes, each with the smallest id as a pivot, and
       joined there. A group of near copies becomes connected by this, in a time that grows with its size.
    2. What is connected needs no comparing. Connected parts beyond `group_items` get blocks of their own, the
       others share blocks; each pair of blocks is joined but those of one connected part.
    """
    rows = R.checkpointed(sets.withColumn("n", F.octet_length("items") / 8))
    keyed = rows.withColumn("key", F.explode("keys")).drop("keys")
    parts = keyed.groupBy("component", "key").agg(F.ceil(F.sum("n") / group_items).cast("int").alias("parts"), F.min("id").alias("pivot"))
    part = F.when(F.col("id") == F.col("pivot"), F.expr("sequence(0, parts - 1)")).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    near = keyed.join(parts, ["component", "key"]).withColumn("part", F.explode(part)).select("id", "component", "key", "part", "items")
    near = R.checkpointed(near.groupBy("component", "key", "part").applyInArrow(_join_group(percent), LINKS))
    sure = connected_components(near.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "v")
    rows = rows.drop("keys").join(sure, "id", "left").withColumn("v", F.coalesce("v", "id"))
    sizes = rows.groupBy("component", "v").agg(F.sum("n").alias("n")).withColumn("own", F.when(F.col("n") > group_items, F.ceil(F.col("n") / group_items)).otherwise(0).cast("int"))
    total = sizes.groupBy("component").agg(F.ceil(F.coalesce(F.sum(F.when(F.col("own") == 0, F.col("n"))), F.lit(0)) / group_items).cast("int").alias("shared"), F.sum("own").cast("int").alias("large"), F.count("*").alias("k")).where("k > 1").drop("k")
    before = Window.partitionBy("component").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.where("own > 0").withColumn("start", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int")).select("component", "v", "own", "start")
    dealt = rows.join(total, "component").join(large, ["component", "v"], "left")
    every = F.expr("sequence(0, shared + large - 1)")
    alone = F.col("own").isNotNull()
    block = F.when(alone, F.col("shared") + F.col("start") + F.pmod(F.xxhash64("id"), F.col("own"))).otherwise(F.pmod(F.xxhash64("v"), F.greatest("shared", F.lit(1)))).cast("int")
    others = F.when(alone, F.filter(every, lambda x: (x < F.col("shared") + F.col("start")) | (x >= F.col("shared") + F.col("start") + F.col("own")))).otherwise(every)
    pairs = dealt.withColumn("block", block).withColumn("other", F.explode(others))
    pairs = pairs.select("id", "component", "items", "v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    far = pairs.groupBy("component", "i", "j").applyInArrow(_join_group(percent), LINKS)
    links = near.unionByName(far).select(F.col("id").alias("a"), F.col("low").alias("b"))
    return connected_components(links).where("id <> component").select("id", F.col("component").alias("component_id"))


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = R.attach(docs.sparkSession)
    n = R.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = P.text_chunks(docs)
    told = chunks.mapInArrow(_send_keys(shingle, n), P.ROWS).groupBy("bucket").applyInArrow(rarities, P.ANSWERS)
    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_send_prefixes(percent, shingle, n), P.ROWS)
    met = sent.groupBy("bucket").applyInArrow(_meet(percent), "chunk long, blob binary").groupBy("chunk").applyInArrow(gathered, MET)
    met = R.checkpointed(met)
    rows = met.where("link is null").drop("link")
    near = connected_components(met.where("link is not null").select(F.col("doc_id").alias("a"), F.col("link").alias("b")))
    prints = ["n_shingles", "f1", "f2"]
    own = rows.where("doc_id = rep").select("rep", *prints).distinct()  # of many equal sets, one a chunk
    classes = own.groupBy(*prints).agg(F.min("rep").alias("id"))
    reps = near.join(classes.groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    groups = reps.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("items")).where("k > 1")
    groups = groups.select("component", F.greatest(F.lit(1), F.ceil(F.col("items") / group_items)).cast("int").alias("blocks"))
    texts = docs.join(reps.join(groups, "component"), F.col("doc_id") == F.col("id"))
    sets = lambda of: of.select("id", "component", "text").mapInArrow(_with_sets(shingle), "id long, component long, items binary, keys array<long>")
    low = R.checkpointed(sets(texts.where("blocks = 1")).drop("keys").groupBy("component").applyInArrow(_join_group(percent), LINKS)).groupBy("id").agg(F.min("low").alias("component_id"))
    if groups.where("blocks > 1").take(1):
        low = low.unionByName(large_groups(sets(texts.where("blocks > 1")), percent, group_items))
    low = own.join(classes, prints).join(low, "id", "left").select("rep", *prints, F.coalesce("component_id", "id").alias("low"))
    node = rows.join(low, ["rep", *prints], "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id"))
    return node.select("doc_id", "n_shingles", mine.alias("component_id"))
