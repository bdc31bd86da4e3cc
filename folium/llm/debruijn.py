"""Operator 3: removal of repeated word spans by de Bruijn compaction.

The graph: nodes are (k-1)-word sequences, edges the k-word windows of all documents. A window is
removed where its edge also starts in a document of smaller id. Each step is a join by shuffle:

1. *Pruning.* An edge can only repeat if its minimizer (the smallest hash among its 5-word parts)
   does. Chunks send their distinct minimizers to buckets and learn which others have too.
2. *Edges.* The edges with a repeated minimizer are joined across chunks by hash: each edge gets its
   source coordinate, the first place in the smallest document where it starts. An edge costs a chunk one
   entry however often it occurs there, so hot passages are aggregated before the shuffle.
3. *Paths.* The sources are joined back to the chunks. Neighbouring edges whose sources are neighbours too
   form a nonbranching path: both sides go on with the same edge. It compacts into one span, which has one
   coordinate; a path ends where a document branches off.
4. *Verification.* Spans go to the chunks of their sources, where a 128-bit digest of their words is held
   against that of the source's words at the coordinate. Spans of other words, as a collision of the edges'
   hashes would make, fall away.
5. *Removal.* Verified spans return to their chunks, whose words in spans are removed.

Defined results: a null or empty text has no words. Rows without doc_id count as larger than all ids
and never as a source for each other; rows that share a doc_id aren't sources for each other either.
Documents shorter than a window lose nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as P
from . import runtime as R

WINDOW, PART = 13, 5
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
SPANS = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int,source_doc_id:long,source_start:int>>"


def word_hashes(data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, and len + 1 places where documents begin."""
    parts = [R.WORD_HASHES.of(data[i:j].split()) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)


def window_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Places in the concatenated words where a window of k words lies inside one document."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    return R.spread(n, ptr[:-1])


def minimizers(h: np.ndarray, k: int) -> np.ndarray:
    """The minimizer of each window of k words, by its place."""
    m = R.rolling(h, PART)
    have, width = 1, k - PART + 1
    while have < width:
        step = min(have, width - have)
        m, have = np.minimum(m[:-step], m[step:]), have + step
    return m


def _minimizer_keys(k: int) -> Callable:
    def keys(chunk: tuple) -> np.ndarray:
        _, off, data = chunk
        h, ptr = word_hashes(data, off)
        at = window_starts(ptr, k)
        if not len(at):
            return np.zeros(0, np.uint64)
        m = minimizers(h, k)[at]
        return np.unique(m[np.r_[True, m[1:] != m[:-1]]])

    return keys


def _own_repeats(m: np.ndarray, at: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sorted minimizers that several documents of one chunk have."""
    first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)])
    doc = np.searchsorted(ptr, at[first], "right")
    v = m[first]
    order = np.argsort(v, kind="stable")
    v, doc = v[order], doc[order]
    return np.unique(v[1:][(v[1:] == v[:-1]) & (doc[1:] != doc[:-1])])


def _second_hash(h: np.ndarray, k: int) -> np.ndarray:
    return R.rolling(R.mix(h ^ R.MIX_1), k) & np.uint64(0xFFFFFFFF)


def _send_edges(k: int, n: int) -> Callable:
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = P.answered(right), []
        for chunk, payload in zip(left.column("chunk").to_pylist(), left.column("payload"), strict=True):
            ids, off, data = P.unpack_texts(payload)
            h, ptr = word_hashes(data, off)
            at = window_starts(ptr, k)
            if not len(at):
                continue
            m = minimizers(h, k)[at]
            at = at[P.within(m, known) | P.within(m, _own_repeats(m, at, ptr))]
            if not len(at):
                continue
            edge, check = R.rolling(h, k)[at], _second_hash(h, k)[at]
            doc = np.searchsorted(ptr, at, "right") - 1
            order = np.argsort(edge, kind="stable")
            e, d = edge[order], ids[doc[order]]
            first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            last = np.r_[first[1:], len(e)] - 1
            pick = order[first]
            several = (d[last] != d[first]).astype(np.int64)
            place = at[pick] * 2 + several
            e, c, d = e[first], check[pick], d[first]
            for b, x in P.by_bucket(e, n):
                out.append((b, chunk, R.squeeze((R.byte_planes(e[x], 8), R.byte_planes(c[x], 4), R.byte_planes(d[x], 8), R.byte_planes(place[x], 5)))))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([x[1] for x in out], pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())})

    return send


def join_edges(table: pa.Table) -> pa.Table:
    """For each chunk, its edges that a smaller document starts too, with the source: its document, chunk and place there."""
    parts = [[R.from_planes(y) for y in R.unsqueeze(x)] for x in table.column("blob").to_pylist()]
    edge, check, doc, place = (np.concatenate([p[i] for p in parts]) for i in range(4))
    chunk = np.repeat(table.column("chunk").to_numpy(), [len(p[0]) for p in parts])
    edge = edge.view(np.uint64)
    order = np.lexsort((chunk, doc, check, edge))
    e, c = edge[order], check[order]
    run = np.r_[True, (e[1:] != e[:-1]) | (c[1:] != c[:-1])]
    head = order[np.flatnonzero(run)][np.cumsum(run) - 1]
    source = np.empty(len(edge), np.int64)
    source[order] = head
    useful = (doc[source] < doc) | (place & 1 == 1)
    rows, end = [], np.cumsum([len(p[0]) for p in parts]).tolist()
    for own, bucket, p, j in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), parts, end, strict=True):
        x = j - len(p[0]) + np.flatnonzero(useful[j - len(p[0]) : j])
        if len(x):
            s = source[x]
            rows.append((own, bucket, R.squeeze((R.byte_planes(edge[x], 8), R.byte_planes(check[x], 4), R.byte_planes(doc[s], 8), R.byte_planes(place[s] >> 1, 5), R.byte_planes(chunk[s], 8)))))
    return pa.table({"chunk": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([x[1] for x in rows], pa.int64()), "blob": pa.array([x[2] for x in rows], pa.binary())})


def split_words(data: bytes, off: np.ndarray) -> list[bytes]:
    """The words of all documents of a chunk, one document after the other."""
    return [w for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for w in data[i:j].split()]


def digest(words: list[bytes]) -> bytes:
    return R.xxhash.xxh3_128_digest(b" ".join(words))


def paths(hit: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last edge of each nonbranching path among edges at the words `hit`, whose sources are at words `place` of a chunk."""
    if not len(hit):
        return hit, hit
    new = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1] + 1)])
    return new, np.r_[new[1:], len(hit)] - 1


def _compact(k: int) -> Callable:
    """Each chunk's spans, to the chunks of their sources: first word, number of words, first word at the source, digest."""

    def compact(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[R.from_planes(y) for y in R.unsqueeze(x)] for x in right.column("blob").to_pylist()]
        edges, checks, sources, places, homes = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(5))
        edges = edges.view(np.uint64)
        order = np.argsort(edges, kind="stable")
        edges, checks, sources, places, homes = (x[order] for x in (edges, checks, sources, places, homes))
        rows = []
        for own, payload in zip(left.column("chunk").to_pylist(), left.column("payload"), strict=True) if len(edges) else ():
            ids, off, data = P.unpack_texts(payload)
            h, ptr = word_hashes(data, off)
            at = window_starts(ptr, k)
            e = R.rolling(h, k)[at]
            found = np.minimum(np.searchsorted(edges, e), len(edges) - 1)
            ok = edges[found] == e
            at, found = at[ok], found[ok]
            ok = (checks[found] == _second_hash(h, k)[at].astype(np.int64)) & (sources[found] < ids[np.searchsorted(ptr, at, "right") - 1])
            hit, found = at[ok], found[ok]
            a, b = paths(hit, homes[found], places[found])
            start, size, place, home = hit[a], hit[b] - hit[a] + k, places[found[a]], homes[found[a]]
            words = split_words(data, off)
            for to in np.unique(home).tolist():
                x = np.flatnonzero(home == to)
                digests = b"".join(digest(words[i : i + n]) for i, n in zip(start[x].tolist(), size[x].tolist(), strict=True))
                rows.append((to, own, R.squeeze((R.byte_planes(start[x], 5), R.byte_planes(size[x], 5), R.byte_planes(place[x], 5), digests))))
        return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int64()), "chunk": pa.array([x[1] for x in rows], pa.int64()), "blob": pa.array([x[2] for x in rows], pa.binary())})

    return compact


def verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of the spans that ask for this chunk's words, those that have the same words, with the id and place of the source document."""
    rows = []
    for payload in left.column("payload") if right.num_rows else ():
        ids, off, data = P.unpack_texts(payload)
        count = [len(data[i:j].split()) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ptr, words = np.cumsum([0, *count]), split_words(data, off)
        known: dict[tuple[int, int], bytes] = {}  # copies ask for the same
        for to, blob in zip(right.column("chunk").to_pylist(), right.column("blob"), strict=True):
            start, size, place, digests = R.unsqueeze(blob.as_buffer())
            start, size, place = (R.from_planes(x) for x in (start, size, place))
            ok = []
            for i, x in enumerate(zip(place.tolist(), size.tolist(), strict=True)):
                if x not in known:
                    known[x] = digest(words[x[0] : x[0] + x[1]])
                ok.append(known[x] == digests[16 * i : 16 * i + 16])
            ok = np.array(ok, bool)
            doc = np.searchsorted(ptr, place[ok], "right") - 1
            rows.append((to, R.squeeze((R.byte_planes(start[ok], 5), R.byte_planes(size[ok], 5), R.byte_planes(ids[doc], 8), R.byte_planes(place[ok] - ptr[doc], 5)))))
    return pa.table({"chunk": pa.array([x[0] for x in rows], pa.int64()), "blob": pa.array([x[1] for x in rows], pa.binary())})


def digest_row(words: list, keep: np.ndarray | None, spans: Callable) -> tuple:
    kept = b" ".join(words if keep is None else compress(words, keep.tolist()))
    return hashlib.sha256(kept).hexdigest(), kept.decode()


def span_row(words: list, keep: np.ndarray | None, spans: Callable) -> tuple:
    kept = words if keep is None else compress(words, keep.tolist())
    return b" ".join(kept).decode(), spans()


def _remove(row: Callable, schema: pa.Schema) -> Callable:
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[R.from_planes(y) for y in R.unsqueeze(x)] for x in right.column("blob").to_pylist()]
        start, size, source, place = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(4))
        order = np.argsort(start)
        start, size, source, place = (x[order] for x in (start, size, source, place))
        columns = [[] for _ in schema.names]
        for payload in left.column("payload"):
            ids, off, data = P.unpack_texts(payload)
            at = 0
            for doc_id, i, j in zip(ids.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                words = data[i:j].split()
                x = np.arange(*np.searchsorted(start, [at, at + len(words)]))
                keep = np.ones(len(words), bool) if len(x) else None
                for s, n in zip((start[x] - at).tolist(), size[x].tolist(), strict=True):
                    keep[s : s + n] = False

                def spans(x: np.ndarray = x, at: int = at) -> list[dict]:
                    return [{"start": int(start[s] - at), "stop": int(start[s] - at + size[s]), "source_doc_id": int(source[s]), "source_start": int(place[s])} for s in x]

                lost = 0 if keep is None else len(words) - int(keep.sum())
                for c, v in zip(columns, (None if doc_id == R.NULL_ID else doc_id, len(words), lost, *row(words, keep, spans)), strict=True):
                    c.append(v)
                at += len(words)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, row: Callable = span_row, schema: str = SPANS) -> DataFrame:
    """docs (doc_id, text) with the words left after removing repeated windows, and the removed spans with their sources."""
    if window < PART:
        raise ValueError(f"a window has at least {PART} words")
    spark = R.attach(docs.sparkSession)
    n = R.partitions(spark)
    chunks = P.text_chunks(docs)
    known = P.repeated_keys(chunks, _minimizer_keys(window), n)
    edges = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_send_edges(window, n), P.ROWS)
    sources = edges.groupBy("bucket").applyInArrow(join_edges, P.ANSWERS)
    shape = {"long": pa.int64(), "string": pa.string()}  # and the list of spans
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source_doc_id", pa.int64()), ("source_start", pa.int32())]))
    arrow = pa.schema([(x.split(" ", 1)[0], shape.get(x.split(" ", 1)[1], span)) for x in schema.replace(", ", "\n").split("\n")])
    asked = chunks.groupBy("chunk").cogroup(sources.groupBy("chunk")).applyInArrow(_compact(window), P.ROWS)
    spans = chunks.groupBy("chunk").cogroup(asked.groupBy("bucket")).applyInArrow(verify, "chunk long, blob binary")
    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(_remove(row, arrow), schema)


def digest_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The digests of remove_repeats()'s rows, made in the task that has them, and as text the words that are left."""
    return remove_repeats(docs, window=window, row=digest_row, schema=DIGESTS)
