"""Operator 6: removal of repeated byte strings by interval expansion on a Burrows-Wheeler transform.

A string of `length` bytes is removed wherever it starts in two or more places of the corpus.

1. *Distribution.* The minimizer of a string (the smallest hash among its 32-byte parts) is the same
   wherever the string occurs. Chunks learn which minimizers occur in several places; only the regions
   around those can repeat. Each region goes to the bucket of its minimizer, so equal strings meet.
   Equal regions count once, before and after the shuffle.
2. *Suffix array.* A bucket sorts the suffixes of its distinct regions by prefix doubling, to the depth
   that the length asks for, and takes the Burrows-Wheeler transform from that order.
3. *Threshold-bounded interval expansion.* Intervals of the transform are extended backward breadth
   first, one byte a level. The first interval that ends before a row gives that row its common prefix
   with the row above; so prefixes are derived by increasing value. The search stops at the length:
   rows still without a value share at least that many bytes with the row above.
4. The covered stretches go back to the chunks, which cut them out.

Matches are matches of bytes, never of hashes; a hash collision only adds candidates.

Defined results: a null text is empty. Rows with a null or repeated doc_id are documents of their own.
Texts shorter than the length lose nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats as P
from . import runtime as R

LENGTH, PART = 400, 32
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,stop:int>>"
#: Symbols in one word of the first sort: 9 bits each, 0 stands for the end of a region.
FIRST = 7
BLOCK = 1 << 16

_TABLE = R.mix(np.arange(1, 257, dtype=np.uint64) * R.GOLDEN)


def part_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the PART bytes from each place, by doubling."""
    h = _TABLE[data]
    with np.errstate(over="ignore"):
        size, odd = 1, R.GOLDEN
        while size < PART:
            h = h[:-size] * odd + h[size:]
            odd = odd * R.GOLDEN
            size *= 2
    return R.mix(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of the w values from each place, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


def window_minimizers(data: bytes, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside documents, the minimizer of each, and the hashes of all parts.

    Hashes and minima are made for BLOCK windows at a time, whose arrays stay in the processor's cache.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    text, w = np.frombuffer(data, np.uint8), length - PART + 1
    h, m = np.empty(len(data) - PART + 1, np.uint64), np.empty(len(data) - length + 1, np.uint64)
    for i in range(0, len(m), BLOCK):
        own = part_hashes(text[i : min(i + BLOCK, len(m)) + length - 1])
        h[i : i + len(own)] = own
        m[i : i + BLOCK] = sliding_min(own, w)
    at = R.spread(np.maximum(np.diff(off) - length + 1, 0), off[:-1])
    return at, m[at], h


def runs(at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring windows with one minimizer begin."""
    return np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)


def _anchor_keys(length: int) -> Callable:
    def keys(chunk: tuple) -> np.ndarray:
        at, m, _ = window_minimizers(chunk[2], chunk[1], length)
        return np.unique(m[runs(at, m)])

    return keys


def _overlapping(at: np.ndarray, m: np.ndarray, h: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Which runs may hold two equal windows, that is, overlapping ones.

    If windows i and i + d of a run are equal, the parts from i on have period d. So the minimizer is the first
    part of one of the windows i to i + d - 1, and the last part of one of the windows i + 1 to i + d: at
    two different places, unless d is over length - PART, which makes the run longer than one place can.
    """
    out = size > length - PART + 1
    head, tail = np.flatnonzero(h[at] == m), np.flatnonzero(h[at + length - PART] == m)
    a, b = np.searchsorted(head, first), np.searchsorted(tail, first + size) - 1
    both = np.flatnonzero((a < np.searchsorted(head, first + size)) & (b >= np.searchsorted(tail, first)))
    out[both] |= at[head[a[both]]] < at[tail[b[both]]] + length - PART
    return out


def _own_repeats(at: np.ndarray, m: np.ndarray, h: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Minimizers that occur twice in one chunk: in two runs, or at two places of one run."""
    v, n = np.unique(m[first], return_counts=True)
    return np.union1d(v[n > 1], m[first[_overlapping(at, m, h, first, size, length)]])


def regions(at: np.ndarray, m: np.ndarray, h: np.ndarray, off: np.ndarray, known: np.ndarray, length: int, n: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, starts, stops) of the stretches whose windows have a repeated minimizer of that bucket.

    Stretches of one bucket share fewer than `length` bytes, so that no window is in two of them.
    """
    first = runs(at, m)
    size = np.diff(np.r_[first, len(at)])
    ok = P.within(m[first], known) | P.within(m[first], _own_repeats(at, m, h, first, size, length))
    first, size = first[ok], size[ok]
    start, stop, to = at[first], at[first] + size - 1 + length, P.bucket_of(m[first], n)
    doc = np.searchsorted(off, start, "right")
    order = np.lexsort((start, to))
    start, stop, to, doc = start[order], stop[order], to[order], doc[order]
    if not len(start):
        return []
    new = np.r_[True, (to[1:] != to[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > np.maximum.accumulate(stop + to * (off[-1] + 1))[:-1] - to[1:] * (off[-1] + 1) - length)]
    a = np.flatnonzero(new)
    start, stop, to = start[a], np.maximum.reduceat(stop, a), to[a]
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return [(int(to[i]), start[i:j], stop[i:j]) for i, j in zip(cut, np.r_[cut[1:], len(to)], strict=True)]


def _send_regions(length: int, n: int) -> Callable:
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = P.answered(right), []
        for chunk, payload in zip(left.column("chunk").to_pylist(), left.column("payload"), strict=True):
            _, off, data = P.unpack_texts(payload)
            at, m, h = window_minimizers(data, off, length)
            for bucket, start, stop in regions(at, m, h, off, known, length, n):
                places: dict[bytes, list[int]] = {}
                for i, j in zip(start.tolist(), stop.tolist(), strict=True):
                    places.setdefault(data[i:j], []).append(i)
                sizes, counts = (np.array([len(x) for x in y], np.int32) for y in (places, places.values()))
                out.append((bucket, chunk, R.squeeze((sizes, b"".join(places), counts, np.array([i for x in places.values() for i in x], np.int32)))))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "chunk": pa.array([x[1] for x in out], pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())})

    return send


def bounded_suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of text in order of the suffixes' first `depth` symbols or more, and the rows that differ
    from the row above in the first FIRST symbols.

    text: bytes + 1, with a 0 at the end of each region. Ends of different regions differ, in the order of the regions.
    """
    n = len(text)
    padded = np.r_[text, np.zeros(FIRST, text.dtype)].astype(np.int64)
    key = padded[:n].copy()
    for i in range(1, FIRST):
        key <<= 9
        key |= padded[i : i + n]
    ended, ends, before = np.zeros(n, bool), np.flatnonzero(text == 0), np.r_[-1, np.flatnonzero(text == 0)[:-1]]
    for i in range(FIRST):  # words that reach an end have nothing after it
        at = ends[ends - i > before] - i
        key[at] &= -1 << 9 * (FIRST - 1 - i)
        ended[at] = True
    order = np.argsort(key).astype(np.int32)
    rows = np.flatnonzero(ended[order])  # ends keep the order of the regions everywhere
    at = order[rows]
    order[rows] = at[np.lexsort((at, key[at]))]
    k, ended = key[order], ended[order]
    new = np.r_[True, (k[1:] != k[:-1]) | ended[1:]]
    early, have = new.copy(), FIRST
    rank = np.empty(n, np.int32)
    while True:
        if have >= depth or new.all():
            return order, early
        group = np.cumsum(new, dtype=np.int32)
        rank[order] = group
        rest = np.flatnonzero(~(new & np.r_[new[1:], True]))
        at = order[rest]
        key = group[rest] * np.int64(n + 2) + rank[np.minimum(at + have, n - 1)]
        by = np.argsort(key)
        order[rest], key = at[by], key[by]
        new[rest] |= np.r_[True, key[1:] != key[:-1]]
        have *= 2


def long_common_prefixes(text: np.ndarray, order: np.ndarray, early: np.ndarray, length: int) -> np.ndarray:
    """Rows of the suffix order that share at least `length` symbols with the row above.

    The search begins with the intervals of all words of FIRST symbols, whose ends the first sort found.
    """
    n = len(text)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    back = row[order - 1]  # the row of the suffix one symbol longer; at place 0 it wraps to the last end mark
    letter = text[order - 1].astype(np.int64)  # the Burrows-Wheeler transform
    letter = np.where(letter == 0, 257 + np.arange(n), letter)  # every end mark is a symbol of its own
    open_rows = np.append(~early, False)
    mark = np.full(n + 2, -1, np.int64)
    lo, span = np.flatnonzero(early), 257 + n
    hi = np.append(lo[1:], n)
    for _ in range(FIRST, length):
        size = hi - lo
        at = R.spread(size, lo)
        if not len(at):
            break
        to = back[at]
        own = np.repeat(np.arange(len(lo)), size) * span + letter[at]
        mark[to + 1] = own
        last = mark[to + 2] != own
        ends, whose = to[last], own[last]
        begins = to[mark[to] != own]
        firsts = own[mark[to] != own]
        mark[to + 1] = -1
        a, b = np.argsort(firsts), np.argsort(whose)
        begins, ends = begins[a], ends[b]
        new = open_rows[ends + 1]
        lo, hi = begins[new], ends[new] + 1
        open_rows[hi] = False
    return np.flatnonzero(open_rows[:n])


def repeated_windows(texts: list[bytes], several: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct text, the starts of its windows that occur elsewhere too; all of them where several is set."""
    size = np.array([len(x) + 1 for x in texts], np.int64)
    start = np.cumsum(size) - size
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + 1
    text[start + size - 1] = 0
    order, early = bounded_suffix_order(text, length)
    rows = long_common_prefixes(text, order, early, length)
    hit = np.zeros(len(text), bool)
    hit[order[rows]] = True
    hit[order[rows - 1]] = True
    whole = np.repeat(several & (size > length), size)
    inside = R.spread(np.maximum(size - length, 0), start)
    hit[inside] |= whole[inside]
    return [np.flatnonzero(hit[i : i + k]) for i, k in zip(start.tolist(), size.tolist(), strict=True)]


def stretches(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows from these starts, joined where they touch: starts and sizes."""
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + length])
    last = np.r_[new[1:], len(starts)] - 1
    return starts[new], starts[last] + length - starts[new]


def _expand(length: int) -> Callable:
    def expand(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        several, parts = [], []
        for blob in table.column("blob"):
            sizes, data, counts, places = R.unsqueeze(blob.as_buffer())
            own, at = [], 0
            for k, c in zip(sizes.tolist(), counts.tolist(), strict=True):
                x, at = data[at : at + k], at + k
                i = known.setdefault(x, len(known))
                if i == len(several):
                    several.append(c > 1)
                else:
                    several[i] = True
                own.append(i)
            parts.append((own, counts, places))
        found = [stretches(x, length) if len(x) else None for x in repeated_windows(list(known), np.array(several), length)]
        rows = []
        for chunk, (own, counts, places) in zip(table.column("chunk").to_pylist(), parts, strict=True):
            end, start, size = np.cumsum(counts).tolist(), [], []
            for i, c, e in zip(own, counts.tolist(), end, strict=True):
                if found[i]:
                    for p in places[e - c : e].tolist():
                        start.append(found[i][0] + p)
                        size.append(found[i][1])
            if start:
                rows.append((chunk, R.squeeze((np.concatenate(start).astype(np.int32), np.concatenate(size).astype(np.int32)))))
        return pa.table({"chunk": pa.array([x[0] for x in rows], pa.int64()), "blob": pa.array([x[1] for x in rows], pa.binary())})

    return expand


def digest_row(text: np.ndarray, keep: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple:
    kept = text[keep].tobytes()
    return hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")


def span_row(text: np.ndarray, keep: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple:
    return text[keep].tobytes(), [{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _cut(row: Callable, schema: pa.Schema) -> Callable:
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [[] for _ in schema.names]
        parts = [R.unsqueeze(x.as_buffer()) for x in right.column("blob")]
        for payload in left.column("payload"):
            ids, off, data = P.unpack_texts(payload)
            cover = np.zeros(len(data) + 1, np.int32)
            for start, size in parts:
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
            keep, text = np.cumsum(cover[:-1]) == 0, np.frombuffer(data, np.uint8)
            for i, doc_id in enumerate(ids.tolist()):
                k = keep[off[i] : off[i + 1]]
                edge = np.flatnonzero(np.diff(np.r_[1, k, 1]))
                starts, stops = edge[::2], edge[1::2]
                for c, v in zip(columns, (None if doc_id == R.NULL_ID else doc_id, len(k), int((stops - starts).sum()), len(starts), *row(text[off[i] : off[i + 1]], k, starts, stops)), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, row: Callable = span_row, schema: str = SPANS) -> DataFrame:
    """docs (doc_id, text): the bytes left after removing repeated strings, and the spans removed."""
    if length < 2 * PART:
        raise ValueError(f"a string has at least {2 * PART} bytes")
    spark = R.attach(docs.sparkSession)
    n = R.partitions(spark)
    chunks = P.text_chunks(docs)
    known = P.repeated_keys(chunks, _anchor_keys(length), n)
    sent = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_send_regions(length, 2 * n), P.ROWS)
    found = sent.groupBy("bucket").applyInArrow(_expand(length), "chunk long, blob binary")
    base = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    last = [("kept_sha256", pa.string()), ("text", pa.string())] if schema == DIGESTS else [("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_cut(row, pa.schema(base + last)), schema)


def digest_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """The digests of remove_repeats()'s rows, made in the task that has them, and as text what is left but for
    characters that a removal cuts."""
    return remove_repeats(docs, length=length, row=digest_row, schema=DIGESTS)
