"""Operator 12: what each filter of a chain removes, in every order of the filters.

1. *Map side.* A partition of the RDD of documents gives each text the mask of the filters that it fails, once a
   distinct text: texts are held by fingerprint (xxhash), in chains of those that collide, with the full text and the
   smallest id. Rows that a smaller id of the same partition repeats are already known to be no minimum and go on
   without their text; of a text only one record goes on for each partition, so a text that a third of all rows
   repeats moves once a partition. Chains are handed on after CHAIN_BYTES of text.
2. *Routing.* partitionBy sends texts by fingerprint, rows that are decided by their own id. A partition stores the
   chains of its fingerprints, with full text (compressed) and minimum id, and emits the rows with an id that is no
   minimum as failing DUPLICATE. Their number follows from the bytes of the texts, PART_BYTES in each.
3. *Counts.* Rows of a few bytes meet their labels by id; combineByKey adds up, for each part, vectors that count rows
   by mask: all, good and toxic ones. Vectors have 3 * 2^filters numbers; a part that has a third of the rows is
   summed before the shuffle.
4. *Report.* The rows of a part, one for each order and step, are sums over its vector.

Nothing is collected. All is RDD lineage: a lost executor's partitions are made again.

Defined results: a null text is empty, a null source is the part "". A row without doc_id is never a duplicate and makes
none, and has no labels. Rows that repeat an id and its text are no duplicates of each other; each of them counts. Of
several labels of an id one that says so is enough; null labels say nothing. No documents give no rows. Other columns
are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R

#: Text that a map task holds before it hands its chains on; a few times that in memory.
CHAIN_BYTES = 32 << 20
#: Text, before compression, of one routed partition.
PART_BYTES = 128 << 20
DUPLICATE = "E"
CAPITALS, MARKS = bytes(range(0x41, 0x5B)), re.compile(rb"[#$%&*|]")
MASKS = "doc_id long, part string, mask int, n long"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}"

#: Letter and failure condition of each filter, of (UTF-8 text, its code points, its words).
FILTERS: dict[str, Callable[[bytes, int, list[bytes]], bool]] = {
    "A": lambda raw, n, words: len(words) < 200,
    "B": lambda raw, n, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda raw, n, words: 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * n,
    "D": lambda raw, n, words: MARKS.search(raw) is not None,
}


class Chains:
    """Texts by fingerprint. Each has its mask, its smallest id and how many rows of each part have that id."""

    def __init__(self, same: Callable[[bytes, bytes], bool]):
        self.chains: dict[int, list[list]] = {}
        self.same, self.size = same, 0

    def entry(self, key: int, text: bytes, make_mask: Callable[[], int]) -> list:
        chain = self.chains.setdefault(key, [])
        for e in chain:
            if self.same(e[0], text):
                return e
        e = [text, make_mask(), None, {}]
        chain.append(e)
        self.size += len(text)
        return e

    @staticmethod
    def put(e: list, doc_id: int, part: str, n: int) -> Iterator[tuple[int, str, int]]:
        """Adds n rows; yields id, part and number of those that are known now to have no minimum id."""
        if e[2] is None or doc_id < e[2]:
            yield from ((e[2], p, k) for p, k in e[3].items())
            e[2], e[3] = doc_id, {part: n}
        elif doc_id == e[2]:
            e[3][part] = e[3].get(part, 0) + n
        else:
            yield doc_id, part, n

    def entries(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.chains.items():
            for e in chain:
                yield key, e
        self.chains, self.size = {}, 0


def _route(filters: dict[str, Callable], chain_bytes: int) -> Callable:
    """Rows (doc_id, text, part) to (routing key, (text or null, doc_id, part, mask, n))."""
    duplicate = 1 << len(filters)

    def mask(raw: bytes, n: int) -> int:
        words = raw.split()  # bytes.split() splits at \x20 and \x09 to \x0D
        return sum(bool(fails(raw, n, words)) << i for i, fails in enumerate(filters.values()))

    def own(doc_id: int | None, part: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{doc_id} {part}") >> 1

    def route(rows: Iterator[tuple]) -> Iterator[tuple]:
        squeeze, held = zstandard.ZstdCompressor(level=1), Chains(bytes.__eq__)

        def handed_on() -> Iterator[tuple]:
            for key, (raw, m, low, parts) in held.entries():
                text = squeeze.compress(raw) if parts else None
                for part, n in parts.items():
                    yield key, (text, low, part, m, n)

        for doc_id, text, part in rows:
            raw = text.encode("utf-8", "surrogatepass")
            key = xxhash.xxh3_64_intdigest(raw) >> 1
            e = held.entry(key, raw, lambda: mask(raw, len(text)))  # noqa: B023
            if doc_id is None:
                yield own(doc_id, part), (None, doc_id, part, e[1], 1)
            else:
                for i, p, n in held.put(e, doc_id, part, 1):
                    yield own(i, p), (None, i, p, e[1] | duplicate, n)
            if held.size > chain_bytes:
                yield from handed_on()
        yield from handed_on()

    return route


def _judge(duplicate: int) -> Callable:
    """Routed records to rows (doc_id, part, mask, n)."""

    def judge(records: Iterator[tuple]) -> Iterator[tuple]:
        plain = zstandard.ZstdDecompressor()
        held = Chains(lambda a, b: a == b or plain.decompress(a) == plain.decompress(b))
        for key, (text, doc_id, part, m, n) in records:
            if text is None:
                yield doc_id, part, m, n
            else:
                for i, p, k in held.put(held.entry(key, text, lambda: m), doc_id, part, n):  # noqa: B023
                    yield i, p, m | duplicate, k
        for _, (_, m, low, parts) in held.entries():
            for part, n in parts.items():
                yield low, part, m, n

    return judge


def masks(docs: DataFrame, *, filters: dict[str, Callable] = FILTERS, chain_bytes: int = CHAIN_BYTES) -> RDD:
    """(doc_id, part, mask, n): n rows of docs (doc_id, text, source) that fail the filters in mask; its highest bit is DUPLICATE."""
    R.attach(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(R.partitions(docs.sparkSession), -(-size // PART_BYTES))
    return rows.rdd.mapPartitions(_route(filters, chain_bytes)).partitionBy(parts, lambda key: key).mapPartitions(_judge(1 << len(filters)))


def duplicate_ids(docs: DataFrame, **options) -> RDD:
    """The ids of docs (doc_id, text, source) whose text a smaller id has."""
    bit = 1 << len(options.get("filters", FILTERS))
    return masks(docs, **options).filter(lambda r: r[2] & bit).map(lambda r: r[0])


def reports(letters: str) -> Callable:
    """From (part, vector) to the rows of REPORT."""
    orders = list(itertools.permutations(range(len(letters))))
    mask = np.arange(1 << len(letters))
    steps = [(order, k, order[k], sum(1 << f for f in order[:k])) for order in orders for k in range(len(letters))]
    fails = np.array([(mask >> f) & 1 for _, _, f, _ in steps], bool)
    gone = np.array([mask & earlier for _, _, _, earlier in steps]) > 0
    own = np.array([f for _, _, f, _ in steps])
    names = ["".join(letters[f] for f in order) for order, _, _, _ in steps]

    def report(item: tuple) -> Iterator[tuple]:
        part, (rows, good, toxic) = item
        removed = (fails & ~gone) @ rows
        counts = [(~fails & ~gone) @ rows, removed, (fails & gone) @ rows, rows[1 << own], (fails & ~gone) @ good, (fails & ~gone) @ toxic]
        counts.append(np.bincount(own, removed, len(letters)).astype(np.int64)[own])
        for name, (_, k, _, _), *values in zip(names, steps, *(c.tolist() for c in counts), strict=True):
            yield (part, name, k + 1, *values)

    return report


def audit(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Callable] = FILTERS, chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """REPORT of docs (doc_id, text, source) with labels (doc_id, quality, toxic); at most seven filters with DUPLICATE."""
    letters = "".join(filters) + DUPLICATE
    if len(letters) > 7:
        raise ValueError("more than seven filters have too many orders")
    spark, width = R.attach(docs.sparkSession), 1 << len(letters)
    rows = spark.createDataFrame(masks(docs, filters=filters, chain_bytes=chain_bytes), MASKS, verifySchema=False)
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(yes("quality"), yes("toxic")).where("quality or toxic")
    # rows without an id meet no label: they are dealt out by number, so that they don't meet in one task
    known = known.withColumn("_salt", F.lit(-1).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    rows = rows.withColumn("_salt", salt).withColumn("_id", F.coalesce("doc_id", F.lit(0).cast("long"))).join(known, ["_id", "_salt"], "left")

    def vector(r: tuple) -> np.ndarray:
        return merged(np.zeros((3, width), np.int64), r)

    def merged(v: np.ndarray, r: tuple) -> np.ndarray:
        m, n, good, toxic = r
        v[0, m] += n
        v[1, m] += n if good else 0
        v[2, m] += n if toxic else 0
        return v

    pairs = rows.select("part", "mask", "n", "quality", "toxic").rdd.map(lambda r: (r[0], tuple(r)[1:]))
    vectors = pairs.combineByKey(vector, merged, lambda a, b: a + b, R.partitions(spark))
    return spark.createDataFrame(vectors.flatMap(reports(letters)), REPORT, verifySchema=False)
