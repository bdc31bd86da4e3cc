"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sources get targets: their weights share a multiple of all words; what lies above `most` times a
   source's own words is shared again among the rest, until none lies above.
2. Each source's documents fall into blocks by a hash of their id: a random permutation cut in blocks.
   A source is drawn from in whole passes and one partial pass over its blocks, in block order, which is a
   random one as the permutation is; the block where the target lies is taken document by document, so a
   source ends within one document of its target. These blocks are the source's quota.
3. The draws of all sources are dealt to output shards by a splitting tree: at each node a multivariate
   hypergeometric draw decides how many blocks of each source go left. Quotas stay exact, shards are
   equally long, and the running offsets give every shard its own, disjoint range of each source's
   draws. A shard finds its leaf by itself from the root; nothing but the quotas is shared.
4. Each shard's documents are shuffled locally, by hash.

The driver sees one row a source (its words, its quota), never documents; `max_sources` bounds that.

Defined results: a null text has no words; a null source is a source of its own, after all others. A
source without words has target 0. Documents without words are never drawn. Repeated rows are drawn as
documents of their own. Same input and seed, same mix, however rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
BLOCK_WORDS, SHARD_WORDS, MAX_BLOCKS, MAX_SOURCES, BROADCAST_SOURCES = 1 << 16, 1 << 24, 1 << 20, 1 << 20, 10_000
#: Shards of a mix and blocks of a source, however small they are.
LEAST_SHARDS, LEAST_BLOCKS = 16, 64
SIZED = "doc_id long, source string, size long"


def word_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many words each document has: places where a word starts, after white space or a document's start."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = ~white
    start[1:] &= white[:-1]
    begins = off[:-1][off[1:] > off[:-1]]
    start[begins] = ~white[begins]
    total = np.r_[0, np.cumsum(start)]
    return total[off[1:]] - total[off[:-1]]


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in R.slices(batches, "text"):
        yield pa.record_batch([b.column("doc_id"), b.column("source"), pa.array(word_counts(*R.flat_utf8(b.column("text"))), pa.int64())], names=["doc_id", "source", "size"])


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """The words that each source is to give; sizes in the order of the sources."""
    w = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    pool, out, left = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while left:
        unit = pool / sum(w[i] for i in left)
        above = {i for i in left if unit * w[i] > most * sizes[i]}
        for i in above or left:
            out[i] = Fraction(most * sizes[i]) if above else unit * w[i]
        if not above:
            break
        pool -= sum(out[i] for i in above)
        left -= above
    return [float(x) for x in out]


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """From where to where a shard's own draws reach, of each source."""
    start, own, lo, hi, node = np.zeros(len(quotas), np.int64), quotas.astype(np.int64), 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, node])))
        left = rng.multivariate_hypergeometric(own, int(own.sum()) * (mid - lo) // (hi - lo), method="marginals") if own.sum() else own
        if shard < mid:
            own, hi, node = left, mid, 2 * node
        else:
            start, own, lo, node = start + left, own - left, mid, 2 * node + 1
    return start, start + own


def _deal(quotas: list[int], blocks: list[int], shards: int, seed: int) -> Callable:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("id").to_pylist():
                start, stop = leaf(np.array(quotas, np.int64), shards, shard, seed)
                sid = np.repeat(np.arange(len(quotas)), stop - start)
                k, n = R.spread(stop - start, start), np.array(blocks, np.int64)[sid]
                yield pa.record_batch([pa.array(sid, pa.int32()), pa.array(k % n, pa.int64()), pa.array(k // n, pa.int32()), pa.array(np.full(len(k), shard), pa.int32())], names=["sid", "block", "epoch", "shard"])

    return deal


def drawn(docs: DataFrame, *, weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, least_blocks: int = LEAST_BLOCKS, least_shards: int = LEAST_SHARDS, seed: int = 0, max_sources: int = MAX_SOURCES) -> DataFrame:
    """Every row of docs (doc_id, text, source) with its size, source_size, target and draws: (epoch, shard) each."""
    spark = R.attach(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    sized = R.checkpointed(sized.mapInArrow(_size, SIZED))
    rows = sized.groupBy("source").agg(F.sum("size").alias("words")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold their totals")
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode()))
    words = [int(r.words) for r in rows]
    goal = targets(words, weights, share, most)
    blocks = [min(MAX_BLOCKS, max(least_blocks, -(-w // block_words))) for w in words]
    whole = [int(t // w) if w else 0 for t, w in zip(goal, words, strict=True)]
    rest = [t - k * w for t, k, w in zip(goal, whole, words, strict=True)]
    plan = spark.createDataFrame([(i, r.source, *x) for i, (r, *x) in enumerate(zip(rows, words, goal, blocks, whole, rest, strict=True))], "sid int, name string, source_size long, target double, blocks long, whole int, rest double")
    if len(rows) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    key = F.xxhash64("doc_id", "size", F.lit(seed))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn("key", key).withColumn("block", F.pmod("key", "blocks"))

    by_block = placed.where("size > 0").groupBy("sid", "block", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("sid").orderBy("block"))
    edge = by_block.withColumn("before", upto - F.col("words")).where("before < rest").groupBy("sid", "rest").agg(F.max("block").alias("last"), F.max("before").alias("before"))
    edge = R.checkpointed(edge.select("sid", "last", (F.col("rest") - F.col("before")).alias("left")))
    last = {r.sid: r.last for r in edge.select("sid", "last").collect()}
    quotas = [k * n + (last[i] + 1 if i in last else 0) for i, (k, n) in enumerate(zip(whole, blocks, strict=True))]

    shards = max(least_shards, round(sum(goal) / shard_words))
    dealt = spark.range(0, shards, 1, max(1, min(shards, R.partitions(spark)))).mapInArrow(_deal(quotas, blocks, shards, seed), "sid int, block long, epoch int, shard int")
    lists = dealt.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))

    # In the block where a source's target lies, the partial pass takes documents up to there.
    border = edge.select("sid", F.col("last").alias("block"), "left")
    inside = placed.where("size > 0").join(border, ["sid", "block"])
    run = F.sum("size").over(Window.partitionBy("sid", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("beyond", run - F.col("size") / 2 > F.col("left")).drop("left")
    others = placed.join(border.select("sid", "block"), ["sid", "block"], "left_anti").unionByName(placed.where("size = 0").join(border.select("sid", "block"), ["sid", "block"], "left_semi"))
    every = inside.unionByName(others.withColumn("beyond", F.lit(False))).join(lists, ["sid", "block"], "left")
    none = F.expr("cast(array() as array<struct<epoch:int,shard:int>>)")
    kept = F.when(F.col("draws").isNull() | (F.col("size") == 0), none).when(F.col("beyond"), F.expr("filter(draws, x -> x.epoch < whole)")).otherwise(F.col("draws"))
    return every.select("doc_id", "source", "size", "source_size", "target", kept.alias("draws"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: shard, place, doc_id, epoch; documents of a shard in shuffled order."""
    x = drawn(docs, **options).select("doc_id", F.explode("draws").alias("d")).select("d.shard", "d.epoch", "doc_id")
    order = F.xxhash64("shard", "epoch", "doc_id")
    return x.withColumn("place", order).repartition("shard").sortWithinPartitions("shard", "place")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (that of each draw, by epoch) for every row."""
    return drawn(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))
