"""Exact cosine neighbours of a stated set of query vectors, and approximate ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Bytes of query vectors that go to every task at once, and queries that are multiplied at once.
QUERY_BYTES, BLOCK = 128 << 20, 1024


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def ids_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that sorts as Spark does: numbers, or strings by code point."""
    return col.to_numpy(zero_copy_only=False) if pa.types.is_integer(col.type) else np.array(col.cast(pa.string()).to_pylist(), dtype=str)


def best(sim: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each row of sim, ranked by score, then by vec.

    Equal vectors may differ in their last bits, by their place in a matrix: scores are rounded to 12 digits, so they tie.
    """
    n = min(k, len(vec))
    edge = np.partition(sim, len(vec) - n, axis=1)[:, len(vec) - n]
    row, col = np.nonzero(sim >= edge[:, None] - 2e-12)
    score = np.round(sim[row, col], 12)
    order = np.lexsort((vec[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], col[keep], score[keep]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query's found (query_id, vec_id, similarity), with their rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, index: DataFrame, k: int, *, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k index vectors nearest to each query, by cosine, ties to the smaller vec_id.

    queries: (query_id, embedding). Up to query_bytes of them go to every task once, and the index is read in one pass
    without a shuffle: each batch answers with its own k best, and only those are ranked. More queries are asked in
    parts of that size, by hash of their id; each part's results are kept before the next one is read.
    """
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("e"))
    size = asked.agg(F.sum(8 * F.size("e").cast("long"))).first()[0] or 0
    parts = -(-size // query_bytes)
    if parts < 2:
        return _top_k(asked, index, k)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return reduce(DataFrame.unionByName, (checkpointed(_top_k(asked.where(part == i), index, k)) for i in range(parts)))


def _top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    spark = index.sparkSession
    asked = queries.orderBy("query_id").toArrow()
    schema = f"query_id long, vec_id {index.schema['vec_id'].dataType.simpleString()}, similarity double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema + ", rank int")
    ids, q = asked.column("query_id").to_numpy(), spark.sparkContext.broadcast(_unit(_matrix(asked.column("e").combine_chunks())))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, v = ids_of(b.column("vec_id")), _unit(_matrix(b.column("e")))
            for i in range(0, len(ids), BLOCK):
                sim = q.value[i : i + BLOCK] @ v.T
                row, col, score = best(sim, vec, k)
                yield pa.record_batch([pa.array(ids[i : i + BLOCK][row]), pa.array(vec[col]).cast(b.column("vec_id").type), pa.array(score)], names=["query_id", "vec_id", "similarity"])

    found = index.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).mapInArrow(nearest, schema)
    return ranked(found, k)


def floor_and_merge(hits: DataFrame, floor: float) -> DataFrame:
    """The best hit of each (question_id, vec_id) over a question's variants, at or above the floor; ties to the first variant, then rank.

    hits: question_id, variant, vec_id, similarity, rank.
    """
    w = Window.partitionBy("question_id", "vec_id").orderBy(F.desc("similarity"), "variant", "rank")
    return hits.where(F.col("similarity") >= floor).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lsh_top_k(queries: DataFrame, index: DataFrame, k: int, *, length: int, tables: int = 24, bits: int = 6, seed: int = 7) -> DataFrame:
    """Approximate neighbours by random hyperplanes: candidates share a code in one of the tables, scores are exact."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, length))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.einsum("nl,tbl->ntb", _matrix(b.column("e")), planes) > 0
            code = (bit * (1 << np.arange(bits))).sum(axis=2) + np.arange(tables) * (1 << bits)
            yield pa.record_batch([b.column("id"), b.column("e"), pa.array(list(code.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "e", "codes"])

    coded = lambda df, name: df.select(F.col(name).alias("id"), F.col("embedding").cast("array<double>").alias("e")).mapInArrow(codes, "id long, e array<double>, codes array<int>").select("id", "e", F.explode("codes").alias("code"))
    a, b = coded(queries, "query_id").select(F.col("id").alias("query_id"), F.col("e").alias("q"), "code"), coded(index, "vec_id").select(F.col("id").alias("vec_id"), F.col("e").alias("v"), "code")
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, "code").dropDuplicates(["query_id", "vec_id"]).select("query_id", "vec_id", dot.alias("similarity"))
    return ranked(pairs, k)
