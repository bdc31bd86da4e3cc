"""A stored vector index: inverted lists as clustered files, of which a search reads only some.

Building draws a bounded sample of the vectors, finds as many centroids as the square root of their number on the
driver, and writes all rows by the list of their nearest centroid, a folder a list. Beside them stand the lists: centroid,
rows, and the least cosine of any member to the centroid. How many lists a search visits is fitted to the recall within
the sample.

A search reads the files of the lists that some query visits, in one pass without a shuffle: queries go to every task in
parts of bounded bytes, and a batch of a list meets only the queries that visit it. An exact search then visits what is
left of the lists that can hold a better vector: the angle between a query and a member is at least the one to the
centroid less the list's widest.

Defined results: null vectors stay in the index and are never found, null query vectors find nothing. Zero vectors have
similarity 0 to everything. Ties go to the smaller id. An empty index, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..storage import attach, checkpointed
from .knn import BLOCK, _matrix, _unit, best, ids_of, ranked

#: Vectors in the sample, lists at most, steps of the centroids, recall to fit and the neighbours it is fitted for.
SAMPLE, LISTS, STEPS, RECALL, FITTED = 32_768, 4096, 8, 0.97, 10
#: Bytes of query vectors that go to every task at once.
QUERY_BYTES = 16 << 20
#: Where the lists are told about, in a version's folder; Spark reads no folder with such a name as data.
ABOUT, LIST, NO_VECTOR = "_lists", "list", -1


def centroids(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit vectors of that many lists, by spherical k-means; empty ones go."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(STEPS):
        near = nearest_list(sample, c)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        full = np.bincount(near, minlength=len(c)) > 0
        c = _unit(total[full])
    return c


def nearest_list(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(v[i : i + BLOCK] @ c.T).argmax(axis=1) for i in range(0, len(v), BLOCK)]) if len(v) else np.zeros(0, np.int64)


def fitted_probe(sample: np.ndarray, c: np.ndarray, recall: float) -> int:
    """How many lists, nearest first, hold that share of the sample's FITTED nearest neighbours of up to 256 of its vectors."""
    own, ranks = nearest_list(sample, c), []
    for i, q in enumerate(sample[:256]):
        sim = sample @ q
        sim[i] = -2
        n = min(FITTED, max(1, len(sample) - 1))
        near = np.argpartition(-sim, n - 1)[:n]
        place = np.argsort(np.argsort(-(c @ q)))
        ranks.append(place[own[near]])
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1


def write(df: DataFrame, path: str, *, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, seed: int = 7) -> dict:
    """Writes df by lists of `vector` to a new folder; what publish() tells about it. df gets a column `list`."""
    attach(df.sparkSession)
    n = df.count()
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("e"))
    # a bounded sample that doesn't depend on how the rows are dealt out
    drawn = rows.orderBy(F.xxhash64("e", F.lit(seed))).limit(sample).toArrow()
    v = _unit(_matrix(drawn.column("e").combine_chunks())) if drawn.num_rows else np.zeros((0, 1))
    c = centroids(v, lists or min(LISTS, max(1, round(n**0.5))), seed) if len(v) else v
    probe = fitted_probe(v, c, recall) if len(v) > 1 else 1
    schema = P.StructType([*df.schema.fields, P.StructField("_cosine", P.DoubleType()), P.StructField(LIST, P.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(vector)
            has = col.is_valid().to_numpy(zero_copy_only=False)
            own, cosine = np.full(len(col), NO_VECTOR, np.int32), np.zeros(len(col))
            if has.any():
                x = _unit(_matrix(col.drop_null()))
                own[has] = near = nearest_list(x, c)
                cosine[has] = (x * c[near]).sum(axis=1)
            yield pa.record_batch([*b.columns, pa.array(cosine), pa.array(own)], names=[*b.schema.names, "_cosine", LIST])

    # rebalanced: a list that has many rows is several tasks and files
    assigned = df.mapInArrow(assign, schema).hint("rebalance", LIST)
    (assigned.write.partitionBy(LIST) if n else assigned.write).parquet(path)  # of no rows, folders would keep no schema
    told = {r[LIST]: r for r in df.sparkSession.read.parquet(path).where(F.col(LIST) >= 0).groupBy(LIST).agg(F.count("*").alias("n"), F.min("_cosine").alias("least")).collect()}
    about = [(i, told[i].n, told[i].least, x.tolist()) for i, x in enumerate(c) if i in told]
    df.sparkSession.createDataFrame(about, "list int, n long, least double, centroid array<double>").coalesce(1).write.parquet(f"{path}/{ABOUT}")
    return {"clustered_by": vector, "lists": len(about), "probe": probe}


@dataclass
class Lists:
    """A version's lists, on the driver: at most LISTS of them."""

    number: np.ndarray
    least: np.ndarray
    centroid: np.ndarray

    def near(self, q: np.ndarray, probe: int) -> list[np.ndarray]:
        """For each list, the queries (by row) that visit it among their `probe` nearest."""
        return self._visits(np.argsort(-(q @ self.centroid.T), axis=1, kind="stable")[:, :probe]) if len(q) else []

    def _visits(self, chosen: np.ndarray) -> list[np.ndarray]:
        row = np.repeat(np.arange(len(chosen)), chosen.shape[1])
        order = np.argsort(chosen.ravel(), kind="stable")
        return np.split(row[order], np.searchsorted(chosen.ravel()[order], np.arange(1, len(self.number))))

    def left(self, q: np.ndarray, floor: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
        """For each list, the queries that haven't visited it, and for which it may hold a vector with their floor."""
        angle = np.arccos(np.clip(q @ self.centroid.T, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
        # 1e-6: what rounding may do to an angle near 0
        may = np.cos(np.maximum(angle - 1e-6, 0)) >= floor[:, None] - 1e-9
        for i, rows in enumerate(seen):
            may[rows, i] = False
        return [np.flatnonzero(may[:, i]) for i in range(len(self.number))]


def lists(spark: SparkSession, path: str) -> Lists:
    rows = spark.read.parquet(f"{path}/{ABOUT}").orderBy("list").collect()
    return Lists(np.array([r["list"] for r in rows], np.int64), np.array([r.least for r in rows]), np.array([r.centroid for r in rows]).reshape(len(rows), -1 if rows else 0))


def rows_of(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The index's rows in these lists; no other files are read."""
    return spark.read.parquet(path).where(F.col(LIST).isin(numbers) if numbers else F.lit(False)).drop("_cosine")


def _scan(spark: SparkSession, path: str, key: str, vector: str, numbers: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each batch for each query, among the lists that the query visits."""
    asked = {int(i): rows for i, rows in zip(numbers, visits, strict=True) if len(rows)}
    rows = rows_of(spark, path, sorted(asked))
    shared = spark.sparkContext.broadcast((asked, ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_list, query_ids, vectors = shared.value
        for b in batches:
            own = b.column(LIST).to_numpy()
            order = np.argsort(own, kind="stable")
            names, v = ids_of(b.column("vec_id")), _unit(_matrix(b.column("e"))) if len(own) else None
            for number, at in zip(*np.unique(own[order], return_index=True), strict=True):
                members = order[at : np.searchsorted(own[order], number, "right")]
                for i in range(0, len(by_list[number]), BLOCK):
                    some = by_list[number][i : i + BLOCK]
                    sim = vectors[some] @ v[members].T
                    row, col, score = best(sim, names[members], k)
                    yield pa.record_batch([pa.array(query_ids[some[row]]), pa.array(names[members[col]]).cast(b.column("vec_id").type), pa.array(score)], names=["query_id", "vec_id", "similarity"])

    kind = rows.schema[key].dataType.simpleString()
    picked = rows.where(F.col(vector).isNotNull()).select(LIST, F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
    return picked.mapInArrow(scan, f"query_id long, vec_id {kind}, similarity double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probe: int, exact: bool = False, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, vec_id, similarity, rank: nearest rows of the index at path (a version's folder) to queries (query_id, embedding).

    probe: how many lists a query visits, of those nearest to it; exact: lists that may hold something better follow.
    """
    attach(spark)
    about = lists(spark, path)
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("e"))
    kind = spark.read.parquet(path).schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id long, vec_id {kind}, similarity double, rank int")
    if not len(about.number):
        return out
    size = asked.agg(F.sum(8 * F.size("e").cast("long"))).first()[0] or 0
    parts = -(-size // query_bytes)
    for i in range(parts):
        some = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).orderBy("query_id").toArrow()
        ids, q = some.column("query_id").to_numpy(), _unit(_matrix(some.column("e").combine_chunks()))
        visits = about.near(q, probe)
        found = ranked(_scan(spark, path, key, vector, about.number, visits, ids, q, k), k)
        if exact:
            found = checkpointed(found)
            floor = np.full(len(ids), -np.inf)
            for r in found.where(F.col("rank") == k).select("query_id", "similarity").collect():  # one row a query of this part
                floor[np.searchsorted(ids, r.query_id)] = r.similarity
            left = about.left(q, floor, visits)
            if any(map(len, left)):
                more = _scan(spark, path, key, vector, about.number, left, ids, q, k)
                found = ranked(found.drop("rank").unionByName(more), k)
        out = out.unionByName(checkpointed(found) if parts > 1 else found)
    return out


def searcher(spark: SparkSession, path: str, meta: dict, *, key: str, exact: bool = False) -> Callable[[DataFrame, int], DataFrame]:
    """Searches of the version that meta describes, as retrieval calls them."""
    return lambda queries, k: search(spark, f"{path.rstrip('/')}/{meta['version']}", queries, k, probe=meta["probe"], exact=exact, key=key, vector=meta["clustered_by"])
