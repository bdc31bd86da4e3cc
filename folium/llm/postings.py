"""Operator 10: approximate nearest neighbours by balanced posting lists.

1. *Lists.* A bounded sample (FIT_ROWS vectors, by hash of their id) is halved again and again at the
   median along the line between two far centres, so that the sample's lists are equally long; their
   mean directions are the centroids, about the square root of the number of vectors, MAX_LISTS at most.
2. *Graph.* Centroids are searched best first on an in-memory graph of near neighbours, its size bounded
   by MAX_LISTS; it is all that is broadcast.
3. *Index.* Every vector is stored in its nearest list, and boundary vectors in every list whose centroid
   is at most `boundary` times farther. Lists of more than LIST_ROWS rows are dealt out in parts of
   that size, all of which a query of the list visits: a very common vector makes no task larger.
4. *Search.* A query visits the lists whose centroids lie within `ratio` times the distance of the
   nearest one. The ratio is fitted to the table: the least one that finds `recall` of the true neighbours
   of PROBES vectors of the sample, within the sample. It is near 1 where the data have clusters; where they
   haven't, every way of pruning by distance must visit most lists.
5. *Two rounds.* The nearest lists of a query, the square root of those that it visits, come first; the k-th
   best score found there bounds the second round, whose lists return only what reaches it. So a query
   gathers about the square root of its lists, not all of them, times k rows. Cosines are exact, in double
   precision.

Defined results: vectors that are null, zero, hold null or non-finite components, have no id or not the
commonest length take no part. Rows that share an id are one candidate, at its best score. Ties go to
the smaller id. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runtime as R

K, EVERY = 5, 50
FIT_ROWS, MAX_LISTS, LIST_ROWS, NEAR, ENTRIES = 1 << 16, 4096, 512, 16, 8
BOUNDARY, RECALL, PROBES = 1.02, 0.96, 512
#: The graph is followed as long as centroids lie within this ratio, whatever is asked for, so as not to end in a local best.
EXPLORED = 1.2
ASKED = "id long, v array<double>, list int, near int, visited int"
FOUND = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Mean directions of `lists` parts of equal size."""
    rng, out = np.random.default_rng(seed), []

    def cut(at: np.ndarray, n: int) -> None:
        if n <= 1 or len(at) <= 1:
            c = x[at].mean(axis=0)
            size = np.linalg.norm(c)
            out.append(c / size if size > 1e-12 else x[at[0]])
            return
        a = x[at[rng.integers(len(at))]]
        a = x[at[np.argmin(x[at] @ a)]]
        b = x[at[np.argmin(x[at] @ a)]]
        for _ in range(4):
            side = x[at] @ (a - b)
            mid = np.median(side)
            left = side > mid
            if not left.any() or left.all():
                break
            a, b = x[at[left]].mean(axis=0), x[at[~left]].mean(axis=0)
        half = n // 2
        order = np.argsort(-(x[at] @ (a - b)), kind="stable")
        k = round(len(at) * half / n)
        cut(at[order[:k]], half)
        cut(at[order[k:]], n - half)

    cut(np.arange(len(x)), min(lists, len(x)))
    return np.array(out)


class CentroidGraph:
    """Centroids and the links between near ones."""

    def __init__(self, centroids: np.ndarray):
        self.c, n = centroids, len(centroids)
        near = min(NEAR, max(0, n - 1))
        links = [set() for _ in range(n)]
        for i in range(n):
            s = centroids @ centroids[i]
            s[i] = -2
            for j in np.argpartition(-s, near - 1)[:near].tolist() if near else []:
                links[i].add(j)
                links[j].add(i)
            links[i].add((i + 1) % n)  # a ring joins all parts of the graph
        width = max(map(len, links))
        self.links = np.array([sorted(x) + [i] * (width - len(x)) for i, x in enumerate(links)])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))

    def within(self, x: np.ndarray, ratio: float) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Rows of x and centroids at most `ratio` times as far as the row's nearest, as found on the graph; and all distances looked at."""
        rows = np.arange(len(x))
        far = np.full((len(x), len(self.c)), np.inf)
        done = np.zeros(far.shape, bool)

        def look(r: np.ndarray, at: np.ndarray) -> None:
            far[r[:, None], at] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ijk,ik->ij", self.c[at], x[r])))

        look(rows, np.broadcast_to(self.entries, (len(x), len(self.entries))))
        live, best = rows, far.min(axis=1, initial=np.inf)
        while len(live):
            next_ = np.where(done[live], np.inf, far[live]).argmin(axis=1)
            ok = (far[live, next_] <= np.maximum(best[live] * max(ratio, EXPLORED), best[live] + 1e-9)) & ~done[live, next_]
            live, next_ = live[ok], next_[ok]
            if len(live):
                done[live, next_] = True
                look(live, self.links[next_])
                best[live] = far[live].min(axis=1)
        return np.nonzero(far <= best[:, None] * ratio + 1e-9), far

    def ranked(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, ...]:
        """Rows of x, their centroids within the ratio, the place of each in order of distance, and how many the row has."""
        (row, at), far = self.within(x, ratio)
        order = np.lexsort((at, far[row, at], row))
        row, at = row[order], at[order]
        count = np.bincount(row, minlength=len(x))
        return row, at, np.arange(len(row)) - (np.cumsum(count) - count)[row], count[row]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * x @ self.c.T))


def vectors(col: pa.Array) -> np.ndarray:
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _assign(graph: CentroidGraph, ratio: float) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                row, at, place, count = graph.ranked(unit(vectors(b.column("v"))), ratio)
                take = pa.array(row)
                yield pa.record_batch([b.column("id").take(take), b.column("v").take(take), *(pa.array(x, pa.int32()) for x in (at, place, count))], names=["id", "v", "list", "near", "visited"])

    return assign


def fitted_ratio(graph: CentroidGraph, x: np.ndarray, k: int, boundary: float, recall: float) -> float:
    """The least ratio at which lists hold `recall` of the k nearest neighbours that PROBES rows of x have in x.

    Copies count once: those of a very common vector are found at any ratio.
    """
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(0).permutation(len(x))]
    if len(x) < 3:
        return 4.0
    probes = np.unique(np.linspace(0, len(x) - 1, min(len(x), PROBES)).astype(int))
    need = []
    for q in probes:
        s = x @ x[q]
        s[q] = -np.inf
        near = np.argpartition(-s, min(k, len(x) - 1) - 1)[:k]
        near = near[near != q]
        far = graph.distances(x[[q]])[0]
        own = graph.distances(x[near])
        stored = own <= own.min(axis=1, keepdims=True) * boundary + 1e-9
        need.append(np.where(stored, far, np.inf).min(axis=1) / max(far.min(), 1e-9))
    need = np.sort(np.concatenate(need))
    return float(max(1.0, need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1e-9)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _search(k: int) -> Callable:
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, v = left.column("id").to_numpy(), vectors(left.column("v").combine_chunks())
            norm = np.sqrt((v * v).sum(axis=1))
            for query, q, least in zip(right.column("id").to_numpy(), vectors(right.column("v").combine_chunks()), right.column("least").to_numpy(), strict=True):
                own = ids != query
                rough = np.where(own, (v @ q) / norm, -np.inf)
                size = np.sqrt((q * q).sum())
                edge = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
                # Repeated ids may fill the first places, so they widen the choice; scores are summed row by row, alike for like rows.
                at = np.flatnonzero(own & (rough >= edge - 1e-9 * size))
                if len(np.unique(ids[at])) < k:
                    at = np.flatnonzero(own)
                score = (v[at] * q).sum(axis=1) / (size * norm[at])
                at, score = at[score >= least], score[score >= least]
                best = top(ids[at], score, k)
                found.append((np.full(len(best), query), ids[at][best], score[best]))
        parts = [np.concatenate([x[i] for x in found]) if found else [] for i in range(3)]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.float64())})

    return search


def usable(table: DataFrame) -> DataFrame:
    """id and v: the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("id"), e.alias("v")).where(F.col("id").isNotNull() & good)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0].n if lengths else 0))


def nearest(table: DataFrame, *, every: int = EVERY, k: int = K, boundary: float = BOUNDARY, ratio: float | None = None, recall: float = RECALL, max_lists: int = MAX_LISTS, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of table (vec_id, embedding) whose id divides by `every`.

    ratio: None fits it to the table, for `recall`.
    """
    spark = R.attach(table.sparkSession)
    rows = usable(table)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows if total <= fit_rows else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * 0.9 * fit_rows / total)).limit(fit_rows)
    fit = sample.orderBy("id", "v").select("v").toArrow().column("v").combine_chunks()
    if not len(fit):
        fit = rows.limit(fit_rows).select("v").toArrow().column("v").combine_chunks()
    fit = unit(vectors(fit))
    graph = CentroidGraph(balanced_centroids(fit, max(1, min(max_lists, round(total**0.5)))))
    ratio = fitted_ratio(graph, fit, k, boundary, recall) if ratio is None else ratio

    stored = R.checkpointed(rows.mapInArrow(_assign(graph, boundary), ASKED).drop("near", "visited"))
    parts = F.broadcast(stored.groupBy("list").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("parts")))  # max_lists rows at most
    index = stored.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = R.checkpointed(rows.where(F.col("id") % every == 0).mapInArrow(_assign(graph, ratio), ASKED))
    asked = asked.join(parts, "list").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    early = F.col("near") < F.ceil(F.sqrt("visited"))

    def search(of: DataFrame) -> DataFrame:
        found = index.groupBy("list", "part").cogroup(of.groupBy("list", "part")).applyInArrow(_search(k), FOUND)
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def best(of: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return of.withColumn("rank", rank).where(F.col("rank") <= k)

    shape = ["id", "v", "list", "part", "least"]
    first = R.checkpointed(best(search(asked.where(early).withColumn("least", F.lit(float("-inf"))).select(shape))))
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    rest = asked.where(~early).join(bound, "id", "left").fillna(float("-inf"), ["least"])
    found = first.drop("rank").unionByName(search(rest.select(shape))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(found).select("query_id", "rank", "vec_id", "score")
