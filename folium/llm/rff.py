"""Operator 9: a quality classifier of random Fourier features over document statistics.

1. A document becomes statistics of its bytes and words (FEATURES); ids, languages, sources and labels
   are no inputs. Means and deviations come from the training rows.
2. Random Fourier features, cos(w x + b) with normal w and uniform b, approximate a Gaussian kernel.
3. Partitions sum their part of the normal equations Z'Z and Z'y; sums are added up in groups, so the
   driver gets a few matrices however many partitions there are, and solves the ridge equations.
4. Isotonic calibration: training scores are counted in fixed bins, pooled to a rising curve on the
   driver, and interpolated.

All labelled training rows are used, no sample. Defined results: null and empty texts have statistics
like any other (zeros) and a score; a null label trains nothing; a row without doc_id is not held out.
Several labels of one document train as several rows. With no training rows all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from .mixing import word_counts

FEATURES = ("words", "word_length", "letters", "digits", "capitals", "marks", "symbols", "bars", "other", "repeated_words", "doubled_pairs", "line_words", "repeated_lines", "entropy", "long_words", "stops")
D, RIDGE, GAMMA, BINS, SEED = 192, 1e-3, 1 / 32, 1024, 11


def _table(kind: Callable[[str], bool]) -> np.ndarray:
    return np.array([i < 128 and kind(chr(i)) for i in range(256)])


#: The first five kinds of FEATURES that are shares of a text's bytes.
KINDS = [
    _table(str.isalpha) | np.array([i >= 128 for i in range(256)]),
    _table(str.isdigit),
    _table(str.isupper),
    _table(lambda c: c in ".,;:!?'\"()-"),
    _table(lambda c: c in "#*$%&<>@^~_=+\\/{}[]"),
    _table(lambda c: c == "|"),
    _table(lambda c: ord(c) < 32 and c not in "\n\t\r "),
]


def shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each document the share of its bytes that each kind has, and the entropy of its bytes."""
    n = np.maximum(np.diff(off), 1)
    own = np.repeat(np.arange(len(n)), np.diff(off))
    count = np.bincount(own * 256 + data, minlength=len(n) * 256).reshape(len(n), 256)
    p = count / n[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log2(p), 0).sum(axis=1)
    return np.column_stack([*(count[:, k].sum(axis=1) / n for k in KINDS), entropy, count[:, 0x2E] / n])


def repeats(text: bytes) -> tuple[float, ...]:
    """Shares of words seen before, of word pairs seen before, words a line, lines seen before, long words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 5
    h = R.WORD_HASHES.of(words)
    pairs = R.rolling(h, 2)
    lines = [x for x in text.split(b"\n") if x.strip()]
    long = sum(len(x) > 14 for x in words)
    return 1 - len(np.unique(h)) / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)), n / len(lines), 1 - len(set(lines)) / len(lines), long / n


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of each document."""
    words, size, share = word_counts(data, off), np.diff(off), shares(data, off)
    raw = data.tobytes()
    again = np.array([repeats(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]).reshape(-1, 5)
    return np.column_stack([np.log1p(words), np.log1p(size / np.maximum(words, 1)), share[:, :7], again[:, 0], again[:, 1], np.log1p(again[:, 2]), again[:, 3], share[:, 7], again[:, 4], share[:, 8]])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in R.slices(batches, "text"):
        x = statistics(*R.flat_utf8(b.column("text")))
        yield pa.record_batch([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x: the statistics of every row."""
    R.attach(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_describe, "doc_id long, x array<double>")


class Model:
    """Scales, random features, weights and the calibration curve; a few KB."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, d: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)
        self.w, self.b = rng.normal(0, np.sqrt(2 * gamma), (len(mean), d)), rng.uniform(0, 2 * np.pi, d)
        self.beta, self.at, self.value = np.zeros(d + 1), None, None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a trace of the raw one keeps the order within the curve's steps. An untrained model says 0.5."""
        if self.at is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.interp(raw, self.at, self.value) * 0.998 + (raw + 1) / 3 * 0.002


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def summed(rows: DataFrame) -> np.ndarray | None:
    """The sum of the rows' binary columns of doubles, in two levels of groups before the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    for groups in (256, 16):
        rows = rows.withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(add, "part int, sums binary")
    parts = [np.frombuffer(r.sums) for r in rows.orderBy("part").collect()]
    return sum(parts) if parts else None


def _equations(model: Model) -> Callable:
    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = 0
        for b in batches:
            if b.num_rows:
                z = np.column_stack([model.features(matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False)])
                total = total + z.T @ z
        if not isinstance(total, int):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    return equations


def rising(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: places and values of the pooled blocks."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _score(model: Model, name: str, raw: bool) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                out = model.raw(x) if raw else model.score(x)
                yield pa.record_batch([*(b.column(c) for c in b.schema.names if c != "x"), pa.array(out)], names=[*(c for c in b.schema.names if c != "x"), name])

    return score


def fitted(rows: DataFrame, *, d: int = D, gamma: float = GAMMA, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> Model:
    """A model of rows (x array<double>, y 0 or 1)."""
    rows = R.checkpointed(rows)
    width = len(FEATURES)
    moments = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(width))).agg(*(F.avg(f"x{i}") for i in range(width)), *(F.stddev_pop(f"x{i}") for i in range(width))).first()
    if moments[0] is None:
        return Model(np.zeros(width), np.ones(width), d, gamma, seed)
    model = Model(np.array(moments[:width]), np.array(moments[width:]), d, gamma, seed)
    s = summed(rows.mapInArrow(_equations(model), "part int, sums binary")).reshape(d + 2, d + 2)
    model.beta = np.linalg.solve(s[:-1, :-1] + ridge * s[-2, -2] * np.eye(d + 1) * (np.arange(d + 1) < d)[:, None] + 1e-9 * np.eye(d + 1), s[:-1, -1])
    scored = rows.mapInArrow(_score(model, "raw", True), "y double, raw double")
    counts = scored.groupBy(F.round((F.col("raw") + 1) / 3 * bins).cast("int").alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.at, model.value = rising(*(np.array([r[k] for r in counts], float) for k in ("x", "y", "n")))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: doc_id, quality.

    Labels teach only where crc32(doc_id as text) mod 3 is not 1.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    x = R.checkpointed(described(docs))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null")
    model = fitted(x.join(y, "doc_id").where(~held).select("x", "y"), **options)
    scored = x.mapInArrow(_score(model, "score", False), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
