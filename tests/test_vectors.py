"""The stored vector index, and publishing under races."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.operators import clustered, knn
from folium.operators.embedding import HashingEmbedder, embedded
from folium.plans import index, retrieve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 24))
    v = middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.4
    v[100:140] = v[99]  # ties
    rows = [(i, [float(x) for x in r], f"c{i:05d}") for i, r in enumerate(v)] + [(5000, None, "none"), (5001, [0.0] * 24, "zero")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, chunk_id string").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    return path, index.publish(vectors, path, write=clustered.write, expected=vectors.count())


def queries_of(vectors, step=50):
    return vectors.where(f"vec_id % {step} = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.similarity, 9)) for r in df.collect())


def test_exact_search_is_brute_force(spark, vectors, stored):
    path, meta = stored
    asked = queries_of(vectors).unionByName(vectors.where("vec_id = 5001").select(F.col("vec_id").alias("query_id"), "embedding"))
    want = rows(knn.top_k(asked, vectors, 45))
    assert rows(clustered.searcher(spark, path, meta, key="vec_id", exact=True)(asked, 45)) == want
    at = f"{path}/{meta['version']}"
    assert rows(clustered.search(spark, at, asked, 45, probe=1, exact=True)) == want
    assert rows(clustered.search(spark, at, asked, 45, probe=1, exact=True, query_bytes=2000)) == want  # in parts
    few = rows(clustered.search(spark, at, asked, 5000, probe=10**6))
    assert few == rows(knn.top_k(asked, vectors, 5000)) and len(few) == 61 * 3001  # all, where fewer than k are there


def test_recall_and_the_files_that_are_read(spark, vectors, stored):
    path, meta = stored
    asked, at = queries_of(vectors, 10), f"{path}/{meta['version']}"
    want = {(q, v) for q, _, v, _ in rows(knn.top_k(asked, vectors, 10))}
    got = {(q, v) for q, _, v, _ in rows(clustered.search(spark, at, asked, 10, probe=meta["probe"]))}
    assert len(want & got) >= 0.9 * len(want)
    assert meta["probe"] < meta["lists"] / 4  # these vectors have clusters
    one = queries_of(vectors, 10).where("query_id = 0")
    about = clustered.lists(spark, at)
    visited = [int(i) for i, r in zip(about.number, about.near(np.array([one.first().embedding]), meta["probe"]), strict=True) if len(r)]
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    read, every = files(clustered.rows_of(spark, at, visited)), files(spark.read.parquet(at))
    assert len(visited) == meta["probe"] and len(read) < len(every) / 4
    plan = clustered.rows_of(spark, at, visited)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan


def test_index_without_rows_vectors_or_queries(spark, vectors, stored, tmp_path):
    path, meta = stored
    none = queries_of(vectors).where("false")
    assert clustered.searcher(spark, path, meta, key="vec_id")(none, 3).collect() == []
    assert clustered.searcher(spark, path, meta, key="vec_id", exact=True)(vectors.where("vec_id = 5000").select(F.col("vec_id").alias("query_id"), "embedding"), 3).collect() == []
    for n, df in enumerate((vectors.where("vec_id = 5000"), vectors.limit(0))):
        at = str(tmp_path / f"v{n}")
        about = index.publish(df, at, write=clustered.write)
        assert about["lists"] == 0 and index.load(spark, at).count() == df.count()
        assert clustered.searcher(spark, at, about, key="vec_id", exact=True)(queries_of(vectors), 3).collect() == []
    at = str(tmp_path / "one")
    about = index.publish(vectors.where("vec_id = 7"), at, write=clustered.write)
    assert [r.vec_id for r in clustered.searcher(spark, at, about, key="chunk_id")(queries_of(vectors), 3).collect()] == ["c00007"] * 60


def test_a_list_with_a_third_of_the_rows(spark, vectors, tmp_path):
    same = vectors.where("vec_id = 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2000)))).select((-F.col("k")).cast("long").alias("vec_id"), "embedding", "chunk_id")
    df = vectors.unionByName(same)
    at = str(tmp_path / "hot")
    meta = index.publish(df, at, write=clustered.write)
    asked = queries_of(vectors, 500)
    assert rows(clustered.searcher(spark, at, meta, key="vec_id", exact=True)(asked, 8)) == rows(knn.top_k(asked, df, 8))


def test_retrieval_through_the_stored_index(spark, tmp_path):
    """Ids are strings here; the same passages come out as by comparing all vectors."""
    texts = [f"folha {i} tratamento da queda " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) for i in range(120)]
    chunks = spark.createDataFrame([(f"d{i // 10}_{i:03d}", f"d{i // 10}", f"d{i // 10}.pdf", t, i % 10, "educational_material", "general", "t", "medium", "general", 1, 1) for i, t in enumerate(texts)], "chunk_id string, document_id string, source string, text string, doc_pos int, document_type string, content_type string, topic string, source_quality string, section string, page_start int, page_end int")
    model, path = HashingEmbedder(64), str(tmp_path / "i")
    meta = index.publish(embedded(chunks, model), path, write=clustered.write, embedding_model=model.name)
    built = index.load(spark, path, model=model.name).drop("list", "_cosine")
    asked = spark.createDataFrame([(1, "queda tratamento w7 w8 w9"), (2, "w1 w2 w3 w4")], "question_id long, question string")
    find = clustered.searcher(spark, path, meta, key="chunk_id", exact=True)
    for way in (retrieve.candidates, retrieve.retrieve, retrieve.retrieve_plain):
        got, want = ([tuple(r) for r in way(asked, built, model, **o).select("question_id", "chunk_id", F.round("similarity", 6)).orderBy("question_id", "chunk_id").collect()] for o in ({"search": find}, {}))
        assert got and got == want


def test_one_of_racing_writers_wins(spark, tmp_path):
    folder, won = index.Folder(spark, str(tmp_path)), []
    start = threading.Barrier(20)

    def write(i):
        start.wait()
        if folder.create("_current-000000001", str(i)):
            won.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and folder.read("_current-000000001") == str(won[0])
    assert folder.names() == ["_current-000000001"]
