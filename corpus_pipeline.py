"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. doc_id is the key: rows that repeat one are
reduced to one by the second stage. Rows without doc_id can't be told apart by later stages: the third
leaves their text alone and the fourth doesn't draw them. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import bpe, debruijn, fertility, mixing, prefixtree
from folium.llm.queries import table, tokenizer
from folium.llm.runtime import attach, shared_dir
from folium.plans.index import Folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of a shard that one task sorts, as a share of the shard.
SLICES = 16
#: Near duplicates: the least similarity of their sets of windows, and the words of a window. Query op7 has values of its own.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep. Each row has its own verdict, whatever other rows have its doc_id."""
    docs = docs.select(COLUMNS)
    kept = fertility.judged(docs, tuple(map(tokenizer, fertility.VOCABULARIES))).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("row_key").alias("kept_key")).distinct()
    rows = docs.withColumn("row_key", fertility.row_key())
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")), "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: 80 % of their windows of five words in common."""
    found = prefixtree.jaccard_components(docs, percent=NEAR_PERCENT, shingle=NEAR_SHINGLE)
    groups = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")).where("doc_id is null or component_id = doc_id")
    groups = groups.select(F.col("doc_id").alias("first_id"), (F.col("doc_id").isNotNull() & (F.col("rows") > 1)).alias("again"))
    kept = docs.select(COLUMNS).join(groups, F.col("doc_id").eqNullSafe(F.col("first_id"))).drop("first_id")
    return kept.where("not again").drop("again").unionByName(kept.where("again").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*"))


def changed_row(words: list, keep: object, spans: Callable) -> tuple:
    """The text that is left, where something was removed."""
    return (None if keep is None else debruijn.span_row(words, keep, list)[0],)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without word windows that smaller ids have; those that have nothing else go."""
    found = debruijn.remove_repeats(docs, row=changed_row, schema="doc_id long, n_words long, n_removed long, kept string").where("n_removed > 0 and doc_id is not null")
    rows = docs.select(COLUMNS).join(found.select("doc_id", "kept"), "doc_id", "left").where("kept is null or kept <> ''")
    return rows.withColumns({"text": F.coalesce("kept", "text"), "n_chars": F.when(F.col("kept").isNotNull(), F.char_length("kept")).otherwise(F.col("n_chars")).cast("long")}).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards shuffled locally."""
    drawn = mixing.mixed(docs).select("doc_id", "shard", "place")
    rows = docs.select(COLUMNS).join(drawn, "doc_id").repartition("shard", F.pmod("place", F.lit(SLICES)))
    return rows.sortWithinPartitions("shard", "place").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return bpe.digest_documents(docs, tokenizer("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("encode", encode)]

#: SQL can't express the tokenisers; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    folder = f"{shared_dir(attach(spark))}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:  # what this stage has read isn't needed again
                Folder(spark, folder).delete(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
