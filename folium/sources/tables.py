"""Sources: tables, JSONL chunk files with validation, case files, pages from files or HTML."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..functions import text as T
from ..functions.rules import labelled
from ..storage import attach, checkpointed

CHUNK_FIELDS = P.StructType(
    [P.StructField(n, P.StringType()) for n in ("chunk_id", "document_id", "text", "source")]
    + [P.StructField(n, P.IntegerType()) for n in ("page", "page_start", "page_end", "char_count")]
    + [P.StructField("content_hash", P.StringType()), P.StructField("forced_split", P.BooleanType())]
    + [P.StructField(n, P.StringType()) for n in ("document_type", "content_type", "topic", "source_quality", "section", "embedding_text")]
)
CASE_FIELDS = "name string, question string, expected_any_terms array<string>, forbidden_source_terms array<string>, forbidden_content_types array<string>"
#: Splits of files whose line numbers are broadcast.
BROADCAST_SPLITS = 100_000
#: The columns that an index keeps beside text and vector.
METADATA = ["chunk_id", "document_id", "source", "doc_pos", "global_pos", "page_start", "page_end", "char_count", "content_hash", "forced_split", "document_type", "content_type", "topic", "source_quality", "section"]


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores where its files have fewer splits than these; filters and columns still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str, *, heavy: bool = False) -> DataFrame:
    """A table; heavy: much work a row is ahead, so a file of few row groups is spread over the cores."""
    df = attach(spark).read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system that Spark reads; nothing is created."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file that holds a list."""
    return spark.read.schema(CASE_FIELDS).json(path, multiLine=True)


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSONL chunk files, with file, line_no (from 1) and _corrupt; blank lines count but give no row.

    Lines are numbered in two passes: the lines of each split of a file are counted, then each line counts from where the
    splits before its own end. Lines of a split have consecutive ids, so no window is needed and no text moves.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    counts = raw.groupBy("file", "_block").agg(F.count("*").alias("_lines"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(counts.select("file", "_block", (before - F.col("_first") + 1).alias("_add")))
    raw = raw.join(F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts, ["file", "_block"])
    raw = raw.withColumn("line_no", F.col("_at") + F.col("_add")).where(T.strip(F.col("value")) != "")
    schema = P.StructType([*CHUNK_FIELDS, P.StructField("_corrupt", P.StringType())])
    parsed = raw.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("file", "line_no", "r.*")


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are whole, and the others with `error`: broken JSON, no text or source, or a chunk_id seen before."""
    blank = lambda c: F.coalesce(T.strip(F.col(c)) == "", F.lit(True))
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("file", "line_no")) > 1
    error = F.when(corrupt, "broken JSON").when(blank("text") | blank("source"), "no text or source").when(F.col("chunk_id").isNotNull() & again, "repeated chunk_id")
    marked = rows.withColumn("error", error)
    return marked.where("error is null").drop("error", "_corrupt"), marked.where("error is not null")


def backfilled(rows: DataFrame) -> DataFrame:
    """Old chunk rows with ids, pages, lengths, hashes and labels where they lack them, and their positions."""
    first = F.coalesce("page_start", "page", F.lit(1))
    out = rows.withColumns(
        {
            "chunk_id": F.coalesce(F.nullif("chunk_id", F.lit("")), F.format_string("legacy_%08d", F.col("line_no").cast("int"))),
            "document_id": F.coalesce(F.nullif("document_id", F.lit("")), F.lower(T.stem(F.col("source")))),
            "page_start": first,
            "page_end": F.coalesce("page_end", first),
            "char_count": F.coalesce("char_count", F.length("text")),
            "content_hash": F.coalesce("content_hash", T.content_hash(F.col("text"))),
            "forced_split": F.coalesce("forced_split", F.lit(False)),
        }
    )
    names = ("document_type", "content_type", "topic", "source_quality", "section")
    have = out.withColumnsRenamed({n: f"_{n}" for n in names})
    out = labelled(have, section="_section").withColumns({n: F.coalesce(F.nullif(f"_{n}", F.lit("")), n) for n in names}).drop(*(f"_{n}" for n in names))
    w = Window.partitionBy("document_id").orderBy("file", "line_no")
    return out.withColumns({"doc_pos": F.row_number().over(w) - 1, "embedding_text": F.coalesce("embedding_text", T.embedding_text(*(F.col(c) for c in ("document_type", "content_type", "topic", "section", "text"))))})


TAG = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
BREAK = re.compile(r"<(?:/?(?:p|div|h\d|li|tr|article|section)\b|br\b)[^>]*>", re.I)


def text_lines(page: str | None) -> str:
    """The text of HTML, a line for each block."""
    text = html.unescape(TAG.sub("", BREAK.sub("\n", page or "")))
    return "\n".join(filter(None, (" ".join(x.split()) for x in text.split("\n"))))


def html_lines(c: Column) -> Column:
    """text_lines() of a column: a page source where there are no PDF files."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([text_lines(x) for x in s], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(c)


def html_pages(pages: DataFrame) -> DataFrame:
    """document (the host), page and text of a table of web pages."""
    return pages.select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("document"), F.col("page_id").cast("int").alias("page"), html_lines(F.col("html")).alias("text"))


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path and content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def extracted(binary: DataFrame, extractor) -> tuple[DataFrame, DataFrame]:
    """Pages (document, page, text) of files, and (document, error) of those that can't be read.

    extractor: bytes -> list of page texts, for the file format at hand; it runs on the executors.
    """
    schema = "document string, page int, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    rows += [(path, i, text, None) for i, text in enumerate(extractor(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["document", "page", "text", "error"]).astype({"page": "Int32"})

    out = binary.mapInPandas(run, schema)
    return out.where("error is null").drop("error"), out.where("error is not null").select("document", "error")
