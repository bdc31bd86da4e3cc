"""From pages to a published index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import chunking, clustered, pages
from ..operators.embedding import Embedder, embedded
from .index import publish


def prepared(raw: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Cleaned pages with no_space_before: skipped and empty pages gone, repeated lines and boilerplate removed.

    raw: document, page, text.
    """
    own = raw.where((F.col("page") > pages.skipped_pages(F.col("document"))) & (F.trim("text") != ""))
    clean = pages.without_repeated_lines(own, pages.repeated_lines(raw, config), config)
    # a filter on the cleaned text would be pushed below and clean it twice
    clean = clean.select("document", "page", F.explode(F.filter(F.array(pages.cleaned(F.col("text"))), lambda x: x != "")).alias("text"))
    return pages.joined_hyphens(clean)


def textless(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Pages that have no text before or after cleaning."""
    return raw.where(F.col("page") > pages.skipped_pages(F.col("document"))).select("document", "page").join(clean.select("document", "page"), ["document", "page"], "left_anti")


def chunked(raw: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunk records of raw pages, with doc_pos."""
    return pages.positions(chunking.chunks(prepared(raw, config), config), order="chunk_no")


def build(raw: DataFrame, path: str, embedder: Embedder, config: EngineConfig = EngineConfig()) -> dict:
    """Publishes the index of raw pages, clustered by its vectors; what it says about itself."""
    return publish(embedded(chunked(raw, config), embedder, text="embedding_text"), path, write=clustered.write, embedding_model=embedder.name)


def write_jsonl(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines, UTF-8."""
    chunks.write.mode("overwrite").json(path)
