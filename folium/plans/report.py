"""Reports of retrievals and timings, as JSON and as CSV that spreadsheets read."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from .index import Folder

#: The columns of a timing report, in this order (fixed values).
TIMING = "timestamp question_number question status elapsed_seconds answer_characters source_count best_similarity model embedding_model top_k max_context_chars num_ctx num_predict".split()
BOM = "\ufeff"


def write_rows(df: DataFrame, path: str, format: str = "json") -> None:
    """A report of any size: one object or line a row, many files; CSV with a header."""
    (df.write.mode("overwrite").json(path) if format == "json" else df.write.mode("overwrite").csv(path, header=True))


def write_report(spark: SparkSession, folder: str, name: str, rows: list[dict]) -> None:
    """name.json (a list) and name.csv (UTF-8 with a byte order mark) of a report's few rows, in any file system."""
    to, text = Folder(spark, folder), io.StringIO(newline="")
    out = csv.DictWriter(text, list(rows[0]) if rows else [])
    out.writeheader()
    out.writerows(rows)
    for file, content in ((f"{name}.json", json.dumps(rows, ensure_ascii=False, indent=2, default=str)), (f"{name}.csv", BOM + text.getvalue())):
        to.delete(file)
        if not to.create(file, content):
            raise OSError(f"{file} was not written")


def timings(questions: list[str], respond: Callable[[str], DataFrame], model: str, embedding_model: str, config: EngineConfig = EngineConfig(), options: dict | None = None) -> list[dict]:
    """One row of TIMING a question, asked one after the other. respond: a frame of one row as answered() makes it."""
    rows = []
    for number, question in enumerate(questions, 1):
        began = time.perf_counter()
        df = respond(question)
        best = F.col("best_similarity") if "best_similarity" in df.columns else F.lit(None)
        r = df.select("status", F.length(F.coalesce("answer", F.lit(""))).alias("n"), "n_sources", best.alias("best")).first()
        took = round(time.perf_counter() - began, 2)
        values = [datetime.now().isoformat(timespec="seconds"), number, question, r.status if r else None, took, r.n if r else 0, r.n_sources if r else 0, r.best if r else None, model, embedding_model, config.top_k, config.max_context_chars, (options or {}).get("num_ctx"), (options or {}).get("num_predict")]
        rows.append(dict(zip(TIMING, values, strict=True)))
    return rows
