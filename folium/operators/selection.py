"""Greedy, diversified selection of candidates and the context made of what was selected."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.text import normalize_py

DEBUG = "question_id long, chunk_id string, source string, place int, selected boolean, discard_reason string, adjusted_score double, duplicate_of string"


def grams(text: str, size: int) -> frozenset:
    w = normalize_py(text).split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def alike(a: frozenset, b: frozenset) -> float:
    if not a or not b:
        return 0.0
    common = len(a & b)
    return max(common / len(a | b), common / min(len(a), len(b)))


def _walk(config: EngineConfig) -> Callable:
    def walk(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        chosen: list[tuple[str, frozenset]] = []
        used: set[str] = set()
        per_source: dict[str, int] = {}
        out = []
        for r in rows:
            why = twin = None
            window, g = r["window_ids"] or [], None
            if r["rejected"]:
                why = "policy"
            elif r["adjusted_score"] < config.min_rerank_score:
                why = "score"
            elif per_source.get(r["source"], 0) >= config.max_results_per_source:
                why = "source_cap"
            elif not window:
                why = "empty_window"
            elif used & set(window):
                why = "used_window"
            else:
                g = grams(r["window_text"], config.shingle)
                twin = next((i for i, other in chosen if alike(g, other) >= config.max_content_similarity), None)
                if twin is not None:
                    why = "near_duplicate"
                elif r["window_rejected"] or r["window_score"] < config.min_rerank_score:
                    why = "window_score"
            if why is None:
                chosen.append((r["chunk_id"], g))
                used |= set(window)
                per_source[r["source"]] = per_source.get(r["source"], 0) + 1
            out.append({"question_id": r["question_id"], "chunk_id": r["chunk_id"], "source": r["source"], "place": r["place"], "selected": why is None, "discard_reason": why, "adjusted_score": r["adjusted_score"], "duplicate_of": twin})
            if len(chosen) >= config.top_k:
                break
        types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.Table.from_pylist(out, pa.schema([(n, types[t]) for n, t in (x.split() for x in DEBUG.split(", "))]))

    return walk


def select(candidates: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row for each candidate visited, in order of place, until top_k of a question are selected.

    candidates: question_id, chunk_id, source, place, adjusted_score, rejected, window_ids, window_text,
    window_score, window_rejected. A question has at most variants x candidates rows, so a group is small.
    """
    names = ["question_id", "chunk_id", "source", "place", "adjusted_score", "rejected", "window_ids", "window_text", "window_score", "window_rejected"]
    return candidates.select(*names).groupBy("question_id").applyInArrow(_walk(config), DEBUG)


def unused_windows(found: DataFrame) -> DataFrame:
    """question_id and chunk_id of the candidates, visited by rank, whose window is neither rejected nor empty and shares
    no chunk with the windows kept before.

    found: question_id, chunk_id, rank, window_ids, window_rejected. A question has few candidates.
    """
    visited = F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "window_ids", "window_rejected")))
    none = F.array().cast("array<string>")

    def step(state: Column, x: Column) -> Column:
        bad = F.coalesce(x.window_rejected | (F.size(x.window_ids) < 1) | F.arrays_overlap(state.used, x.window_ids) | F.array_contains(state.used, x.chunk_id), F.lit(True))
        return F.when(bad, state).otherwise(F.struct(F.concat(state.used, x.window_ids).alias("used"), F.concat(state.kept, F.array(x.chunk_id)).alias("kept")))

    kept = F.aggregate("visited", F.struct(none.alias("used"), none.alias("kept")), step, lambda s: s.kept)
    return found.groupBy("question_id").agg(visited.alias("visited")).select("question_id", F.explode(kept).alias("chunk_id"))


def block(number: Column, source: Column, pages: Column, kind: Column, content: Column, topic: Column, quality: Column, text: Column) -> Column:
    """A passage as it stands in the context."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    return F.concat(
        F.lit("<trecho"), attribute("id", number.cast("string")), attribute("fonte", T.escape(source)), attribute("paginas", T.escape(pages)),
        attribute("tipo_documento", F.coalesce(kind, F.lit("desconhecido"))), attribute("tipo_conteudo", F.coalesce(content, F.lit("general"))),
        attribute("tema", F.coalesce(topic, F.lit("general_trichology"))), attribute("qualidade_fonte", F.coalesce(quality, F.lit("medium"))),
        F.lit(">\n"), text, F.lit("\n</trecho>"),
    )


def within_budget(blocks: Column, budget: int) -> Column:
    """Of an array of blocks, those that fit: one that would overflow is skipped, the first is cut."""
    first = F.concat(F.substring(F.get(blocks, F.lit(0)), 1, max(0, budget - 120)), F.lit(V.TRUNCATED))
    start = F.struct(F.array().cast("array<struct<place:int,block:string>>").alias("kept"), F.lit(0).alias("total"))

    def step(state: Column, x: Column) -> Column:
        b = F.when((F.size(state.kept) == 0) & (F.length(x.block) > budget), first).otherwise(x.block)
        fits = (F.size(state.kept) == 0) | (state.total + F.length(b) <= budget)
        return F.when(fits, F.struct(F.concat(state.kept, F.array(F.struct(x.place.alias("place"), b.alias("block")))).alias("kept"), (state.total + F.length(b)).alias("total"))).otherwise(state)

    numbered = F.transform(blocks, lambda b, i: F.struct((i + 1).cast("int").alias("place"), b.alias("block")))
    return F.aggregate(numbered, start, step, lambda s: s.kept)


def contexts(passages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """question_id, context and the places used, of passages (question_id, place, block)."""
    lists = passages.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x.block).alias("blocks"))
    kept = within_budget(F.col("blocks"), config.max_context_chars)
    return lists.select("question_id", F.array_join(F.transform(kept, lambda x: x.block), "\n\n").alias("context"), F.transform(kept, lambda x: x.place).alias("places"))
