"""From questions to passages, contexts and checked answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import answers as A
from ..functions import text as T
from ..functions.rules import query_variants, scored
from ..operators import knn, pages, selection
from ..operators.embedding import Embedder, embedded
from ..storage import checkpointed


#: From queries (query_id, embedding) and a number to query_id, vec_id, similarity, rank.
Search = Callable[[DataFrame, int], DataFrame]


class Generator(Protocol):
    """Answers a prompt; called on the executors, a partition at a time."""

    name: str

    def answer(self, system: str, prompt: str) -> str: ...


def candidates(questions: DataFrame, index: DataFrame, embedder: Embedder, config: EngineConfig = EngineConfig(), *, expand: bool = True, search: Search | None = None) -> DataFrame:
    """Scored candidates of each question, best first by `place`.

    questions: question_id, question. index: chunk_id, source, text, embedding, labels and positions. search: finds the
    nearest chunk_ids of query vectors, such as operators.clustered.searcher(); without it all of the index is compared.
    """
    variants = query_variants(F.col("question"), config.max_query_variants if expand else 1)
    asked = questions.select("question_id", "question", F.posexplode(variants).alias("variant", "phrase"))
    asked = embedded(asked, embedder, text="phrase", question=True)
    coded = asked.withColumn("query_id", F.col("question_id") * 16 + F.col("variant"))
    coded = coded.select("query_id", "embedding")
    hits = search(coded, config.candidates) if search else knn.top_k(coded, index.select(F.col("chunk_id").alias("vec_id"), "embedding"), config.candidates)
    hits = hits.select(F.floor(F.col("query_id") / 16).alias("question_id"), F.pmod("query_id", F.lit(16)).cast("int").alias("variant"), "vec_id", "similarity", "rank")
    best = knn.floor_and_merge(hits, config.similarity_floor if expand else -1.0)
    rows = best.withColumnRenamed("vec_id", "chunk_id").join(questions, "question_id").join(index.drop("embedding"), "chunk_id")
    out = scored(rows, labels=True)
    place = Window.partitionBy("question_id").orderBy(F.desc("adjusted_score"), F.desc("similarity"), "variant", "rank", "chunk_id")
    return out.withColumn("place", F.row_number().over(place))


def with_windows(found: DataFrame, index: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Candidates with the ids, text, pages and score of their neighbour windows."""
    if config.window == 0:
        own = F.col("text")
        return found.withColumns({"window_ids": F.array("chunk_id"), "window_text": own, "window_score": F.col("adjusted_score"), "window_rejected": F.col("rejected")})
    near = pages.neighbours(found.select("chunk_id", "document_id", "doc_pos", "section", "content_type").distinct(), index, config.window, same_section=config.window_same_section_only)
    parts = near.groupBy("centre_id").agg(F.sort_array(F.collect_list(F.struct("doc_pos", "chunk_id", "text"))).alias("w"))
    merged = F.aggregate(F.slice(F.col("w"), F.lit(2), F.size("w")), F.array_join(F.filter(F.split(F.col("w")[0].text, T.SPACE), lambda x: x != ""), " "), lambda a, x: T.merge_overlap(a, x.text, config.min_overlap_words, config.max_overlap_words))
    wide = parts.select(F.col("centre_id").alias("chunk_id"), F.transform("w", lambda x: x.chunk_id).alias("window_ids"), merged.alias("window_text"))
    rows = found.join(wide, "chunk_id", "left")
    again = scored(rows.select("question_id", "chunk_id", "question", "source", F.col("window_text").alias("text"), "similarity", "document_type", "content_type", "topic", "source_quality", "section"), labels=True)
    again = again.select("question_id", "chunk_id", F.col("adjusted_score").alias("window_score"), F.col("rejected").alias("window_rejected"))
    return rows.join(again, ["question_id", "chunk_id"])


def explain(questions: DataFrame, index: DataFrame, embedder: Embedder, config: EngineConfig = EngineConfig(), *, search: Search | None = None) -> tuple[DataFrame, DataFrame]:
    """All candidates with windows, and what the selection made of those it visited."""
    found = with_windows(candidates(questions, index, embedder, config, search=search), index, config)
    return found, selection.select(found, config)


def retrieve(questions: DataFrame, index: DataFrame, embedder: Embedder, config: EngineConfig = EngineConfig(), *, search: Search | None = None) -> DataFrame:
    """The selected passages of each question, in order."""
    found, debug = explain(questions, index, embedder, config, search=search)
    chosen = debug.where("selected").select("question_id", "chunk_id")
    return found.join(chosen, ["question_id", "chunk_id"]).withColumns({"similarity": F.round("similarity", 3), "score": F.round("window_score", 3)})


def retrieve_plain(questions: DataFrame, index: DataFrame, embedder: Embedder, config: EngineConfig = EngineConfig(), *, search: Search | None = None) -> DataFrame:
    """The command line's retrieval: one variant, no floor and no caps.

    Neighbours are visited by similarity; those go whose window is rejected or shares a chunk with one kept before.
    The rest are sorted by their window's score, and the best top_k stay, with their `place`.
    """
    found = with_windows(candidates(questions, index, embedder, config, expand=False, search=search), index, config)
    kept = selection.unused_windows(found).select("question_id", "chunk_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("window_score"), F.desc("similarity"), "rank", "chunk_id")
    return found.drop("place").join(kept, ["question_id", "chunk_id"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.top_k)


def prompts(passages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """question_id, context and places of retrieved passages (page_start, page_end and labels as in an index)."""
    span = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("place"))
    numbered = passages.withColumn("n", place)
    block = selection.block(F.col("n"), F.col("source"), span, F.col("document_type"), F.col("content_type"), F.col("topic"), F.col("source_quality"), F.col("window_text"))
    return selection.contexts(numbered.select("question_id", F.col("n").alias("place"), block.alias("block")), config)


def _ask(generator: Generator, system: str, names: list[str]) -> Callable:
    """Calls the model for rows with a prompt: their `names`, its answer and whether it failed."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, failed = [], []
            for prompt in b.column("prompt").to_pylist():
                try:
                    answers.append(generator.answer(system, prompt))
                    failed.append(False)
                except Exception:  # noqa: BLE001  one failing call must not end the others
                    answers.append(None)
                    failed.append(True)
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(answers, pa.string()), pa.array(failed)], names=[*names, "answer", "failed"])

    return ask


def asked(rows: DataFrame, prompt: Column, generator: Generator, system: str) -> DataFrame:
    """rows with `answer` and `failed` of one call each. They are kept, so that no later step calls again."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return checkpointed(rows.withColumn("prompt", prompt).mapInArrow(_ask(generator, system, rows.columns), f"{shape}, answer string, failed boolean"))


def answered(questions: DataFrame, contexts: DataFrame | None, generator: Generator, system: str = "", repair: str | None = None) -> DataFrame:
    """Answers with status and problems. Only an answer with problems is asked for once more, with the provisional one
    and its problems in the prompt; if problems stay, it is blocked.

    contexts: question_id, context, places; None where the index can't be read: all questions have status erro_indice.
    """
    if contexts is None:
        contexts = questions.sparkSession.createDataFrame([], "question_id long, context string, places array<int>")
        return _status(questions.join(contexts, "question_id", "left").withColumns({"n_sources": F.lit(0), "answer": F.lit(None).cast("string"), "failed": F.lit(False)}), index=False)
    rows = questions.join(contexts, "question_id", "left").withColumn("n_sources", F.coalesce(F.size("places"), F.lit(0)))
    ready = (F.col("n_sources") > 0) & (T.strip(F.coalesce("question", F.lit(""))) != "")
    prompt = F.concat(F.lit("<caso>\n"), "question", F.lit("\n</caso>\n\n<trechos_da_base>\n"), "context", F.lit("\n</trechos_da_base>"))
    first = asked(rows.where(ready), prompt, generator, system).withColumn("problems", _problems())
    again = F.concat(prompt, F.lit("\n\n<resposta_provisoria>\n"), "provisional", F.lit("\n</resposta_provisoria>\n\nProblemas: "), F.array_join("problems", ", "))
    bad = first.where(~F.col("failed") & (F.size("problems") > 0)).withColumnRenamed("answer", "provisional").drop("failed")
    second = asked(bad, again, generator, system if repair is None else repair).drop("provisional", "problems")
    none = rows.where(~F.coalesce(ready, F.lit(False))).withColumns({"answer": F.lit(None).cast("string"), "failed": F.lit(False)})
    return _status(first.where(F.col("failed") | (F.size("problems") == 0)).drop("problems").unionByName(second).unionByName(none))


def _problems() -> Column:
    return A.problems(F.coalesce("answer", F.lit("")), F.col("n_sources"), F.col("question"))


def _status(rows: DataFrame, *, index: bool = True) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = rows.withColumn("problems", F.when(F.col("answer").isNotNull(), _problems()).otherwise(none))
    return rows.withColumn("status", A.status(F.col("question"), F.lit(index), F.col("n_sources"), F.col("answer"), F.col("failed"), F.col("problems"))).drop("failed")


def evaluated(cases: DataFrame, selected: DataFrame) -> DataFrame:
    """Each case with passed and why not: a term must be found, no forbidden source or content, at least one passage.

    cases: name, expected_any_terms, forbidden_source_terms, forbidden_content_types. selected: name, source, text, content_type.
    """
    per = selected.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.collect_list(T.normalize(F.concat_ws(" ", "source", "text"))), " ").alias("all"), F.array_join(F.collect_list(T.normalize(F.col("source"))), " ").alias("sources"), F.array_sort(F.collect_set("content_type")).alias("types"))
    rows = cases.join(per, "name", "left").withColumns({"n": F.coalesce("n", F.lit(0))})
    some = lambda terms, text: F.exists(F.col(terms), lambda t: F.coalesce(F.col(text), F.lit("")).contains(T.normalize(t)))
    bad = F.array_sort(F.array_intersect(F.coalesce("types", F.array().cast("array<string>")), "forbidden_content_types"))
    out = rows.withColumns({"has_expected": some("expected_any_terms", "all"), "has_forbidden_source": some("forbidden_source_terms", "sources"), "forbidden_types_found": F.array_join(bad, ", ")})
    return out.withColumn("passed", (F.col("n") > 0) & F.col("has_expected") & ~F.col("has_forbidden_source") & (F.col("forbidden_types_found") == "")).select("name", "n", "has_expected", "has_forbidden_source", "forbidden_types_found", "passed")


def totals(results: DataFrame) -> DataFrame:
    """One row on evaluated(): cases, passed and failed."""
    return results.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
