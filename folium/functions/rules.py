"""Rule-based labels, question profiles, query variants and candidate scores as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import attach
from . import fixed_values as V
from . import text as T

FLAGS = ("asks_procedure", "asks_treatment", "asks_consent", "asks_diagnosis", "has_scalp_inflammation", "has_hair_pattern", "has_medication", "has_labs", "has_adverse_event")


def any_of(normalized: Column, terms: Iterable[str]) -> Column:
    """Whether normalised text holds one of the terms as a substring."""
    out = F.lit(False)
    for t in dict.fromkeys(map(T.normalize_py, terms)):
        out |= normalized.contains(t)
    return out


def first_of(pairs: Iterable[tuple[Column, str]], default: Column | str) -> Column:
    chain = None
    for condition, value in pairs:
        chain = F.when(condition, F.lit(value)) if chain is None else chain.when(condition, F.lit(value))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


CLASSES = {"procedure": V.PROCEDURE, "treatment": V.TREATMENT, "assessment": V.ASSESSMENT, "diagnosis": V.DIAGNOSIS, "adverse_event": V.ADVERSE_EVENT}
#: What the rules of labels look for in a text: in its first HEAD characters, how often in each class, and its topic.
HEAD, CASE = 2500, re.compile(r"\bcaso\s+\d+\b", re.A)
MARKS = {"administrative": pa.bool_(), "article": pa.bool_(), "case": pa.bool_(), **dict.fromkeys(CLASSES, pa.int32()), "topic": pa.string()}
MARK_TYPES = "struct<" + ",".join(f"{k}:{'boolean' if t == pa.bool_() else 'int' if t == pa.int32() else 'string'}" for k, t in MARKS.items())


def _marks(keep: bool) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """MARKS of texts, given with their sources' normalised stems; keep: and the normalised text."""
    terms = lambda words: list(dict.fromkeys(map(T.normalize_py, words)))
    administrative, article, topics = terms(V.ADMINISTRATIVE), terms(V.ARTICLE_MARKS), [(name, terms(words)) for name, words in V.TOPICS]
    classes = [list(map(T.normalize_py, words)) for words in CLASSES.values()]
    fields = list((MARKS | ({"body": pa.string()} if keep else {})).items())

    def marks(stems: pa.Array, texts: pa.Array) -> pa.Array:
        rows, given = [], texts.to_pylist()
        bodies = [None if x is None else T.normalized(x) for x in given]
        # of many terms few are in any text of a batch: the others are looked for once
        every_body = "\n".join(filter(None, bodies))
        present = lambda words: [t for t in words if t in every_body]
        in_classes, in_topics = list(map(present, classes)), [(name, present(words)) for name, words in topics]
        for stem, text, body in zip(stems.to_pylist(), given, bodies, strict=True):
            head = body if text is None or len(text) <= HEAD else T.normalized(text[:HEAD])
            every = " ".join(x for x in (stem, head) if x is not None)
            row = [any(t in every for t in administrative)]
            if body is None:
                row += [None] * (len(fields) - 1)
            else:
                row += [any(t in head for t in article), bool(CASE.search(head)) or "paciente do sexo" in head, *(sum(t in body for t in words) for words in in_classes)]
                row += [next((name for name, words in in_topics if any(t in body for t in words)), None), *([body] if keep else [])]
            rows.append(row)
        columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return marks


def document_type(stem: Column, marks: Column) -> Column:
    """Of a source's normalised stem and a text's marks."""
    rules = [(marks["administrative"], "consent_form")]
    rules += [(any_of(stem, hints), kind) for kind, hints in V.SOURCE_HINTS]
    rules += [(marks["article"], "scientific_article"), (marks["case"], "clinical_case")]
    return first_of(rules, "educational_material")


def section_rules(raw: Column) -> list[tuple[Column, str]]:
    return [(F.contains(raw, F.lit(":")) & raw.rlike(f"(?iuU){p}"), kind) for p, kind in V.SECTIONS]  # all of them end with a colon


def content_type(text: Column, score: dict[str, Column], section: Column | None = None) -> Column:
    """Of a raw text and the hits of CLASSES in its normalised form."""
    best = F.greatest(*score.values())
    rules = section_rules(text)
    if section is not None:
        s = T.normalize(F.coalesce(section, F.lit("")))
        rules += [(s == k.replace("_", " "), k) for k in ("treatment", "procedure", "diagnosis", "assessment", "adverse_event")]
    rules += [(best == 0, "general"), (score["adverse_event"] >= 2, "adverse_event"), ((score["procedure"] >= 2) & (score["procedure"] >= score["treatment"]), "procedure")]
    rules += [(v == best, k) for k, v in score.items()]
    return first_of(rules, "general")


def source_quality(kind: Column) -> Column:
    return first_of([(kind.isin(V.HIGH_QUALITY), "high"), (kind.isin(V.MEDIUM_QUALITY), "medium")], "low")


def section_title(c: Column) -> Column:
    """Of a text with its white space collapsed."""
    rules = [(F.contains(c, F.lit(":")) & F.regexp_instr(c, F.lit(f"(?iuU){p}")).between(1, 180), kind) for p, kind in V.SECTIONS]
    heading = F.regexp_extract(F.substring(c, 1, 160), r"^([^.!?]{3,80}):", 1)
    named = F.substring(F.replace(T.normalize(heading), F.lit(" "), F.lit("_")), 1, 60)
    return first_of(rules, F.when(heading != "", named).otherwise("general"))


def labelled(df: DataFrame, source: str = "source", text: str = "text", section: str | None = None, *, keep: bool = False) -> DataFrame:
    """df with document_type, content_type, topic, source_quality and section; keep: with the normalised text as _body too."""
    s, t = F.col(source), F.col(text)
    attach(df.sparkSession)
    df = df.withColumn("_stem", T.normalize(T.stem(s)))
    # texts are normalised and looked through a batch at a time in Python: hundreds of rules as expressions take many times as long
    found = F.arrow_udf(_marks(keep), MARK_TYPES + (",body:string>" if keep else ">"))
    df = df.withColumns({"_marks": found(F.col("_stem"), t), "_flat": F.when(F.contains(t, F.lit(":")), T.collapse(t)).otherwise(F.when(t.isNotNull(), ""))})  # titles end with a colon
    given, title = F.col(section) if section else None, section_title(F.col("_flat"))
    df = df.withColumns(
        {
            "document_type": document_type(F.col("_stem"), F.col("_marks")),
            "content_type": content_type(t, {k: F.col("_marks")[k] for k in CLASSES}, given),
            "topic": F.coalesce(F.col("_marks")["topic"], F.lit("general_trichology")),
            "section": title if given is None else F.coalesce(F.nullif(given, F.lit("")), title),
        }
    )
    if keep:
        df = df.withColumn("_body", F.col("_marks")["body"])
    return df.withColumn("source_quality", source_quality(F.col("document_type"))).drop("_stem", "_marks", "_flat")


def profile(n: Column) -> dict[str, Column]:
    """Nine flags of a normalised question."""
    procedure = any_of(n, V.PROCEDURE)
    return {
        "asks_procedure": procedure,
        "asks_treatment": any_of(n, V.TREATMENT_QUESTION),
        "asks_consent": any_of(n, V.CONSENT_QUESTION),
        "asks_diagnosis": any_of(n, V.DIAGNOSIS_QUESTION),
        "has_scalp_inflammation": any_of(n, V.SCALP),
        "has_hair_pattern": any_of(n, V.HAIR),
        "has_medication": any_of(n, V.MEDICATION),
        "has_labs": any_of(n, V.LABS),
        "has_adverse_event": any_of(n, V.ADVERSE_EVENT) | (procedure & any_of(n, V.PROCEDURE_SYMPTOMS)),
    }


def query_variants(question: Column, most: int = 4) -> Column:
    """The question and up to most - 1 expansions, distinct once normalised."""
    q = T.strip(question)

    def expanded(n: Column) -> Column:
        p = profile(n)
        parts = F.array_compact(F.array(*(F.when(p[flag], F.lit(V.FOCUS[k])) for k, flag in (("scalp", "has_scalp_inflammation"), ("hair", "has_hair_pattern"), ("medication", "has_medication"), ("labs", "has_labs")))))
        return F.array(
            q,
            F.when(F.size(parts) > 0, F.array_join(parts, "; ")),
            F.when(p["asks_procedure"] & p["has_adverse_event"], F.concat(q, F.lit(V.ADVERSE_VARIANT))),
            F.concat(q, F.lit(V.INVESTIGATION_VARIANT)),
            F.when(p["asks_treatment"] | p["asks_procedure"], F.concat(q, F.lit(V.CRITERIA_VARIANT))),
        )

    raw = T.let(T.normalize(question), expanded)
    keyed = F.transform(F.array_compact(raw), lambda v: F.struct(T.normalize(v).alias("key"), v.alias("variant")))
    empty = F.array().cast("array<struct<key:string,variant:string>>")
    fresh = F.aggregate(keyed, empty, lambda seen, x: F.when((x.key == "") | F.exists(seen, lambda y: y.key == x.key), seen).otherwise(F.concat(seen, F.array(x))))
    return F.slice(F.transform(fresh, lambda x: x.variant), 1, most)


#: What a text may cover, of what a question tells.
COVERED = {"scalp": V.SCALP, "hair": V.HAIR, "medication": V.MEDICATION, "labs": V.LABS, "adverse": V.ADVERSE_EVENT}
QUESTION = ["_asked", "_asked_words", *(f"_{k}" for k in FLAGS)]
TEXT = ["_body", "_source", "_words", "_penalised", *(f"_covers_{k}" for k in COVERED)]


def of_question(question: Column) -> dict[str, Column]:
    """What scored() needs of a question; constants, if the question is a literal."""
    n = T.normalize(question)
    return {"_asked": n, "_asked_words": T.tokens(n)} | {f"_{k}": v for k, v in profile(n).items()}


def with_texts(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """df with what scored() needs of each text: make it before texts meet questions, so that each is normalised once."""
    if "_body" not in df.columns:
        attach(df.sparkSession)
        df = df.withColumn("_body", T.normalize_long(F.col(text)))
    df = df.withColumn("_source", T.normalize(F.col(source)))
    every = F.trim(F.concat_ws(" ", "_source", "_body"))
    covers = {f"_covers_{k}": any_of(F.col("_body"), terms) for k, terms in COVERED.items()}
    return df.withColumns({"_words": T.tokens(every), "_penalised": any_of(F.col("_source"), V.PENALISED_SOURCES)} | covers)


def scored(df: DataFrame, *, question: str = "question", source: str = "source", text: str = "text", similarity: str = "similarity", labels: bool = False) -> DataFrame:
    """df with adjusted_score, lexical_coverage, rejected and reasons; labels: whether df has its five labels.

    Columns of of_question() and with_texts() are used where df has them.
    """
    if not labels:
        df = labelled(df, source, text)
    if "_words" not in df.columns:
        df = with_texts(df, source, text)
    if "_asked" not in df.columns:
        df = df.withColumn("_asked", T.normalize(F.col(question)))
        df = df.withColumns({"_asked_words": T.tokens(F.col("_asked"))} | {f"_{k}": v for k, v in profile(F.col("_asked")).items()})
    df = df.withColumn("_coverage", T.coverage(F.col("_asked_words"), F.col("_words")))
    flags = FLAGS
    asks = {k: F.col(f"_{k}") for k in flags}
    kind, content, quality, cov = F.col("document_type"), F.col("content_type"), F.col("source_quality"), F.col("_coverage")
    covers = {k: F.col(f"_covers_{k}") for k in COVERED}
    consent = (kind == "consent_form") & ~asks["asks_consent"]
    case_plan = (kind == "clinical_case") & content.isin("treatment", "procedure")
    case_rejected = case_plan & ~asks["asks_treatment"] & ~asks["asks_procedure"]
    adverse, covered = asks["asks_procedure"] & asks["has_adverse_event"], (content == "adverse_event") | covers["adverse"]
    none = F.lit(0.0)
    # (reason, when it holds, what it adds); in the order of the reasons and of the sum
    steps = [
        ("coverage", cov >= 0.45, none),
        ("consent", consent, none),
        ("high", quality == "high", F.lit(0.06)),
        ("low", quality == "low", F.lit(-0.10)),
        ("assessment", content == "assessment", F.when(asks["asks_treatment"], 0.03).otherwise(0.07)),
        ("diagnosis", content == "diagnosis", F.lit(0.05)),
        ("treatment", (content == "treatment") & ~asks["asks_treatment"], F.lit(-0.13)),
        ("procedure", (content == "procedure") & ~asks["asks_procedure"], F.lit(-0.22)),
        ("adverse_event", (content == "adverse_event") & ~asks["asks_procedure"], F.lit(-0.18)),
        ("case_general", (kind == "clinical_case") & (content == "general"), F.lit(-0.05)),
        ("protocol", (kind == "procedure_protocol") & ~asks["asks_procedure"], F.lit(-0.12)),
        ("case_plan", case_plan, F.lit(-0.18)),
        ("case_rejected", case_rejected, none),
        ("scalp", asks["has_scalp_inflammation"] & covers["scalp"], F.lit(0.08)),
        ("hair", asks["has_hair_pattern"] & covers["hair"], F.lit(0.06)),
        ("medication", asks["has_medication"] & covers["medication"], F.lit(0.05)),
        ("labs", asks["has_labs"] & covers["labs"], F.lit(0.04)),
        ("procedure_asked", asks["asks_procedure"] & content.isin("procedure", "adverse_event"), F.lit(0.10)),
        ("adverse_covered", adverse & covered, F.lit(0.16)),
        ("adverse_missed", adverse & ~covered & (content == "procedure"), F.lit(-0.04)),
        ("adverse_source", adverse & F.col("_penalised"), F.lit(-0.08)),
    ]
    score = F.col(similarity).cast("double") + F.least(F.lit(0.12), cov * 0.14)
    for _, condition, delta in steps:
        if delta is not none:
            score = score + F.when(condition, delta).otherwise(0.0)
    why = F.array_compact(F.array(*(F.when(condition, F.lit(V.REASONS[name])) for name, condition, _ in steps)))
    return df.withColumns({"adjusted_score": F.round(score, 6), "lexical_coverage": F.round(cov, 6), "rejected": consent | case_rejected, "reasons": why}).drop(*QUESTION, *TEXT, "_coverage")
