"""Checks of generated answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from . import text as T
from .rules import any_of


def citations(answer: Column) -> Column:
    """Sorted distinct numbers cited as [n]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))))


def needs_next_step(n: Column) -> Column:
    """Of a question normalised by normalize_answer()."""
    return any_of(n, V.NEXT_STEP_QUESTION)


def after_procedure(n: Column) -> Column:
    """Of a question normalised by normalize_answer()."""
    return any_of(n, V.CASE_PROCEDURES) & any_of(n, V.CASE_SYMPTOMS)


def unsafe(answer: Column) -> Column:
    """Whether the answer prescribes or doses."""
    out = F.lit(False)
    for p in V.UNSAFE:
        out |= answer.rlike(f"(?iuU){p}")
    return out


def problems(answer: Column, sources: Column, question: Column) -> Column:
    """Up to six kinds of problems, in fixed order."""

    def of(x: Column) -> Column:
        bad = F.filter(x.cited, lambda c: (c < 1) | (c > sources))
        plan = needs_next_step(x.asked) | after_procedure(x.asked)
        cut = F.lit(False)
        for end in V.CUT_OFF_ENDS:
            cut |= x.n.endswith(end)
        return F.array_compact(
            F.array(
                F.when((sources > 0) & (F.size(x.cited) == 0), F.lit(V.NO_CITATIONS)),
                F.when(F.size(bad) > 0, F.concat(F.lit(V.BAD_CITATIONS), F.lit("["), F.array_join(bad.cast("array<string>"), ", "), F.lit("]"))),
                F.when(unsafe(answer), F.lit(V.PRESCRIPTIVE)),
                F.when(plan & ~x.n.contains(V.PLAN_HEADING), F.lit(V.NO_PLAN)),
                F.when(plan & ~any_of(x.n, V.ACTIONS), F.lit(V.NO_ACTION)),
                F.when(cut, F.lit(V.CUT_OFF)),
            )
        )

    return T.let(F.struct(citations(answer).alias("cited"), T.normalize_answer(answer).alias("n"), T.normalize_answer(question).alias("asked")), of)


def status(question: Column, index: Column, sources: Column, answer: Column, failed: Column, found: Column) -> Column:
    """What became of a question: vazio, erro_indice, sem_material, erro_modelo, resposta_bloqueada or ok.

    index: whether it could be read; failed: whether the model did; found: the answer's problems.
    """
    return (
        F.when(T.strip(F.coalesce(question, F.lit(""))) == "", F.lit("vazio"))
        .when(~index, F.lit("erro_indice"))
        .when(F.coalesce(sources, F.lit(0)) == 0, F.lit("sem_material"))
        .when(failed | answer.isNull() | (T.strip(answer) == ""), F.lit("erro_modelo"))
        .when(F.size(found) > 0, F.lit("resposta_bloqueada"))
        .otherwise(F.lit("ok"))
    )
