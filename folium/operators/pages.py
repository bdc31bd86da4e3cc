"""Paged documents: repeated lines, cleaning, joining pages, page ranges and neighbour windows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import fixed_values as V
from ..functions import text as T
from ..storage import attach, kept
from . import running


def repeated_lines(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """document, signature, pages: forms of lines at page borders that a document has config.repeated_pages times or more.

    pages: document, page, text. A raw line counts once a page; two raw lines of one form count twice.
    """
    attach(pages.sparkSession)
    border = F.array_distinct(T.lines_long(F.col("text"), config.border_lines))
    rows = pages.select("document", "page", F.explode(border).alias("line")).where(F.length("line").between(config.min_line, config.max_line))
    return rows.groupBy("document", T.signature(F.col("line")).alias("signature")).agg(F.count("*").alias("pages")).where(F.col("pages") >= config.repeated_pages)


def without_repeated_lines(pages: DataFrame, repeated: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """pages with `text` free of their document's repeated lines, and n_removed."""
    attach(pages.sparkSession)
    lines = pages.select("document", "page", F.posexplode_outer(T.lines_long(F.col("text"))).alias("n", "line"))
    lines = lines.withColumn("signature", F.when(F.length("line").between(config.min_line, config.max_line), T.signature(F.col("line"))))
    found = lines.join(repeated.select("document", "signature", F.lit(True).alias("gone")), ["document", "signature"], "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("gone").isNull() & F.col("line").isNotNull(), F.struct("n", "line"))))
    return found.groupBy("document", "page").agg(F.array_join(F.transform(kept, lambda x: x.line), "\n").alias("text"), F.count("gone").alias("n_removed"))


def literal_of(pattern: str) -> str:
    """What a text must hold, in lower case, for a pattern of cleaning to match; empty where nothing is that simple."""
    plain = re.sub(r"^\(\?\w+\)", "", pattern)
    if V.SECTION_START in plain:
        return ":"
    if "\\|" in plain:
        return "|"
    if re.match(r"\\s\+-|\(\[.*?\]\)-", plain):
        return "-"
    return re.match(r"[^\W\d_]?[^\[(.\\^$*+?{}|]*", plain)[0].lower() if plain[:1] not in "([^\\ \n" else ""


def replaced(c: Column, pattern: str, to: str) -> Column:
    """regexp_replace(), tried only where the text has what the pattern can't do without."""
    known = literal_of(pattern)
    if not known:
        return F.regexp_replace(c, pattern, to)
    # upper, then lower: letters that patterns without case take for others
    folded = (lambda x: F.lower(F.upper(x))) if known.upper() != known else (lambda x: x)
    return T.let(c, lambda x: F.when(F.contains(folded(x), F.lit(known)), F.regexp_replace(x, pattern, to)).otherwise(x))


def literals_of(pattern: str) -> list[str]:
    """What a text must hold one of, in lower case, for a pattern of boilerplate to match."""
    first = re.match(r"\(([^()\[\\.*+?{}^$]*)\)", pattern)
    return [x.lower() for x in first[1].split("|")] if first else [literal_of(pattern)]


def without_boilerplate(c: Column) -> Column:
    """Patterns are tried only where a text has what one of them begins with, in any case: it is folded once for all of them."""
    known = [x for p in V.BOILERPLATE for x in literals_of(p)]

    def replaced_in(x: Column) -> Column:
        for p in V.BOILERPLATE:
            x = F.regexp_replace(x, f"(?siuU){p}", " ")
        return x

    def some(x: Column) -> Column:
        return T.let(F.lower(F.upper(x)), lambda y: reduce(lambda a, b: a | b, (F.contains(y, F.lit(k)) for k in known)))

    return T.let(c, lambda x: F.when(some(x), replaced_in(x)).otherwise(x)) if all(known) else replaced_in(c)


def cleaned(c: Column) -> Column:
    """A page's text without licences, page numbers, broken words and narrow line ends; headings start paragraphs."""
    c = without_boilerplate(c)
    for pattern, to in V.CLEANING:
        c = replaced(c, pattern, to)
    return T.strip(c)


def skipped_pages(name: Column) -> Column:
    """How many first pages of a file to skip, by parts of its name."""
    chain = F.lit(0)
    for part, n in reversed(V.SKIPPED_PAGES.items()):
        chain = F.when(F.contains(F.lower(name), F.lit(part.lower())), n).otherwise(chain)
    return chain


def joined_hyphens(pages: DataFrame) -> DataFrame:
    """pages (document, page, text) with words broken between pages joined, and no_space_before."""
    # only a text's first and last characters count, and only they go through the windows
    borders = F.struct(F.expr("right(text, 4)").rlike("[A-Za-zÀ-ÖØ-öø-ÿ]-$").alias("breaks"), F.expr("left(text, 1)").rlike("^[a-zà-öø-ÿ]").alias("goes_on"))
    own = kept(pages.withColumns({"_own": borders, "_row": F.monotonically_increasing_id()}))
    near = running.neighbours(own.select("document", "page", "_row", "_own"), ["document"], "page", F.col("_own"), "_prev", "_next")
    broken = F.coalesce(F.col("_own.breaks") & F.col("_next.goes_on"), F.lit(False)).alias("_broken")
    near = near.select("_row", broken, F.coalesce(F.col("_prev.breaks") & F.col("_own.goes_on"), F.lit(False)).alias("no_space_before"))
    out = own.drop("_own").join(near, "_row")
    return out.withColumn("text", F.when(F.col("_broken"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))).drop("_row", "_broken")


def offsets(pages: DataFrame) -> DataFrame:
    """pages (document, page, text or its _length, no_space_before) with the start and stop of each in the document's joined text."""
    gap = F.when(F.col("no_space_before"), 0).otherwise(1)
    first = pages.groupBy(F.col("document").alias("_document")).agg(F.min_by(gap, "page").alias("_first"))
    # measured before rows move: a caller who needs places only moves no texts
    measured = pages if "_length" in pages.columns else pages.withColumn("_length", F.length("text"))
    out = running.running_total(measured, ["document"], "page", F.col("_length") + gap, "stop").join(first, F.col("document").eqNullSafe(F.col("_document")))
    out = out.withColumn("stop", F.col("stop") - F.col("_first"))
    return out.withColumn("start", F.col("stop") - F.col("_length")).drop("_document", "_first", "_length")


def overlapping_pages(units: DataFrame, spans: DataFrame, *, bucket: int = 4096) -> DataFrame:
    """document, unit, page_start, page_end: the pages that each unit overlaps, or the nearest page.

    units: document, unit, start, stop; spans: document, page, start, stop. Both are cut at multiples of
    `bucket`, so the overlap is an equality join, whatever a document's length.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bucket)))
    u = units.select("document", "unit", F.col("start").alias("us"), F.col("stop").alias("ue"))
    s = spans.select("document", "page", F.col("start").alias("ss"), F.col("stop").alias("se"))
    met = u.withColumn("b", cut("us", "ue")).join(s.withColumn("b", cut("ss", "se")), ["document", "b"]).where("us < se and ue > ss")
    met = met.groupBy("document", "unit").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    # A unit that overlaps nothing lies before, between or behind pages: the last border before it and the first after it are near.
    lone = u.join(met, ["document", "unit"], "left_anti")
    borders = s.select("document", "page", F.explode(F.array("ss", "se")).alias("at"), F.lit(None).cast("long").alias("unit"))
    places = lone.select("document", F.lit(None).cast(s.schema["page"].dataType).alias("page"), F.col("us").alias("at"), "unit").unionByName(borders)
    # of borders at one place, the smaller page; of two as near, that of the smaller page too
    near = running.nearest(places, ["document"], "at", "page", "_before", "_after").where("unit is not null")
    far = lambda c: F.abs(F.col(c)["at"] - F.col("at"))
    page = F.when(F.col("_after").isNull() | (far("_before") < far("_after")), F.col("_before")["page"]).when(F.col("_before").isNull() | (far("_after") < far("_before")), F.col("_after")["page"]).otherwise(F.least(F.col("_before")["page"], F.col("_after")["page"]))
    near = near.withColumn("_page", page).where("_page is not null")
    return met.unionByName(near.select("document", "unit", F.col("_page").alias("page_start"), F.col("_page").alias("page_end")))


def page_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """key and pages: "a-b, c" of the ranges (key, page_start, page_end), joined where they touch."""
    w = Window.partitionBy(key).orderBy("page_start", "page_end")
    before = F.max("page_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("page_start") > before + 1), 1).otherwise(0)
    islands = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(key, "_island").agg(F.min("page_start").alias("a"), F.max("page_end").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.sort_array(F.collect_list(F.struct("a", label.alias("label"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x.label), ", ").alias("pages"), F.count("*").alias("n_ranges"))


def positions(chunks: DataFrame, *, document: str = "document_id", order: str = "global_pos") -> DataFrame:
    """chunks with doc_pos, the place within their document from 0; order is an integer column."""
    return running.places(chunks, [document], order, "doc_pos")


def neighbours(centres: DataFrame, chunks: DataFrame, window: int, *, same_section: bool = True) -> DataFrame:
    """centre_id and the chunks at most `window` places away in its document; other sections and kinds only where not same_section.

    centres and chunks: chunk_id, document_id, doc_pos, section, content_type. Chunks are dealt out by the
    place that they are near to, so the range join is an equality join.
    """
    near = chunks.withColumn("_at", F.explode(F.sequence(F.col("doc_pos") - window, F.col("doc_pos") + window)))
    c = centres.select(F.col("chunk_id").alias("centre_id"), "document_id", F.col("doc_pos").alias("_at"), F.col("section").alias("_section"), F.col("content_type").alias("_content"))
    out = c.join(near, ["document_id", "_at"])
    if same_section:
        alike = ((F.col("_section") != "general") & (F.col("section") == F.col("_section"))) | ((F.col("_content") != "general") & (F.col("content_type") == F.col("_content")))
        out = out.where((F.col("doc_pos") == F.col("_at")) | alike)
    return out.drop("_at", "_section", "_content")
