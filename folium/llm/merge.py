"""Operator 11: three-way merge of a table's branches, by rows, columns and lines.

1. *Tables.* Base, L and R have a row an id: columns, and the text's lines with identifiers that stay what they are
   while a branch is edited: line k of the base is 2k, what a branch inserts after it is 2k + 1 (-1 before the first
   line). A branch is a whole table of rows and identifiers, in which a line that it hasn't touched refers to the
   base's line by its identifier, instead of repeating its text; this keeps branches small. branch() makes L or R by
   the contract's edits; both are written to the shared folder as Parquet, as the base is already.
2. *Join.* L and R meet in a full outer join by id, and that one meets the base in another: the wide rows of the base
   move once. Each side is one row an id before it is joined, so no join multiplies rows.
3. *Merge.* An Arrow-batched pandas function merges each triple of rows by itself. Nothing is collected or broadcast,
   and no task gets more than its share of ids.

One-sided and equal changes are clean, others conflicts that take the base's state: of a column (by its value), a line,
what is inserted in a gap between lines, a row that the base doesn't have (by its values). A row that one branch drops
and the other changes is one edit-delete conflict; dropped and unchanged, or dropped twice, it is clean.

Defined results: null texts, langs and sources are empty; an empty text is one empty line, a text that has lost all
lines is empty. Rows without an id can't be merged with anything: they come back unchanged, each by itself, without
changes. Rows that repeat an id are one row, that of the smallest hash of its values: base and branches choose alike,
and equal rows are the same anyway. A branch that adds a row under an id that the base has conflicts with it
(insert-insert), and the base's row stays as the branches leave it. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import runtime as R

COLUMNS = ("lang", "source")
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
MERGED = "doc_id long, lang string, source string, text string, n_clean long, n_edit_edit long, n_edit_delete long, n_insert_insert long"
#: The contract's codes, modulo MODULUS: dropped, edited by appending, something added.
MODULUS, DROP, APPEND, ADD = 11, 0, {1: "!", 2: "?"}, {3: "!", 4: "?"}
#: What a branch adds is row OFFSET - doc_id.
OFFSETS = {"L": -1, "R": -2}


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text, version of docs; version: which of the rows that repeat an id this is."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*COLUMNS, "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own).withColumn("version", F.xxhash64(*COLUMNS, "text"))


def code(branch: str, name: Column) -> Column:
    return (F.crc32(F.concat(F.lit(f"{branch}:"), F.col("doc_id").cast("string"), F.lit(":"), name).cast("binary")) % MODULUS).cast("int")


def appended(c: Column, edit: Column) -> Column:
    """c as the branch leaves it: null where it is only referred to."""
    out = F.when(edit == DROP, F.lit(""))
    for k, mark in APPEND.items():
        out = out.when(edit == k, F.concat(c, F.lit(mark)))
    return out


def branch(base: DataFrame, name: str) -> DataFrame:
    """The branch's table: doc_id, added, version, lang, source, ids, texts; a null text refers to the base's line."""
    base = base.where("doc_id is not null").withColumn("_row", code(name, F.lit("row")))
    columns = [F.coalesce(appended(F.col(c), code(name, F.lit(c))), F.col(c)).alias(c) for c in COLUMNS]
    nothing, one = F.lit(None).cast("string"), lambda i, t: F.struct(i.cast("int").alias("id"), t.alias("text"))

    def line(x: Column, k: Column) -> Column:
        def of(c: Column) -> Column:
            own = F.when(c == DROP, F.array().cast("array<struct<id:int,text:string>>")).when(c.isin(*APPEND), F.array(one(2 * k, appended(x, c))))
            for i, mark in ADD.items():
                own = own.when(c == i, F.array(one(2 * k, nothing), one(2 * k + 1, F.lit(mark))))
            return own.otherwise(F.array(one(2 * k, nothing)))

        return let(code(name, k.cast("string")), of)

    lines = F.flatten(F.transform(F.split("text", "\n", -1), line))
    kept = base.where(F.col("_row") != DROP).select("doc_id", F.lit(False).alias("added"), "version", *columns, lines.alias("lines"))
    kept = kept.select("doc_id", "added", "version", *COLUMNS, F.col("lines.id").alias("ids"), F.col("lines.text").alias("texts"))
    mark = F.when(F.col("_row") == 3, ADD[3]).otherwise(ADD[4])
    new = base.where(F.col("_row").isin(*ADD)).select((F.lit(OFFSETS[name]) - F.col("doc_id")).alias("doc_id"), F.lit(True).alias("added"), "version", *COLUMNS, F.array(F.lit(0)).alias("ids"), F.array(mark).alias("texts"))
    return kept.unionByName(new)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, kept as Parquet in the folder that all executors share."""
    at = f"{R.shared_dir(R.attach(df.sparkSession))}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


State = tuple[dict[int, str | None], dict[int, tuple[str | None, ...]]]


def state(ids: Sequence[int], texts: Sequence[str | None]) -> State:
    """A branch's lines by number, null where they are the base's, and what it has inserted in gaps."""
    lines: dict[int, str | None] = {}
    gaps: dict[int, tuple[str | None, ...]] = {}
    for i, t in zip(ids, texts, strict=True):
        if i & 1:
            gaps[i] = (*gaps.get(i, ()), t)
        else:
            lines[i] = t
    return lines, gaps


def changed(base: tuple, own: tuple, lines: list[str], s: State) -> bool:
    return own != base or bool(s[1]) or len(s[0]) != len(lines) or any(t is not None and t != lines[i >> 1] for i, t in s[0].items())


def merged_lines(lines: list[str], left: State, right: State, count: list[int]) -> list[str]:
    """The merged lines; count gets clean changes, edit-edit, edit-delete and insert-insert conflicts."""
    out: list[str] = []
    (l_lines, l_gaps), (r_lines, r_gaps) = left, right
    for k in range(-1, len(lines)):
        i, own = 2 * k, lines[k]
        if k >= 0:
            a, b = i in l_lines, i in r_lines
            x, y = l_lines.get(i), r_lines.get(i)
            if x == own:
                x = None
            if y == own:
                y = None
            if a and b and x is None and y is None:
                out.append(own)
            elif a == b and x == y:  # changed alike
                count[0] += 1
                if a:
                    out.append(x)
            elif b and y is None:  # left has changed it, right not
                count[0] += 1
                if a:
                    out.append(x)
            elif a and x is None:
                count[0] += 1
                if b:
                    out.append(y)
            else:
                count[1 if a and b else 2] += 1
                out.append(own)
        x, y = l_gaps.get(i + 1), r_gaps.get(i + 1)
        if x or y:
            if x and y and x != y:
                count[3] += 1
            else:
                count[0] += 1
                out.extend(x or y)
    return out


def merged_row(base: tuple | None, left: tuple | None, right: tuple | None, new_left: tuple | None, new_right: tuple | None) -> tuple:
    """lang, source, text (all null for no row), and the four counts.

    base: columns and text; left, right: columns, ids and texts of the branches' rows, new_left and new_right of those
    that they add.
    """
    count = [0, 0, 0, 0]
    row = None
    if base is not None:
        own, lines = base[:-1], base[-1].split("\n")
        sides = [None if s is None else (s[:-2], state(*s[-2:])) for s in (left, right)]
        if None in sides:
            other = sides[0] or sides[1]
            if other and changed(own, other[0], lines, other[1]):
                count[2] += 1
                row = base
            else:
                count[0] += 1
        else:
            (a, l_state), (b, r_state) = sides
            columns = []
            for was, x, y in zip(own, a, b, strict=True):
                if x == y or y == was:
                    columns.append(x)
                    count[0] += x != was
                elif x == was:
                    columns.append(y)
                    count[0] += 1
                else:
                    columns.append(was)
                    count[1] += 1
            row = (*columns, "\n".join(merged_lines(lines, l_state, r_state, count)))
    new = [(*s[:-2], "\n".join(t or "" for t in s[-1])) for s in (new_left, new_right) if s is not None]
    if new:
        if base is not None or len(set(new)) > 1:
            count[3] += 1
        else:
            count[0] += 1
            row = new[0]
    return (*(row or (None,) * (len(COLUMNS) + 1)), *count)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in MERGED.split(", ")]
    for b in batches:
        present = b["present"].tolist()
        base = list(zip(*(b[f"b_{c}"] for c in (*COLUMNS, "text")), strict=True))
        sides = []
        for s in ("l", "r", "nl", "nr"):
            ids = b[f"{s}_ids"]
            sides.append([None if i is None else (*x, i.tolist(), t) for i, *x, t in zip(ids, *(b[f"{s}_{c}"] for c in COLUMNS), b[f"{s}_texts"], strict=True)])
        rows = [(i, *merged_row(x if here else None, *y)) for i, here, x, *y in zip(b["doc_id"], present, base, *sides, strict=True)]
        yield pd.DataFrame(rows, columns=names)


def _one_row(table: DataFrame, prefix: str) -> DataFrame:
    """A row an id: the branch's own row and the one that it adds, of the smallest version each."""
    values = F.struct(*COLUMNS, "ids", "texts")
    pick = lambda added: F.min_by(F.when(F.col("added") == added, values), F.when(F.col("added") == added, F.col("version")))
    return table.groupBy("doc_id").agg(pick(False).alias(prefix), pick(True).alias(f"n{prefix}")).withColumnRenamed("doc_id", f"{prefix}_id")


def merge(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """MERGED: every id ever present in base (base_table()) or the branches (as branch() makes them).

    Null lang, source and text: the row is gone, or conflicting branches have added it.
    """
    whole = F.struct(*COLUMNS, "text")
    known = base.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(whole, F.col("version")).alias("b"))
    sides = _one_row(left, "l").join(_one_row(right, "r"), F.col("l_id") == F.col("r_id"), "full_outer")
    sides = sides.select(F.coalesce("l_id", "r_id").alias("s_id"), "l", "nl", "r", "nr")
    triples = known.join(sides, F.col("doc_id") == F.col("s_id"), "full_outer")
    columns = [F.coalesce("doc_id", "s_id").alias("doc_id"), F.col("b").isNotNull().alias("present"), *(F.col(f"b.{c}").alias(f"b_{c}") for c in (*COLUMNS, "text"))]
    columns += [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("l", "r", "nl", "nr") for c in (*COLUMNS, "ids", "texts")]
    merged = triples.select(*columns).mapInPandas(_merge, MERGED)
    lone = base.where("doc_id is null").select("doc_id", *COLUMNS, "text", *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    return merged.unionByName(lone)


def merged_branches(docs: DataFrame) -> DataFrame:
    """MERGED of docs (doc_id, text, lang, source) and its branches L and R."""
    base = base_table(docs)
    left, right = (written(branch(base, name), f"branch-{name}") for name in ("L", "R"))
    return merge(base, left, right)
