"""Text functions as Column expressions: normalising, tokens, shingles, hashes, titles, escapes."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import NEW_CHAT_TITLE, STOP_WORDS

SPACE = r"(?U)\s+"
#: What \s matches in (?U).
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OTHER = re.compile("[^a-z0-9]+")
FOREIGN = re.compile("[^\\x00-\\x7f]+")
PLAIN = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


@lru_cache(1)
def folding() -> tuple[str, str, dict[str, str]]:
    """NFKD without combining marks, in lower case: characters that become one character, and those that become several."""
    one, to, many = [], [], {}
    for i in range(0x80, sys.maxunicode + 1):
        c = chr(i)
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF or 0xF900 <= i <= 0xFAFF or i >= 0x10000:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if d == c.lower() or not d.isascii():
            continue
        if len(d) == 1:
            one.append(c)
            to.append(d)
        elif d and (i < 0x250 or 0x2100 <= i < 0x2190 or 0xFB00 <= i < 0xFB07):
            many[c] = d
    return "".join(one), "".join(to), many


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fold(c: Column) -> Column:
    """c in lower case, without accents or other combining marks."""
    one, to, many = folding()
    full = F.regexp_replace(c, r"\p{M}+", "")
    rare = full
    for a, b in many.items():
        rare = F.replace(rare, F.lit(a), F.lit(b))
    full = F.when(c.rlike(f"[{''.join(many)}]"), rare).otherwise(full)
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.lower(F.translate(full, one, to)))


def normalize(c: Column) -> Column:
    """Folded words of a-z and 0-9, one blank between."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


class Folded(dict):
    """What normalize() makes of each character beyond ASCII: letters, nothing of a mark, else a blank."""

    def __init__(self):
        one, to, many = folding()
        super().__init__({ord(a): b for a, b in (*zip(one, to, strict=True), *many.items())})

    def __missing__(self, i: int) -> str:
        lower = chr(i).lower()
        self[i] = "" if unicodedata.category(chr(i))[0] == "M" else lower if lower.isascii() else " "
        return self[i]


@lru_cache(1)
def folded() -> Folded:
    return Folded()


def normalized(text: str) -> str:
    """normalize() of a Python string: a character after the other, as what it becomes depends on nothing else."""
    if not text.isascii():
        table, foreign = folded(), {c for c in set(text) if c > "\x7f"}
        if len(foreign) > 50:
            text = FOREIGN.sub(lambda m: m[0].translate(table), text)
        else:
            for c in foreign:
                text = text.replace(c, table[ord(c)])
    return " ".join(text.encode().translate(PLAIN).decode().split())


def _normalized(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else normalized(x) for x in c.to_pylist()], pa.string())


def normalize_long(c: Column) -> Column:
    """normalize() of whole texts, a batch at a time in Python: its patterns take many times as long. Not for lambdas."""
    return F.arrow_udf(_normalized, "string")(c)


def normalize_answer(c: Column) -> Column:
    """Folded text with its punctuation, white space collapsed."""
    return strip(F.regexp_replace(fold(c), SPACE, " "))


@lru_cache(1)
def marks() -> re.Pattern:
    """All combining marks."""
    return re.compile("[" + "".join(c for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.combining(c)) + "]+")


def normalize_py(text: str) -> str:
    """normalize() of a Python string."""
    if not text.isascii():
        text = marks().sub("", unicodedata.normalize("NFKD", text))
    return OTHER.sub(" ", text.lower()).strip()


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """White space collapsed and stripped."""
    return strip(F.regexp_replace(c, SPACE, " "))


def words(normalized: Column) -> Column:
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def tokens(normalized: Column) -> Column:
    """Distinct words of three letters or more that are no stop words and not all digits."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(F.array_except(words(normalized), stop), lambda w: (F.length(w) >= 3) & ((w >= "a") | ~w.rlike("^[0-9]+$")))


def shingles(normalized: Column, size: int = 5) -> Column:
    """Distinct word n-grams; of fewer words, all as one; of none, none."""
    def of(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(grams))

    return let(words(normalized), of)


def set_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and containment in the smaller; 0 if either is empty."""
    common, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.greatest(common / (F.size(a) + F.size(b) - common), common / least))


def coverage(question_tokens: Column, text_tokens: Column) -> Column:
    n = F.size(question_tokens)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(question_tokens, text_tokens)) / n)


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(collapse(c)), 256)


def stem(path: Column) -> Column:
    """A path's file name without its last suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def slug(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stem(path)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_id(document_id: Column, index: Column, digest: Column) -> Column:
    return F.format_string("%s_%05d_%s", document_id, index, F.substring(digest, 1, 10))


def lines(c: Column) -> Column:
    """Stripped lines that aren't empty, split where str.splitlines() splits."""
    every = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(F.transform(every, strip), lambda x: x != "")


def lines_long(c: Column, border: int | None = None) -> Column:
    """lines() of whole texts, a batch at a time in Python; border: only so many first and last ones. Not for lambdas."""

    def split(c: pa.Array) -> pa.Array:
        out = [None if x is None else [y for y in (z.strip(BLANKS) for z in x.splitlines()) if y] for x in c.to_pylist()]
        if border is not None:
            out = [x if x is None or len(x) <= border else x[:border] + x[-border:] for x in out]
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(split, "array<string>")(c)


def signature(line: Column) -> Column:
    """A line's form with short numbers masked."""
    return F.regexp_replace(F.lower(collapse(line)), r"(?U)\b\d{1,4}\b", "<n>")


def chat_title(c: Column) -> Column:
    c = collapse(c)
    return F.when(F.length(c) <= 60, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, 57), r"(?U)\s+$", ""), F.lit("...")))


def clean_title(c: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(collapse(c), 1, 160), F.lit("")), F.lit(NEW_CHAT_TITLE))


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def preview(c: Column, n: int = 600) -> Column:
    return F.substring(c, 1, n)


def bounded(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def embedding_text(document_type: Column, content_type: Column, topic: Column, section: Column, text: Column) -> Column:
    parts = zip(("tipo de documento: ", "; tipo de conteudo: ", "; tema: ", "; secao: "), (document_type, content_type, topic, section), ("desconhecido", "geral", "tricologia", "geral"), strict=True)
    return F.concat(*(x for label, c, default in parts for x in (F.lit(label), F.coalesce(c, F.lit(default)))), F.lit(".\n"), text)


def merge_overlap(a: Column, b: Column, least: int = 5, most: int = 120) -> Column:
    """a followed by b, without the longest run of least..most words that ends a and begins b."""
    parts = lambda c: F.filter(F.split(c, SPACE), lambda w: w != "")

    def join(s: Column) -> Column:
        top = F.least(F.lit(most), F.size(s.x), F.size(s.y))
        sizes = F.when(top >= least, F.sequence(top, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        ends = F.struct(F.slice(s.x, F.greatest(F.size(s.x) - most + 1, F.lit(1)), most).alias("a"), F.slice(s.y, 1, most).alias("b"))
        found = let(ends, lambda e: F.coalesce(F.get(F.filter(sizes, lambda k: F.slice(e.a, F.size(e.a) - k + 1, k) == F.slice(e.b, F.lit(1), k)), F.lit(0)), F.lit(0)))
        return F.array_join(F.concat(s.x, F.slice(s.y, found + 1, F.greatest(F.size(s.y), F.lit(1)))), " ")

    return let(F.struct(parts(a).alias("x"), parts(b).alias("y")), join)
