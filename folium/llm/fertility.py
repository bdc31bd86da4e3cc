"""Operator 4: quality rules from tokeniser fertility.

Public vocabularies cut each word into tokens. Of every document, for each vocabulary:

* fertility: characters of words per token;
* fallback: the share of tokens that are no whole characters (byte fallback);
* evenness: the entropy of its tokens over the largest that as many tokens can have.

Prose of a language keeps within a band of each; noise, symbols and lists fall outside. Bands hold for a
language (where there is none, for the script of most letters) and for documents of like length in words, as
evenness falls with length. They are taken over all distinct texts, so that copies don't narrow them: from `spread` times the distance of the
quartiles below the first quartile to as much above the third. Quartiles come from counts of values in
fixed bins, which add up exactly in any order. A document is kept if the base rules hold and all its
measures are in their bands. Every document is judged: a length of fewer than `least_group` texts takes in
the neighbouring lengths, at last the whole language; a language of fewer than that has FIXED_BANDS. As two
tokens more or less say nothing, a band is wider by their share of the document's tokens.

Only words are cut, each distinct word of a chunk once.

Defined results: a null or blank text has no words and fails the base rule. A null or unknown language
is judged by script. Rows with null or repeated doc_id are judged like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime as R

MEASURES = ("fertility", "fallback", "evenness")
SYMBOLS = b"#*$%&|<>"
WINDOW, SLACK_TOKENS, LEAST_GROUP, SPREAD = 5, 2, 32, 2.25
#: Bins of one unit of a measure; groups of lengths to a doubling; bands that are rows enough to be joined by broadcast.
BINS, LENGTHS, BROADCAST_BANDS = 2048, 2, 50_000
#: How each measure changes with a doubling of the words (evenness: 0.049 to 0.053 on clean texts of four languages).
SLOPES = (0.0, 0.0, -0.05)
#: A band reaches at least this far beyond the quartiles: texts with a few words of other languages have some fallback.
REACH = (0.0, 0.05, 0.0)
#: Evenness at 256 words; bands for languages of too few texts, mostly ASCII and others. Of evenness, low is the distance below the usual.
EVEN_AT_256 = 0.7
FIXED_BANDS = ({"fertility": (1.4, 7.0), "fallback": (0.0, 0.25), "evenness": (-0.12, 1.0)}, {"fertility": (0.25, 7.0), "fallback": (0.0, 1.0), "evenness": (-0.25, 1.0)})
VOCABULARIES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
#: Where scripts' letters begin and end (fixed values of Unicode).
SCRIPTS = {"Latn": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "Grek": [(0x370, 0x3FF)], "Cyrl": [(0x400, 0x52F)], "Hebr": [(0x590, 0x5FF)], "Arab": [(0x600, 0x6FF)], "Deva": [(0x900, 0x97F)], "Thai": [(0xE00, 0xE7F)], "Kana": [(0x3040, 0x30FF)], "Hang": [(0xAC00, 0xD7AF)], "Hani": [(0x4E00, 0x9FFF)]}
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@lru_cache(4)
def encoder(path: str) -> tuple[Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A function from words to (tokens of each, all ids), and which ids are no whole characters."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.vocab_size())])

        def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = sp.encode([w.decode() for w in words], num_threads=1) if words else []
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return size, np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))

        return pieces, odd

    from .bpe import vocabulary

    bpe, table = vocabulary(path)

    def whole(b: bytes) -> bool:
        try:
            b.decode()
        except UnicodeDecodeError:
            return False
        return True

    def tokens(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [bpe.encode_ordinary(" " + w.decode()) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter((x for y in ids for x in y), np.int64, int(size.sum()))

    return tokens, np.array([not whole(b) for b in table])


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between the offsets."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[off[1:]] - total[off[:-1]]


def repeated_words(h: np.ndarray, ptr: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """How many words of each document are in windows of k words that it has twice or more."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    at = R.spread(n, ptr[:-1])
    if not len(at):
        return np.zeros(len(ptr) - 1, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    key = R.mix(R.rolling(h, k)[at] ^ R.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    twice = at[order[np.r_[same, False] | np.r_[False, same]]]
    cover = np.zeros(len(h) + 1, np.int32)
    cover[: len(h)] += np.bincount(twice, minlength=len(h)).astype(np.int32)
    cover -= np.bincount(twice + k, minlength=len(h) + 1).astype(np.int32)
    return per_doc(np.cumsum(cover[:-1]) > 0, ptr)


def script_of(text: bytes) -> str:
    """The script that most letters are of."""
    cp = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    count = {name: sum(int(((cp >= a) & (cp <= b)).sum()) for a, b in ranges) for name, ranges in SCRIPTS.items()}
    best = max(count, key=count.get)
    return f"script {best if count[best] else 'none'}"


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(codes: np.ndarray, ptr: np.ndarray, size: np.ndarray, flat: np.ndarray, odd: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of each document, and MEASURES; codes: its words by number, size and flat: each word's tokens."""
    start = np.cumsum(size) - size
    tokens = flat[R.spread(size[codes], start[codes])]
    end = np.r_[0, np.cumsum(size[codes])][ptr]
    n = np.diff(end)
    fallback = per_doc(odd[tokens], end)
    key = np.sort(np.repeat(np.arange(len(n)), n) * len(odd) + tokens)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    doc = key[first] // len(odd)
    p = count / np.maximum(n[doc], 1)
    entropy = np.bincount(doc, -p * np.log2(p), minlength=len(n)) if len(p) else np.zeros(len(n))
    top = np.log2(np.clip(n, 2, len(odd)))
    return n, chars / np.maximum(n, 1), fallback / np.maximum(n, 1), entropy / top


def _measure(paths: tuple[str, ...]) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for b in R.slices(batches, "text"):
            data, off = R.flat_utf8(b.column("text"))
            words, ptr = R.words_of(data, off)
            d = words.dictionary_encode()
            codes, distinct = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()
            chars = per_doc(~R.WHITE[data] & ((data & 0xC0) != 0x80), off)
            raw = data.tobytes()
            lines = [repeated_lines(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            h = np.fromiter(map(R.xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes] if len(codes) else np.zeros(0, np.uint64)
            lang = [x or script_of(raw[i:j]) for x, i, j in zip(b.column("lang").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]
            base = [np.diff(ptr), chars, per_doc(symbol[data], off), np.array(lines), repeated_words(h, ptr)]
            out = [b.column("doc_id"), b.column("row_key"), pa.array(lang, pa.string()), *(pa.array(x, pa.int64()) for x in base)]
            found = []
            for path in paths:
                cut, odd = encoder(path)
                found.append(measures(codes, ptr, *cut(distinct), odd, chars))
            out.append(pa.array(np.min([x[0] for x in found], axis=0), pa.int64()))
            out.append(pa.array(np.column_stack([y for x in found for y in x[1:]]).tolist(), pa.list_(pa.float64())))
            out.append(pa.array([R.xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.uint64()).view(pa.int64()))
            out.append(pa.array(2 * per_doc(data >= 0xC0, off) > chars))
            yield pa.record_batch(out, names=["doc_id", "row_key", "lang", *COLUMNS, "n_tokens", "measures", "text_hash", "wide"])

    return measure


def row_key() -> Column:
    """Tells rows with one doc_id apart by what the verdict comes from."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")))


def measured(docs: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """doc_id, row_key, lang (or script), COLUMNS, n_tokens, measures (MEASURES of each vocabulary), a hash of the text and
    whether most characters are beyond ASCII, of docs (doc_id, text, lang)."""
    R.attach(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), row_key().alias("row_key"))
    return docs.mapInArrow(_measure(paths), f"doc_id long, row_key long, lang string, {', '.join(f'{c} long' for c in COLUMNS)}, n_tokens long, measures array<double>, text_hash long, wide boolean")


def key_bands(length: np.ndarray, value: np.ndarray, count: np.ndarray, slope: float, spread: float, least_group: int, reach_least: float = 0.0) -> list[tuple[int, float, float]]:
    """(length, low, high) of one measure of one language; nothing where all its lengths together are too few.

    A length of too few texts takes in its neighbours, ever farther ones, moved along the slope to that length.
    A band reaches reach_least beyond the quartiles, and none is narrower than the distance of the quartiles that is usual in the language asks for; that of
    shorter texts counts less, as it falls with the root of the length.
    """
    levels, out = np.unique(length), []
    total = np.array([count[length == x].sum() for x in levels])
    if total.sum() < least_group:
        return []
    for x in levels.tolist():
        far = np.abs(levels - x)
        reach = min(w for w in np.unique(far).tolist() if total[far <= w].sum() >= least_group)
        near = np.abs(length - x) <= reach
        v = value[near] + slope * (x - length[near])
        order = np.argsort(v, kind="stable")
        upto = np.cumsum(count[near][order])
        out.append([x, *(float(v[order][np.searchsorted(upto, q * upto[-1])]) for q in (0.25, 0.5, 0.75))])
    x, q1, q2, q3 = np.array(out).T
    usual = np.median((q3 - q1) * np.minimum(1, 2 ** ((x - x[:, None]) / (2 * LENGTHS))), axis=1)  # of all lengths, those of shorter ones scaled
    width = np.maximum(reach_least, spread * np.maximum.reduce([q3 - q1, usual, 0.02 * q2, np.full(len(x), 2 / BINS)]))
    return [(x, q1 - w, q3 + w) for (x, q1, _, q3), w in zip(out, width, strict=True)]


def _bands(spread: float, least_group: int) -> Callable:
    def of_key(table: pa.Table) -> pa.Table:
        lang, i = table.column("lang")[0].as_py(), table.column("i")[0].as_py()
        length, value, count = (table.column(c).to_numpy() for c in ("length", "bin", "count"))
        found = key_bands(length, value / BINS, count, SLOPES[i % len(MEASURES)] / LENGTHS, spread, least_group, REACH[i % len(MEASURES)])
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "length": pa.array([x[0] for x in found], pa.int32()), "i": pa.array([i] * len(found), pa.int32()), "low": pa.array([x[1] for x in found], pa.float64()), "high": pa.array([x[2] for x in found], pa.float64())})

    return of_key


def bands(rows: DataFrame, spread: float = SPREAD, least_group: int = LEAST_GROUP) -> DataFrame:
    """lang, length, bands: the band of each measure, for each language that has `least_group` texts to judge."""
    texts = rows.select("lang", "length", "text_hash", F.transform("measures", lambda m: F.round(m * BINS).cast("long")).alias("bins")).distinct()
    bins = texts.select("lang", "length", F.posexplode("bins").alias("i", "bin")).groupBy("lang", "length", "i", "bin").count()
    found = bins.groupBy("lang", "i").applyInArrow(_bands(spread, least_group), "lang string, length int, i int, low double, high double")
    return found.groupBy("lang", "length").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("bands"))


def fixed_bands(vocabularies: int) -> Column:
    """FIXED_BANDS of a row, as its characters and its length in words ask for."""
    even = F.lit(EVEN_AT_256) + SLOPES[2] * (F.col("length") / LENGTHS - 8)
    of = [F.array(*(F.struct((even + low if m == "evenness" else F.lit(low)).alias("low"), F.lit(high).alias("high")) for m, (low, high) in x.items())) for x in FIXED_BANDS]
    return F.when(F.col("wide"), F.flatten(F.array_repeat(of[1], vocabularies))).otherwise(F.flatten(F.array_repeat(of[0], vocabularies)))


def judged(docs: DataFrame, paths: tuple[str, ...], *, spread: float = SPREAD, slack: float = SLACK_TOKENS, least_group: int = LEAST_GROUP) -> DataFrame:
    """doc_id, COLUMNS, base_failed, kept, lang, measures and row_key for every row of docs (doc_id, text, lang)."""
    rows = R.checkpointed(measured(docs, paths).withColumn("length", F.round(F.log2(F.greatest("n_words", F.lit(1))) * LENGTHS).cast("int")))
    found = R.checkpointed(bands(rows.where("n_words > 0"), spread, least_group))
    side = F.broadcast(found) if found.count() <= BROADCAST_BANDS else found
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.lit(float(slack)) / F.greatest("n_tokens", F.lit(1))

    def inside(b: Column) -> Column:
        return F.forall(F.zip_with("measures", b, lambda m, x: (m + share * F.greatest(m, F.lit(1)) >= x.low) & (m - share * F.greatest(m, F.lit(1)) <= x.high)), lambda x: x)

    fine = F.coalesce(inside(F.col("bands")), inside(fixed_bands(len(paths))))
    return rows.join(side, ["lang", "length"], "left").select("doc_id", *COLUMNS, failed.alias("base_failed"), (~failed & fine).alias("kept"), "lang", "measures", "row_key")
