"""Operator 13: URL filters, by rules and by logistic regression on hashed character n-grams. Native.

1. *Rules* are (host, path, verdict). A rule fits its host and all subdomains, if the url's path starts with
   the rule's; of several the longest host and path wins, of two as long that with the longer host, of two
   equal ones a block. Few rules are one literal, looked up row by row without a shuffle; more of them are
   joined to the distinct hosts of the urls, over the ends of each host, so that the urls themselves never
   move by a host that a third of them may have.
2. *The model* judges what no rule does. Features of a url are the distinct n-grams of ^host$ and of the path
   with numbers as 0, hashed into DIM buckets and scaled to unit length. Full-batch gradient steps, scaled by
   each weight's own gradients so far, are DataFrame sums; the driver holds DIM + 1 numbers, whatever the
   number of labelled rows. A table of labels below STEP_ROWS rows is one partition and needs no shuffle.
3. Scoring is one expression over literal weights: a scan of the url column and no shuffle.

Everything is DataFrame functions: no Python runs on executors.

Defined results: a null url, or one without ://, has an empty host and path, meets no rule, and the model gives it
the score of no features. Case is folded for A-Z only. Repeated rows give repeated results, null ids stay.
Labelled rows with a null label or url train nothing, equal ones count as often as they come; with none all
scores are 0.5, which is a block. Rules with a null or empty host fit nothing, a null path is empty. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from . import runtime as R

DIM, SIZES, STEPS, RATE, DECAY = 8192, (3, 4, 5), 12, 0.7, 1e-4
#: Rows of labels in one partition; rules that are one literal; bytes of hosts with their rules that are broadcast; rules of one host.
STEP_ROWS, INLINE_RULES, BROADCAST_BYTES, HOST_RULES = 65_536, 256, 8 << 20, 65_536

#: The rules of the query, and the words, endings and paths that its labelled urls are made of (fixed values).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
BLOCKED = (
    "adult ads adserver adware bet bets betting bingo bitcoin bonus bride cam cams cash casino cheap cialis click clicks clone coin coupon crack "
    "cracked credit date dating deal diet drug dump erotic escort fake farm flirt forex free gamble gambling girls hack hentai hookup jackpot keygen "
    "kiss levitra lingerie loan loans lottery lotto malware meds milf millionaire money naked nude offer payday pharmacy phish pills pirate poker "
    "popup porn prize replica roulette scam serial sex sexy slots spam spyware steroid stream swinger teen torrent track tracker traffic viagra "
    "virus warez webcam weight win winner xxx"
).split()
ALLOWED = (
    "academy agency air archive art atlas author bank bible bike bird board book books bridge bureau cafe camp care castle center chess choir church "
    "city civic class clinic club coast code coffee college council county court craft culture dance data design doc docs earth edit engine europe "
    "events family farmer field film fire fish forest forum foundation garden gazette geo glass global gov green group guide harbor health herald "
    "history home hotel house idea info institute island journal kids kitchen lab labs lake language law learn letter library life line local "
    "magazine mail map market math media medical meeting metal mill mind mountain museum music nation nature net news north note observatory ocean "
    "office open opera orchestra paper park people photo physics planet play poem post press project public radio rail research review river road "
    "school science sea service shop society software song south space sport state stone story street student studio sun system teach tech theatre "
    "thought time tion town trade travel tree trust union university valley video village voice wall water weather web west wiki wind wood word work "
    "world write"
).split()
ENDINGS, PREFIXES, PATHS = ["example.com", "example.net", "example.org", "com", "net", "org"], ["", "www.", "blog.", "m."], ["/", "/en/1234", "/de/index.html", "/fr/1234/", "/es/1234.html", "/1234"]


def _words(words: Iterable[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _at(values: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit("|".join(values)), r"\|"), i % len(values))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label: a small table of urls to block (1) and to allow (0), four for each word of either list."""

    def of(words: list[str], label: int) -> DataFrame:
        i, k, w = F.col("i"), F.col("k"), F.col("w")
        rows = spark.range(0, 1, 1, 1).select(F.posexplode(_words(words)).alias("i", "w")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        other = _at(words, i * 7 + k * 13 + 5)
        name = F.when(k == 0, w).when(k == 1, F.concat_ws("-", w, other)).when(k == 2, F.concat(other, w)).otherwise(F.concat_ws("-", w, _at(ALLOWED, i * 3 + k)))
        return rows.select(F.concat(F.lit("https://"), _at(PREFIXES, i + k), name, F.lit("."), _at(ENDINGS, i + k * 2), _at(PATHS, i * 5 + k)).alias("url"), F.lit(label).alias("label"))

    return of(BLOCKED, 1).unionByName(of(ALLOWED, 0))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ://, up to a slash, question mark or hash, in lower case; and the path from there."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, F.lit("://"))
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(kind: str, text: Column) -> Column:
    """All n-grams of text, with their kind before them. The text is split once, so this takes linear time."""

    def of(c: Column) -> Column:
        of_size = lambda n: F.transform(c, lambda _, i: F.when(i + n <= F.size(c), F.concat(F.lit(kind), *(F.get(c, i + k) for k in range(n)))))
        return F.array_compact(F.concat(*map(of_size, SIZES)))

    return let(F.filter(F.split(text, ""), lambda x: x != ""), of)


def features(host: Column, path: Column, dim: int = DIM) -> Column:
    """The distinct buckets of a url's n-grams."""
    grams = F.concat(_grams("h", F.when(host == "", "").otherwise(F.concat(F.lit("^"), host, F.lit("$")))), _grams("p", F.regexp_replace(path, "[0-9]+", "0")))
    return F.array_distinct(F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 6), 16, 10).cast("int") % dim)))


def _literal(values: list[float]) -> Column:
    """A constant array, which the optimizer folds from one string."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def probability(x: Column, weights: list[float]) -> Column:
    """The model's score of features x; the last weight is the bias."""
    w = _literal(weights)
    total = F.aggregate(x, F.lit(0.0), lambda a, f: a + F.get(w, f))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")) + weights[-1])))


def trained(labels: DataFrame, *, dim: int = DIM, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """dim weights and the bias, of labels (url, label 0 or 1)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = labels.where("url is not null and label is not null").select(features(host, path, dim).alias("x"), F.col("label").cast("double").alias("y"))
    n = rows.count()
    weights, squares = [0.0] * (dim + 1), [0.0] * (dim + 1)
    if not n:
        return weights
    parts = -(-n // STEP_ROWS)
    rows = R.checkpointed(rows.coalesce(1) if parts == 1 else rows.repartition(parts, "x"))
    for _ in range(steps):
        scale = 1 / F.sqrt(F.greatest(F.size("x"), F.lit(1)).cast("double"))
        missed = rows.select("x", (F.col("y") - probability(F.col("x"), weights)).alias("e"), scale.alias("s"))
        each = missed.select(F.explode(F.array_append("x", F.lit(dim))).alias("f"), "e", "s").select("f", F.when(F.col("f") == dim, F.col("e")).otherwise(F.col("e") * F.col("s")).alias("g"))
        for f, g in each.groupBy("f").agg(F.sum("g")).collect():  # at most dim + 1 rows
            g = g / n - decay * weights[f]
            squares[f] += g * g
            weights[f] += rate * g / math.sqrt(squares[f] + 1e-12)
    return weights


def _fits(host: Column, r: Column, path: Column) -> Column:
    return ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path)


def _ordered(rules: DataFrame) -> DataFrame:
    """rules with what sorts the one that wins first."""
    r = rules.select(F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")).where("host <> '' and verdict is not null")
    return r.select(F.struct((-F.length(F.concat("host", "path"))).alias("length"), (-F.length("host")).alias("host_length"), (F.col("verdict") != "block").alias("allows"), "host", "path", "verdict").alias("r"))


def with_rules(urls: DataFrame, rules: DataFrame, *, inline: int = INLINE_RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """urls (host, path, ...) with `matched`: the rule (host, path, verdict, ...) that wins, or null."""
    rules = _ordered(rules)
    few = rules.limit(inline + 1).collect()
    if not few:
        return urls.withColumn("matched", F.lit(None).cast(rules.schema["r"].dataType))
    if len(few) <= inline:
        every = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in x.r.asDict().items())) for x in sorted(few)))
        return urls.withColumn("matched", F.get(F.filter(every, lambda r: _fits(F.col("host"), r, F.col("path"))), F.lit(0)))
    longest = rules.agg(F.max(F.length("r.host"))).first()[0]
    tail = F.split(F.right(F.col("host"), F.lit(longest + 1)), r"\.")
    ends = let(tail, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    hosts = urls.select("host").distinct().select(F.col("host").alias("_host"), F.explode(F.array_distinct(F.array_append(ends, F.col("host")))).alias("_end"))
    found = hosts.join(rules, (F.col("_end") == F.col("r.host")) & ((F.col("_end") == F.col("_host")) | F.endswith("_host", F.concat(F.lit("."), F.col("_end")))))
    found = R.checkpointed(found.groupBy("_host").agg(F.sort_array(F.collect_set("r")).alias("_rules")))
    most, size = found.agg(F.max(F.size("_rules")), F.sum(F.length("_host") + F.aggregate("_rules", F.lit(0), lambda a, r: a + 40 + F.length(r.path)))).first()
    if (most or 0) > HOST_RULES:
        raise ValueError(f"{most} rules fit one host; {HOST_RULES} can")
    out = urls.join(F.broadcast(found) if (size or 0) <= broadcast_bytes else found, F.col("host") == F.col("_host"), "left")
    return out.withColumn("matched", F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r.path)), F.lit(0))).drop("_host", "_rules")


def judged(pages: DataFrame, rules: DataFrame, labels: DataFrame, *, inline: int = INLINE_RULES, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of pages (page_id, url); score is null where a rule decides."""
    weights = trained(labels, **options)
    host, path = host_and_path(F.col("url").cast("string"))
    urls = with_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules, inline=inline, broadcast_bytes=broadcast_bytes)
    score = F.when(F.col("matched").isNull(), probability(features(F.col("host"), F.col("path"), len(weights) - 1), weights))
    out = urls.withColumn("score", score)
    verdict = F.coalesce(F.col("matched.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.concat("matched.host", "matched.path").alias("rule"), verdict.alias("verdict"), "score")
