"""Texts longer than a packed chunk, and the mix against a plain version of its draw."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from folium.llm import bwt, debruijn, mixing, prefixtree
from folium.llm import runtime as R


@pytest.fixture(scope="module")
def long_texts():
    """A text of more than a chunk, one that quotes its last part, and a near copy of it."""
    rng = np.random.default_rng(8)
    words = [f"w{x:x}" for x in rng.integers(0, 1 << 44, 800_000)]
    near = list(words)
    for at in rng.integers(0, len(words), 2000):
        near[at] = "changed"
    quote = words[-5000:-4900]
    texts = [" ".join(words), "before these words " + " ".join(quote) + " after those", " ".join(near)]
    assert len(texts[0]) > R.CHUNK_BYTES
    return list(enumerate(texts)), words, near, quote


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)


def test_substrings_of_long_texts(spark, long_texts):
    pairs, words, near, quote = long_texts
    got = {r.doc_id: r for r in debruijn.digest_repeats(frame(spark, pairs)).collect()}
    assert (got[0].n_words, got[0].n_removed) == (800_000, 0) and got[0].kept_sha256 == brute.sha(pairs[0][1].encode())
    assert (got[1].n_removed, got[1].kept_sha256) == (100, brute.sha(b"before these words after those"))
    same = np.array([a == b for a, b in zip(words, near, strict=True)])
    cut = np.flatnonzero(~np.r_[False, same, False])
    gone = sum(n for n in np.diff(cut) - 1 if n >= 13)
    assert got[2].n_removed == gone > 700_000


def test_bytes_of_long_texts(spark, long_texts):
    pairs, _, _, quote = long_texts
    got = {r.doc_id: r for r in bwt.digest_repeats(frame(spark, pairs[:2])).collect()}
    common = len(f" {' '.join(quote)} ".encode())
    for i, text in pairs[:2]:
        at = text.encode().find(f" {' '.join(quote)} ".encode())
        rest = text.encode()[:at] + text.encode()[at + common :]
        # what stands beside the quote may agree by chance
        assert (got[i].n_bytes, got[i].n_spans) == (len(text.encode()), 1) and common <= got[i].n_removed <= common + 4
        assert got[i].n_removed > common or got[i].kept_sha256 == brute.sha(rest)


def test_near_copies_of_long_texts(spark, long_texts):
    pairs, _, _, _ = long_texts
    got = {r.doc_id: r for r in prefixtree.jaccard_components(frame(spark, pairs)).collect()}
    assert {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 0}
    assert got[0].n_shingles == 800_000 - 3


def plain_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Raises the common level source by source, instead of cutting what lies above it."""
    w = [Fraction(weights[i % 3]) for i in range(len(sizes))]
    pool, out = share * sum(sizes), {}
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / w[i]):
        level = pool / sum(w[j] for j in range(len(sizes)) if j not in out)
        out[i] = min(most * sizes[i], level * w[i])
        pool -= out[i]
    return [out[i] for i in range(len(sizes))]


def test_targets_are_the_plain_ones():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 7, 100, 5000]) for _ in range(rng.randrange(1, 9))]
        assert mixing.targets(sizes) == pytest.approx([float(x) for x in plain_targets(sizes)])


def test_mix_is_the_plain_draw(spark):
    """Whole passes, and one over the blocks in order up to the document at which the target lies."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sized = df.withColumn("size", F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long"))
    docs = sized.withColumn("key", F.xxhash64("doc_id", "size", F.lit(0))).select("doc_id", "source", "size", "key").collect()
    names = sorted({r.source for r in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r.size for r in docs if r.source == s) for s in names}
    want = {}
    for s, target in zip(names, plain_targets([total[s] for s in names]), strict=True):
        own, passes = [r for r in docs if r.source == s and r.size], int(target // total[s])
        blocks = max(64, -(-total[s] // 300))
        left, taken = float(target) - passes * total[s], set()
        for block in range(blocks):
            inside = sorted((r for r in own if r.key % blocks == block), key=lambda r: (r.key, r.doc_id))
            run = np.cumsum([r.size for r in inside])
            if left <= 0:
                break
            if sum(r.size for r in inside) < left:
                taken |= {r.doc_id for r in inside}
                left -= sum(r.size for r in inside)
            else:
                taken |= {r.doc_id for r, n in zip(inside, run, strict=True) if n - r.size / 2 <= left}
                break
        want |= {r.doc_id: r.size * (passes + (r.doc_id in taken)) for r in own}
    got = {r.doc_id: r.taken for r in mixing.taken_words(df, block_words=300).collect()}
    assert got == {i: want.get(i, 0) for i, *_ in rows}
