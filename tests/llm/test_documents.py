"""Operators 4, 5, 8 and 9, and the pipeline, against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline
from folium.llm import bpe, fertility, mixing, pretokens, rff
from folium.llm import runtime as R

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARIES = tuple(map(public_tokenizers.path, fertility.VOCABULARIES))


def key(x):
    return sorted(x, key=lambda r: (r[0] is None, r))


def test_pretokens():
    import pyarrow as pa
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "\t", "\xa0", "é", "日本", "1", "²", "!", "_", "\0", "Ab", "\x1c", "'s", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    data, off = R.flat_utf8(pa.array(texts))
    places, ptr = pretokens.pretokens(data, off)
    words = [w.decode() for w in pretokens.as_array(data, places).to_pylist()]
    for i, t in enumerate(texts):
        assert words[ptr[i] : ptr[i + 1]] == pattern.findall(t)


def test_bpe(docs, documents):
    encoder = bpe.vocabulary(RANKS)[0]
    want = []
    for i, t in documents:
        ids = encoder.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert key(map(tuple, bpe.digest_documents(docs, RANKS).collect())) == key(want)


def test_bpe_round_trip(docs, documents):
    encoded = bpe.encode_documents(docs, RANKS)
    back = bpe.decode_documents(encoded, RANKS).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in documents)


def test_fertility_base_measures(spark, documents):
    df = spark.createDataFrame([(i, t, None if n % 3 else "en") for n, (i, t) in enumerate(documents)], "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.judged(df, VOCABULARIES).collect())
    want = Counter()
    for i, t in documents:
        w, lines = brute.WORD.findall(t or ""), (t or "").split("\n")
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {j + o for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for o in range(5)}
        dup = sum(bool(brute.WORD.search(x)) and x in lines[:j] for j, x in enumerate(lines))
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)] += 1
    assert got == want


def test_fertility_bands(spark):
    rng = random.Random(2)
    words = "the of and people water history because between language government children number".split()
    rows = [(i, " ".join(rng.choice(words) + str(rng.randint(0, 99)) * (rng.random() < 0.1) for _ in range(120)), "en") for i in range(120)]
    rows += [(1000 + i, " ".join("".join(rng.choice("#%&*$|") for _ in range(6)) for _ in range(120)), "en") for i in range(4)]
    got = {r.doc_id: r.kept for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARIES).collect()}
    assert not any(got[1000 + i] for i in range(4)) and sum(got[i] for i in range(120)) >= 114


def prose(rng, n):
    return " ".join(rng.choice("the of and people water history because between language government children number".split()) + str(rng.randint(0, 99)) * (rng.random() < 0.1) for _ in range(n))


def noise(rng, n):
    return " ".join("".join(rng.choice("#%&*$|") for _ in range(6)) for _ in range(n))


def kept(spark, rows):
    return {r.doc_id: r.kept for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), VOCABULARIES).collect()}


def test_fertility_judges_small_groups(spark):
    """Noise of a rare length, in a small table and in a rare language."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 120), "en") for i in range(80)] + [(100, noise(rng, 120), "xx"), (101, noise(rng, 500), "en"), (102, noise(rng, 40), None), (103, prose(rng, 180), "en"), (104, prose(rng, 90), "en")]
    got = kept(spark, rows)
    assert not got[100] and not got[101] and not got[102] and got[103] and got[104]
    few = kept(spark, [(i, "".join(rng.choice("abcdefghi ") for _ in range(700)), "en") for i in range(3)] + [(9, noise(rng, 120), "en"), (10, "Rivers carry water, sand and small stones from the mountains down to the sea. In spring, when the snow melts, they rise above their banks; in late summer some of them nearly run dry. People who live beside them have always watched the level closely, because fields, mills and boats depend upon it.", "en")])
    assert not few[9] and few[10]


@pytest.mark.parametrize("copied", [prose, noise])
def test_fertility_of_many_copies(spark, copied):
    """Many copies of a text, clean or junk, don't make the band of their length."""
    rng = random.Random(6)
    rows = [(i, prose(rng, n), "en") for i, n in enumerate([120] * 60 + [60] * 60 + [240] * 60)]
    text = copied(rng, 120)
    got = kept(spark, rows + [(1000 + i, text, "en") for i in range(400)])
    assert sum(got[i] for i in range(180)) >= 171 and all(got[1000 + i] == (copied is prose) for i in range(400))


def test_fertility_width_floor():
    """Near copies in one length: its band is as wide as is usual in the language."""
    rng = np.random.default_rng(1)
    length, value = np.repeat([14, 15, 16], 400), rng.normal(2.0, 0.05, 1200)
    value[400:700] = 2.0
    bands = {x: (low, high) for x, low, high in fertility.key_bands(length, value, np.ones(1200, np.int64), 0.0, 2.25, 32)}
    assert np.mean((value[700:800] >= bands[15][0]) & (value[700:800] <= bands[15][1])) > 0.97


def test_measures_by_hand():
    codes, ptr = np.array([0, 1, 0, 2]), np.array([0, 3, 3, 4])
    size, flat, odd = np.array([1, 2, 2]), np.array([5, 6, 7, 5, 5]), np.zeros(9, bool)
    odd[7] = True
    n, fertile, fallback, even = fertility.measures(codes, ptr, size, flat, odd, np.array([12, 0, 3]))
    assert n.tolist() == [4, 0, 2] and fertile.tolist() == [3, 0, 1.5] and fallback.tolist() == [0.25, 0, 0]
    assert even[0] == pytest.approx((0.5 * 1 + 2 * 0.25 * 2) / 2) and even[2] == 0


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 50 else None, [None, "b", "a", "é", "z", ""][rng.choice([0, 1, 2, 2, 2, 2, 3, 4, 5])]) for i in range(1500)]
    return spark.createDataFrame([*rows, rows[7], rows[7]], "doc_id long, text string, source string"), [*rows, rows[7], rows[7]]


def test_mixing(sources):
    df, rows = sources
    got = mixing.taken_words(df, block_words=500, shard_words=2000).collect()
    again = mixing.taken_words(df.repartition(7), block_words=500, shard_words=2000).collect()
    assert key(map(tuple, got)) == key(map(tuple, again)) and len(got) == len(rows)
    size, source = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    for s, target in zip(names, mixing.targets([total[s] for s in names]), strict=True):
        own = [r for r in got if source[r.doc_id] == s]
        assert all((r.size, r.source_size, r.target) == (size[r.doc_id], total[s], target) and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 60


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 1000, 10]) == [20.0, pytest.approx(1490), 20.0] and mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


def test_splitting_tree_is_a_partition():
    quotas = np.array([100, 3, 0, 57])
    parts = [mixing.leaf(quotas, 7, i, seed=3) for i in range(7)]
    assert all(abs(int((b - a).sum()) - 160 / 7) <= 2 for a, b in parts)
    for s in range(4):
        assert sorted(x for a, b in parts for x in range(a[s], b[s])) == list(range(quotas[s]))


def test_mixed_shards(sources):
    df, _ = sources
    rows = mixing.mixed(df, block_words=500, shard_words=5000).collect()
    drawn = mixing.drawn(df, block_words=500, shard_words=5000).select("doc_id", F.size("draws").alias("n")).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in Counter({r.doc_id: 0 for r in drawn}).items()} | {i: sum(r.n for r in drawn if r.doc_id == i) for i in {r.doc_id for r in drawn if r.n}}) - Counter()


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "river", "slowly", "old", "house", "walked"]) + ("" if good else rng.choice(["%%%", "$$", "|"])) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "the river")], "doc_id long, text string")
    got = {r.doc_id: r for r in rff.quality_scores(df, spark.createDataFrame([*labels, (1, None)], "doc_id long, quality int")).collect()}
    import zlib

    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) >= len(held) and not got[None].held_out
    assert np.mean([got[i].predicted == q for i, q in held]) > 0.97


def test_rising():
    x, y = rff.rising(np.arange(5.0), np.array([0.0, 0.5, 0.25, 0.25, 1.0]), np.ones(5))
    assert y.tolist() == [0.0, pytest.approx(1 / 3), 1.0] and all(np.diff(y) > 0)


def test_statistics_are_finite():
    import pyarrow as pa

    x = rff.statistics(*R.flat_utf8(pa.array(["", "a b a b\na b", "%%% | é", "\n\n", None, "x" * 5000])))
    assert x.shape == (6, len(rff.FEATURES)) and np.isfinite(x).all() and math.isclose(x[1][9], 1 - 2 / 6)


class Words:
    """An encoder for the plain version: a word's tokens, and whether each is whole characters."""

    def __init__(self, path):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = sp.vocab_size()
            self.of = lambda w: [(i, not sp.is_byte(i) and not sp.is_unknown(i)) for i in sp.encode(w)]
        else:
            encoder = bpe.vocabulary(path)[0]
            self.size = encoder.n_vocab

            def of(w):
                parts = [(i, encoder.decode_single_token_bytes(i)) for i in encoder.encode_ordinary(" " + w)]
                return [(i, b.decode(errors="replace").encode() == b) for i, b in parts]

            self.of = of

    def __call__(self, word):
        return self.of(word)


def test_fertility_against_a_plain_version(spark):
    """The verdict of every length, short and rare ones too, with copies, noise, rare characters and repeated ids."""
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.choice([10, 11, 14, 25, 60, 120, 130, 400])) + rng.choice(["", "", " é", " 日本", " \U0001f600"]), rng.choice(["en", "xx"])) for i in range(150)]
    rows += [(200 + i, noise(rng, rng.choice([10, 30, 120])), "en") for i in range(6)] + [(300 + i, rows[0][1], "en") for i in range(20)] + [(0, noise(rng, 50), "en"), (400, "of of of of of of of of of of of of", "en"), (401, "", "en"), (402, None, "xx"), (403, prose(rng, 4000), "xx")]
    got = sorted((r.doc_id, r.kept) for r in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), VOCABULARIES).collect())
    want = sorted(brute.op4(rows, list(map(Words, VOCABULARIES))))
    assert got == want
    assert sum(k for _, k in want) > 150 and not any(k for i, k in want if i in (201, 202, 204))  # noise of 30 and 120 words


def test_quality_against_a_plain_version(spark):
    import pyarrow as pa

    rng = random.Random(10)
    texts = [" ".join(rng.choice(["the", "river", "%%%", "walked", "|", "of"]) for _ in range(rng.randint(1, 60))) for _ in range(260)] + ["", None, "long " * 40_000]
    docs = [(i % 257, t) for i, t in enumerate(texts)]  # the last ids are repeated
    labels = [(i, int("%%%" not in (texts[i] or "")) if rng.random() < 0.9 else rng.randint(0, 1)) for i in range(0, 257, 2)] + [(4, 1), (6, None)]
    got = rff.quality_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), d=24).collect()
    import zlib

    x, y, own = [], [], []
    for i, t in docs:
        s = rff.statistics(*R.flat_utf8(pa.array([t], pa.string())))[0]
        known = [q for j, q in labels if j == i and q is not None and zlib.crc32(str(i).encode()) % 3 != 1]
        for q in [None, *known]:
            x.append(s)
            y.append(q)
            own.append((i, t))
    model = rff.Model(np.zeros(len(rff.FEATURES)), np.ones(len(rff.FEATURES)), 24, rff.GAMMA, rff.SEED)
    score = brute.op9(np.array(x), y, model, 24, rff.RIDGE, rff.BINS)
    want = sorted((i, round(float(v), 5)) for (i, _), v, q in zip(own, score, y, strict=True) if q is None)
    assert sorted((r.doc_id, round(r.score, 5)) for r in got) == want


def test_quality_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None)], [(99, 1)]):
        rows = rff.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 3


def test_mixing_deals_by_the_tree(spark):
    """Draws lie in the shards to which the tree deals their blocks: disjoint, of nearly equal length, several even for small mixes."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 9), f"s{i % 3}") for i in range(3000)] + [(9000, "w " * 50_000, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(df).collect()
    assert all(r.taken == r.size * len(r.shards) for r in got)
    shards = Counter()
    for r in got:
        for s in r.shards:
            shards[s] += r.size if r.doc_id != 9000 else 0
    assert len(shards) == mixing.LEAST_SHARDS and max(shards.values()) < 2 * min(shards.values())
    assert any(len(set(r.shards)) == 2 for r in got)
    by_block = {}
    for r in mixing.mixed(df).collect():
        by_block.setdefault((r.doc_id, r.epoch), []).append(r.shard)
    assert all(len(x) == 1 for x in by_block.values())


def test_clashing_columns_and_long_texts(spark):
    """Columns beyond those read, named as the operators' own, change nothing; nor do they crash on a very long text."""
    rng = random.Random(1)
    rows = [(i, prose(rng, 30), "en", f"s{i % 2}") for i in range(60)] + [(70, prose(rng, 120_000), "en", "s0"), (71, None, None, None), (71, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = "size key block rest draws sid name target whole words epoch shard length bands measures row_key text_hash n_tokens i low high x y score held_out raw part sums chunk bucket payload blob id component link n_shingles other blocks own".split()
    more = df.select("*", *(F.lit("clash").alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2, "clash", "clash") for i in range(60)], "doc_id long, quality int, text string, x string")
    for f in (lambda d: fertility.judged(d, VOCABULARIES), mixing.taken_words, lambda d: rff.quality_scores(d, labels), lambda d: bpe.digest_documents(d, RANKS)):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(more).collect())) and f(df).count() == len(rows)


def test_empty(spark, no_docs):
    df = no_docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (bpe.digest_documents(df, RANKS), fertility.judged(df, VOCABULARIES), mixing.taken_words(df), rff.quality_scores(df, labels)):
        assert out.collect() == []


def test_pipeline(spark, tmp_path):
    """Every stage against plain versions of it, on documents with copies, noise and shared passages."""
    rng = random.Random(1)
    words = [rng.choice("bcdfgkmnprst") + rng.choice("aeiou") + rng.choice(["ka", "lo", "mi", "nu"]) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = make(60)
    rows = [(i, make(rng.randint(40, 160)), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[i][1] + " extra", "en", "s1") for i in range(10)] + [(200 + i, make(30) + "\n" + passage + "\n" + make(30), "en", "s2") for i in range(8)]
    rows += [(300, "too short", "en", "s0"), (301, None, "en", "s0"), (302, "again and again " * 30, "en", None), (3, rows[3][1], "en", "s3")]
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = [(r.doc_id, r.text) for r in out.collect()] if name != "encode" else out.collect()
        if name != "encode":
            assert out.columns == df.columns
        if name == "quality":
            assert {300, 301, 302} & {i for i, _ in after} == set() and len(after) == len(before) - 3
        elif name == "near_duplicates":
            low = dict(brute_components(before))
            assert sorted(i for i, _ in after) == sorted({low[i] for i, _ in before})
        elif name == "substrings":
            want = {i: (n, gone, digest) for i, n, gone, digest in brute.op3(before)}
            for i, t in after:
                n, gone, digest = want[i]
                assert t == dict(before)[i] if not gone else brute.sha(t.encode()) == digest
            assert {i for i, _ in after} == {i for i, (n, gone, _) in want.items() if gone < n or not n}
        elif name == "mix":
            assert Counter(i for i, _ in after) == Counter({r.doc_id: r.taken // r.size for r in mixing.taken_words(docs).collect() if r.taken})
        else:
            assert Counter(r.decoded_sha256 for r in after) == Counter(brute.sha(t.encode()) for _, t in before)
        docs = out


def test_pipeline_near_duplicates(spark):
    """Copies with about a fifth appended, on both sides of the threshold."""
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))
    rows = [(i, make(100)) for i in range(30)]
    rows += [(100 + i, f"{t} {make(12 + i // 2)}") for i, t in rows] + [(200, "one Two three"), (201, "one two three"), (202, rows[0][1].replace(" ", "\n"))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    low = {i: x for i, _, x in brute.op7(rows, percent=80, k=5)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == sorted(set(low.values()))
    assert set(low.values()) < {x for _, _, x in brute.op7(rows)}


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    """An empty table, columns beyond those of documents, and rows that share or lack a doc_id: each row has its own verdict."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key string, kept string, first_id string"
    rng = random.Random(5)
    good = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t), "c", "c", "c") for i, t in enumerate(good)]
    odd = [(0, noise(rng, 60), "en", "s", 1, "c", "c", "c"), (None, noise(rng, 60), "en", "s", 1, "c", "c", "c"), (None, good[1] + " more", "en", "s", 1, "c", "c", "c")]
    for n, every in enumerate(([], rows + odd)):
        docs = spark.createDataFrame(every, shape)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.write.parquet(str(tmp_path / f"{n}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}{name}"))
            if name == "quality":
                assert Counter(r.text for r in docs.collect()) == Counter(r[1] for r in every if "#" not in r[1] and "%" not in r[1])
            if name != "encode":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert bool(docs.count()) == bool(every)


def brute_components(pairs):
    """Near duplicates as the stage takes them: five words, 80 %."""
    return [(i, low) for i, _, low in brute.op7(pairs, percent=80, k=5)]
