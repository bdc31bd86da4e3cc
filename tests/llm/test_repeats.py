"""Operators 3, 6 and 7 against brute force."""

import numpy as np
import pytest
from tests.llm import brute

from folium.llm import bwt, debruijn, prefixtree


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r))


def key(x):
    return sorted(x, key=lambda r: (r[0] is None, r))


def test_debruijn(docs, documents):
    assert rows(debruijn.digest_repeats(docs).drop("text")) == key(brute.op3(documents))


def test_texts_left(docs):
    for r in debruijn.digest_repeats(docs).collect():
        assert brute.sha(r.text.encode()) == r.kept_sha256 and len(r.text.split()) == r.n_words - r.n_removed
    for r in bwt.digest_repeats(docs).collect():
        whole = len(r.text.encode()) == r.n_bytes - r.n_removed
        assert brute.sha(r.text.encode()) == r.kept_sha256 if whole else len(r.text.encode()) >= r.n_bytes - r.n_removed - 6 * r.n_spans


def test_debruijn_adjacent_copies(spark):
    """Short copies next to each other in one chunk, and passages that end one document and open the next."""
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    texts = [t for n in range(13, 23) for t in [make(n)] * (2 + n % 2)]
    for n in range(13, 23):
        passage = make(n)
        texts += [f"{make(30)} {passage}", f"{passage} {make(30)}"]
    pairs = list(enumerate(texts))
    want = key(brute.op3(pairs))
    assert sum(r[2] > 0 for r in want) == 25
    assert rows(debruijn.digest_repeats(spark.createDataFrame(pairs, "doc_id long, text string").coalesce(1)).drop("text")) == want


def test_debruijn_spans(docs, documents):
    import re

    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in documents}
    for r in debruijn.remove_repeats(docs.where("doc_id is not null")).collect():
        gone = set()
        for s in r.spans:
            n = s.stop - s.start
            assert n >= 13 and s.source_doc_id < r.doc_id
            assert words[r.doc_id][s.start : s.stop] == words[s.source_doc_id][s.source_start : s.source_start + n]
            gone.update(range(s.start, s.stop))
        assert len(gone) == r.n_removed
        assert r.kept == " ".join(w for i, w in enumerate(words[r.doc_id]) if i not in gone)


def test_debruijn_paths_and_verification():
    """A path ends where either side branches; a span of other words than its source's falls away."""
    import pyarrow as pa

    from folium.llm import runtime as R

    a, b = debruijn.paths(np.array([4, 5, 6, 9, 10, 11, 12]), np.array([1, 1, 1, 1, 1, 2, 2]), np.array([70, 71, 72, 73, 80, 81, 82]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 2), (3, 3), (4, 4), (5, 6)]
    text = b"q w e r t"
    chunk = pa.table({"chunk": [5], "payload": [R.squeeze((np.array([7]), np.array([0, len(text)]), text))]})
    planes = lambda *x: R.byte_planes(np.array(x), 5)
    asked = R.squeeze((planes(10, 20), planes(2, 2), planes(1, 1), debruijn.digest([b"w", b"e"]) + debruijn.digest([b"w", b"x"])))
    out = debruijn.verify(chunk, pa.table({"bucket": [5], "chunk": [3], "blob": [asked]}))
    start, size, source, place = (R.from_planes(x).tolist() for x in R.unsqueeze(out["blob"][0].as_py()))
    assert (out["chunk"].to_pylist(), start, size, source, place) == ([3], [10], [2], [7], [1])


def test_bwt(docs, documents):
    assert rows(bwt.digest_repeats(docs).drop("text")) == key(brute.op6(documents))


def test_bwt_overlapping_repeats(spark):
    """Periodic stretches of 390 to 850 bytes, each alone in its document and of its own pattern."""
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    units = ["a", "=", "| --- ", "to and fro. ", *(noise(n) for n in (2, 3, 7, 20, 31, 33, 64, 100, 199, 200, 201, 300, 368, 369, 370, 399, 400, 401))]
    texts = [noise(int(rng.integers(0, 600))) + (u * 850)[:n] + noise(int(rng.integers(0, 600))) for u, n in zip(units, [500, 450, 600, 401, *rng.integers(390, 851, len(units)).tolist()], strict=False)]
    texts += [noise(300) + (u * 850)[:n] + noise(300) for k in range(1, 400, 9) for u, n in [(noise(k), 400 + k), (noise(k), 399 + k)]]
    pairs = list(enumerate(texts))
    want = key(brute.op6(pairs))
    assert sum(r[2] > 0 for r in want) > 50
    assert rows(bwt.digest_repeats(spark.createDataFrame(pairs, "doc_id long, text string").coalesce(1)).drop("text")) == want


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows(seed):
    rng = np.random.default_rng(seed)
    n, length = 12, int(rng.integers(bwt.FIRST, 30))
    texts = list(dict.fromkeys(bytes(rng.integers(0, 2 + 100 * (seed % 2), rng.integers(length, 120)).astype(np.uint8)) for _ in range(n)))
    texts.append(texts[0][3:] + texts[1][:-2] + b"!")
    several = rng.random(len(texts)) < 0.2
    count = {}
    for t, s in zip(texts, several, strict=True):
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1 + s
    got = bwt.repeated_windows(texts, several, length)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == [i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]


def test_jaccard(docs, documents):
    assert rows(prefixtree.jaccard_components(docs)) == key(brute.op7(documents))


@pytest.mark.parametrize("group_items", [200, 900])
def test_jaccard_in_blocks(docs, documents, group_items):
    assert rows(prefixtree.jaccard_components(docs, group_items=group_items)) == key(brute.op7(documents))


def test_large_groups_compare_no_connected_parts(spark, monkeypatch):
    """A group of many near copies and a few others: the copies meet their pivots and the others, not each other."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))
    sets = [np.unique(np.r_[np.delete(base, rng.integers(0, len(base), 2)), rng.integers(0, 1 << 63, 1).astype(np.uint64)]) for _ in range(300)]
    sets += [np.unique(np.r_[base[:60], rng.integers(0, 1 << 63, 40).astype(np.uint64)]) for _ in range(6)] + [np.delete(sets[0], slice(0, 12))]
    keys = lambda x: [int(x[0] >> np.uint64(1)), int(prefixtree.R.mix(x ^ prefixtree.SHORT).min() >> np.uint64(1))]
    df = spark.createDataFrame([(i, 0, bytearray(x.tobytes()), keys(x)) for i, x in enumerate(sets)], "id long, component long, items binary, keys array<long>")
    join = prefixtree._join_group
    rows_of = spark.sparkContext.accumulator(0)

    def counted(percent):
        f = join(percent)

        def g(table):
            rows_of.add(table.num_rows)
            return f(table)

        return g

    monkeypatch.setattr(prefixtree, "_join_group", counted)
    got = {r.id: r.component_id for r in prefixtree.large_groups(df, 85, 2000).collect()}
    low = prefixtree.linked(list(range(len(sets))), sets, 85)
    assert got == {i: c for i, c in enumerate(low) if c != i} and len(set(low)) == 7
    assert rows_of.value < 5 * len(sets)  # all pairs of 16 blocks would take each set 16 times


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_prefixes_meet(percent):
    """Chains of prefixes, cut in chunks and thinned, connect any two sets that link, and the tree finds their link."""
    rng = np.random.default_rng(percent)
    sets, passage = [], rng.integers(0, 1 << 63, 30).astype(np.uint64)
    for n in [*range(1, 40), 60, 90, 150, 400]:
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for _ in range(4):
            t = s[rng.random(len(s)) > rng.random() * 0.2]
            sets += [s, np.unique(np.r_[t, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64), passage[: rng.integers(0, 30) * (rng.random() < 0.3)]])]
    sets = [s for s in sets if len(s)]
    size, own, flat = np.array([len(s) for s in sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    sent = prefixtree.prefixes(flat, prefixtree.rarity(count)[at], own, size, percent)
    key, doc, links = flat[sent], own[sent], []
    some = []
    for chunk in range(3):
        x = np.flatnonzero(doc % 3 == chunk)
        links.append(prefixtree.chains(key[x], size[doc[x]], doc[x], percent))
        some.append(x[prefixtree.thinned(key[x], size[doc[x]], percent)])
    some = np.concatenate(some)
    links.append(prefixtree.chains(key[some], size[doc[some]], doc[some], percent))
    nodes, label = prefixtree.spanning_labels(*(np.concatenate([x[i] for x in links]) for i in (0, 1)))
    group = dict(zip(nodes.tolist(), label.tolist(), strict=True))
    low = prefixtree.linked(list(range(len(sets))), sets, percent)
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            c = len(np.intersect1d(a, b))
            if 100 * c >= percent * (len(a) + len(b) - c):
                assert group[i] == group[j]
                x, y = sorted((up[i], up[j]))
                up = [x if z == y else z for z in up]
    assert low == up
    assert len(set(group.values())) > 20  # the passage doesn't bring all together


def test_tree_leaves_subtrees():
    """A probe counts the labels of other families of sets, but none below them."""
    rng = np.random.default_rng(2)
    passage, some = np.arange(30), lambda n: np.sort(rng.choice(900, n, replace=False))
    family = lambda f: np.r_[passage, 30 + f * 60 + np.arange(60)]
    sets = [np.r_[family(f), 2000 + f * 4000 + m * 1000 + some(60 + m)] for f in range(20) for m in range(4)]
    tree, counted = prefixtree.PrefixTree(sets, np.ones(100_000, bool)), []
    tree.bits, count = None, tree.counts
    tree.counts = lambda nodes, *x: counted.append(len(nodes)) or count(nodes, *x)
    assert not len(tree.linked(sets[5], 85, np.arange(80), int(np.flatnonzero(tree.order == 5)[0]), 100_000))
    assert counted == [1, 20, 3] and len(tree.label) == 101


def test_empty(no_docs):
    for f in (debruijn.digest_repeats, bwt.digest_repeats, prefixtree.jaccard_components):
        assert f(no_docs).collect() == []
