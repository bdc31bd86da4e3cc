"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folium.llm import audit, merge, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- operator 11


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{doc_id}:{name}".encode()) % 11


def change(value, c):
    return {0: "", 1: f"{value}!", 2: f"{value}?"}.get(c, value)


def both(base, x, y):
    """The merged value, whether it is a clean change, and whether a conflict."""
    if x == base and y == base:
        return base, 0, 0
    if x == y or base in (x, y):
        return (y if x == base else x), 1, 0
    return base, 0, 1


def plain_merge(rows):
    """rows: (doc_id, text, lang, source), one an id."""
    out, added = {}, defaultdict(list)
    for d, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lines, of = text.split("\n"), lambda b, name, d=d: code(b, d, str(name))
        for b, least in (("L", -1), ("R", -2)):
            if of(b, "row") in (3, 4):
                added[least - d].append((lang, source, "!" if of(b, "row") == 3 else "?"))
        sides = {}
        for b in "LR":
            columns = (change(lang, of(b, "lang")), change(source, of(b, "source")))
            codes = [of(b, k) for k in range(len(lines))]
            sides[b] = (columns, [c if c < 3 else None for c in codes], [c if c in (3, 4) else None for c in codes])
        touched = {b: s[0] != (lang, source) or any(x is not None for x in s[1] + s[2]) for b, s in sides.items()}
        gone = {b: of(b, "row") == 0 for b in "LR"}
        if any(gone.values()):
            fight = not all(gone.values()) and touched["R" if gone["L"] else "L"]
            out[d] = (lang, source, text, 0, 0, 1, 0) if fight else (None, None, None, 1, 0, 0, 0)
            continue
        n, columns, kept = [0, 0, 0, 0], [], []
        for base, x, y in zip((lang, source), sides["L"][0], sides["R"][0], strict=True):
            value, clean, conflict = both(base, x, y)
            columns.append(value)
            n[0], n[1] = n[0] + clean, n[1] + conflict
        for k, line in enumerate(lines):
            c, clean, conflict = both(None, sides["L"][1][k], sides["R"][1][k])
            n[0] += clean
            n[2 if 0 in (sides["L"][1][k], sides["R"][1][k]) else 1] += conflict
            if c != 0:
                kept.append(change(line, c))
            c, clean, conflict = both(None, sides["L"][2][k], sides["R"][2][k])
            n[0], n[3] = n[0] + clean, n[3] + conflict
            if c:
                kept.append("!" if c == 3 else "?")
        out[d] = (*columns, "\n".join(kept), *n)
    for d, new in added.items():
        if d in out:
            out[d] = (*out[d][:-1], out[d][-1] + 1)
        else:
            out[d] = (*new[0], 1, 0, 0, 0) if len(set(new)) == 1 else (None, None, None, 0, 0, 0, 1)
    return sorted((d, *r) for d, r in out.items())


SCHEMA = "doc_id long, text string, lang string, source string, b string, l_id long, ids int, version long"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def test_merge_is_the_plain_one(spark):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("ab é?!\r") for _ in range(rng.randrange(4)))
    rows = [(d, "\n".join(line() for _ in range(rng.randrange(1, 9))), rng.choice(["en", "", None]), rng.choice(["s", "", None, "s!"])) for d in range(700)]
    rows += [(1000, None, None, None), (1001, "", "", ""), (1002, "\n", "x", "y"), (1003, "\n".join(map(str, range(20_000))), "en", "long"), (-40, "negative", "en", "s"), (-39, "a\nb", "de", "s")]
    got = sorted(tuple(r) for r in merge.merged_branches(clashing(spark, rows)).collect())
    assert got == plain_merge(rows)
    assert all(any(r[k] for r in got) for k in (4, 5, 6, 7)) and any(r[3] is None for r in got)


def test_merge_of_odd_tables(spark):
    assert merge.merged_branches(clashing(spark, []).limit(0)).collect() == []
    # equal rows are one; of different ones of an id, one is the base for both branches; rows without an id stay as they are
    twice = [(d, f"line {d}\nnext", "en", "s") for d in range(60)]
    assert sorted(map(tuple, merge.merged_branches(clashing(spark, twice * 3)).collect())) == plain_merge(twice)
    got = merge.merged_branches(clashing(spark, [(5, "one", "en", "s"), (5, "two", "en", "s"), (None, "kept", None, "s"), (None, "kept", None, "s")])).collect()
    found = [tuple(r) for r in got if r.doc_id == 5]
    assert found in [[r for r in plain_merge([(5, t, "en", "s")]) if r[0] == 5] for t in ("one", "two")]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, "", "s", "kept", 0, 0, 0, 0)] * 2


def test_merge_takes_tables_that_repeat_whole_lines(spark):
    """A branch may hold the base's lines themselves; several lines may be in one gap, or before the first line."""
    base = merge.base_table(spark.createDataFrame([(1, "a\nb\nc", "en", "s"), (2, "x", "en", "s")], "doc_id long, text string, lang string, source string"))
    schema = "doc_id long, added boolean, version long, lang string, source string, ids array<int>, texts array<string>"
    left = spark.createDataFrame([(1, False, 0, "en", "s", [-1, 0, 1, 1, 2, 4], ["top", "a", "p", "q", None, "C"]), (2, False, 0, "en", "s", [0], ["x"])], schema)
    right = spark.createDataFrame([(1, False, 0, "fr", "s", [0, 1, 4], [None, "p", "c!"]), (2, False, 0, "en", "s", [0], [None])], schema)
    got = {r.doc_id: tuple(r)[1:] for r in merge.merge(base, left, right).collect()}
    assert got == {1: ("fr", "s", "top\na\nc", 3, 1, 0, 1), 2: ("en", "s", "x", 0, 0, 0, 0)}
    assert {r.doc_id: r.text for r in merge.merge(base, left, right.limit(0)).collect()} == {1: "a\nb\nc", 2: None}


# --- operator 12


def plain_audit(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    low = {}
    for d, text, _ in docs:
        if d is not None:
            low[text or ""] = min(d, low.get(text or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = defaultdict(list)
    for d, text, source in docs:
        text = text or ""
        w = WORD.findall(text)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > low[text]}
        rows[source or ""].append(({k for k, v in failed.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out = []
    for part, own in rows.items():
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in own if not r[0] & set(order[:k])]
                removed = [r for r in here if f in r[0]]
                steps.append((part, "".join(order), k + 1, len(here) - len(removed), len(removed), sum(f in r[0] and bool(r[0] & set(order[:k])) for r in own), sum(r[0] == {f} for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed), f))
        total = Counter()
        for s in steps:
            total[s[-1]] += s[4]
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def audited(spark, docs, labels, **options):
    d = spark.createDataFrame([(*r, 1, 2, "x", True) for r in docs], "doc_id long, text string, source string, mask int, n int, part string, quality boolean").repartition(5)
    return sorted(map(tuple, audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options).collect()))


def test_audit_is_the_plain_one(spark, documents, monkeypatch):
    rng = random.Random(5)
    docs = [(d, t, rng.choice(["s", "t", None, ""])) for d, t in documents]
    docs += [(200 + k, rng.choice([" ".join(f"W{i}" for i in range(220)), "copy |", None, "word " * 300]), "s") for k in range(80)]
    docs += [(200, "copy |", "t"), (200, "copy |", "t"), (None, "copy |", "u"), (7, "x" * 2_000_000, "long"), (6, "x" * 2_000_000, "long")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in range(0, 290, 2)] + [(200, 1, 0), (200, 0, 1), (None, 1, 1)]
    want = plain_audit(docs, labels)
    assert audited(spark, docs, labels) == want
    assert audited(spark, docs, labels, chain_bytes=1) == want  # every chain handed on at once
    assert sum(r[4] > 0 for r in want) and {r[0] for r in want} == {"s", "t", "u", "long", ""}


def test_audit_compares_full_texts(spark, monkeypatch):
    """All texts under one fingerprint: chains tell them apart."""
    held = audit.Chains(bytes.__eq__)
    for d, t in [(5, b"a"), (3, b"b"), (2, b"a"), (2, b"a"), (9, b"b")]:
        list(held.put(held.entry(0, t, lambda: 0), d, "", 1))
    assert sorted((e[0], e[2], e[3]) for _, e in held.entries()) == [(b"a", 2, {"": 2}), (b"b", 3, {"": 1})]
    docs = [(d, f"text {d % 7}", "s") for d in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    assert sorted(audit.duplicate_ids(df).collect()) == list(range(7, 100))


def test_audit_of_no_rows_and_own_filters(spark):
    assert audited(spark, [], []) == []
    got = audited(spark, [(1, "a", "s"), (2, "a", "s"), (3, "bb", "s")], [(3, 1, 0)], filters={"x": lambda raw, n, words: n > 1})
    assert got == [("s", "Ex", 1, 2, 1, 0, 1, 0, 0, 2), ("s", "Ex", 2, 1, 1, 0, 1, 1, 0, 2), ("s", "xE", 1, 2, 1, 0, 1, 1, 0, 2), ("s", "xE", 2, 1, 1, 0, 1, 0, 0, 2)]


# --- operator 13


def split_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_features(url):
    host, path = split_url(url)
    texts = [("h", f"^{host}$" if host else ""), ("p", re.sub("[0-9]+", "0", path))]
    return sorted({int(hashlib.md5((k + t[i : i + n]).encode()).hexdigest()[:6], 16) % urls.DIM for k, t in texts for n in (3, 4, 5) for i in range(len(t) - n + 1)})


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith(f".{r[0]}")) and path.startswith(r[1])]
    return max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)


def plain_scores(pages, labels):
    w, q, x = Counter(), Counter(), [(plain_features(u), y) for u, y in labels]
    score = lambda f: 1 / (1 + math.exp(-(sum(w[i] for i in f) / math.sqrt(max(1, len(f))) + w[-1])))
    for _ in range(urls.STEPS):
        g = Counter()
        for f, y in x:
            e = y - score(f)
            g[-1] += e
            for i in f:
                g[i] += e / math.sqrt(len(f))
        for i, v in g.items():
            v = v / len(x) - urls.DECAY * w[i]
            q[i] += v * v
            w[i] += urls.RATE * v / math.sqrt(q[i] + 1e-12)
    return [score(plain_features(u)) for u in pages]


URLS = ["http://Casino-Win.example.com/en/1.html", "https://www.school.example.org/fr/2", "http://a.net", "http://a.net/x?y", "https://net/", "x://EXAMPLE.net/en/#top", "x://example.net/EN/", "ftp://a.b.example.com/de/", "ftp://notexample.com/de/", "no scheme", "", None, "://", "http://É.example.com/ü/中文://x", "http://h.org/fr", "http://h.org/fr/", "x://" + "a." * 3000 + "net/" + "p" * 20_000]


def pages_of(spark, found):
    return spark.createDataFrame([(i, u, "clash", "y", 0.5) for i, u in enumerate(found)], "page_id long, url string, host string, rule string, score double").repartition(2)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(urls.RULES, "host string, path string, verdict string")


def test_urls_are_judged_as_by_the_plain_version(spark, rules):
    labels = [tuple(r) for r in urls.labelled_urls(spark).collect()]
    assert len(labels) == 4 * (len(urls.BLOCKED) + len(urls.ALLOWED)) and len({u for u, _ in labels}) > 1000
    got = {r.page_id: r for r in urls.judged(pages_of(spark, URLS), rules, urls.labelled_urls(spark)).collect()}
    for i, (u, score) in enumerate(zip(URLS, plain_scores(URLS, labels), strict=True)):
        host, path = split_url(u)
        rule = plain_rule(host, path, urls.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0] + rule[1])
        assert got[i].verdict == (rule[2] if rule else "block" if score >= 0.5 else "allow")
        assert got[i].score is None if rule else got[i].score == pytest.approx(score, abs=1e-9)


def test_urls_hold_out(spark):
    """Words that no training url has in this combination are told apart."""
    rows = urls.labelled_urls(spark).withColumn("held", F.crc32(F.col("url").cast("binary")) % 4 == 0)
    held = rows.where("held").withColumn("page_id", F.col("label").cast("long"))
    got = urls.judged(held, spark.createDataFrame([], "host string, path string, verdict string"), rows.where("not held")).collect()
    right = sum((r.verdict == "block") == (r.page_id == 1) for r in got)
    assert len(got) > 200 and right > 0.85 * len(got)


def test_many_rules_are_joined_to_hosts(spark, rules):
    rng = random.Random(2)
    many = [(rng.choice(["net", "a.net", "b.a.net", "com", "x.com", "", None]), rng.choice(["/", "/a", "/a/", "", None]), rng.choice(["block", "allow"])) for _ in range(60)]
    many += [(f"h{i}.com", "/", "block") for i in range(50)]
    found = [f"http://{h}{p}" for h in ["net", "a.net", "c.b.a.net", "ba.net", "x.com", "y.x.com", "h7.com", "z.h8.com", "org", "..net", "a.net."] for p in ["", "/", "/a", "/a/b"]] + URLS
    df = spark.createDataFrame(many, "host string, path string, verdict string").unionByName(rules)
    page = pages_of(spark, found)
    one = page.select("page_id", *(c.alias(n) for c, n in zip(urls.host_and_path(F.col("url")), ("host", "path"), strict=True)))
    few, joined, shuffled = (sorted(urls.with_rules(one, df, **o).select("page_id", "matched").collect()) for o in ({}, {"inline": 2}, {"inline": 2, "broadcast_bytes": -1}))
    assert few == joined == shuffled
    clean = [(h, p or "", v) for h, p, v in many if h] + urls.RULES
    for i, m in few:
        want = plain_rule(*split_url(found[i]), clean)
        assert (m and (m.host, m.path)) == (want and want[:2])
        if want:
            assert m.verdict == ("block" if (*want[:2], "block") in clean else "allow")


def test_urls_without_rows_labels_or_rules(spark, rules):
    none = spark.createDataFrame([(None, 1), ("http://a/", None)], "url string, label int")
    assert urls.judged(pages_of(spark, URLS).limit(0), rules, none).collect() == []
    got = urls.judged(pages_of(spark, ["http://x.com/", None]), rules.limit(0), none).collect()
    assert {(r.rule, r.verdict, r.score) for r in got} == {(None, "block", 0.5)}
