"""Operators 1, 2 and 10."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from folium.llm import postings, warc, wrappers

BIG = "<p>" + "ä" * 700 + "</p>"
PAGES = [(1, "http://a/x", "<p>small</p>"), (2, "http://a/y", "<p>small</p>"), (3, "http://a/z", BIG), (4, None, BIG), (9, "bad\r\nurl", BIG), (9, "twice", BIG), (None, "n", BIG), (12, "e", None), (13, "", ""), (14, "o", "x" * 999), (15, "o", "x" * 999), (16, "o", "y" * 1000), (17, "o", "y" * 1000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def test_warc(pages):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        to = max(same) if len(b) >= 1000 and len([1 for _, _, g in PAGES if (g or "") == (h or "")]) > 1 and max(same) != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert got == sorted(want, key=str)


def test_warc_files_and_references(spark, pages, tmp_path):
    archives = warc.write_archives(pages)
    made = warc.export(archives, f"file://{tmp_path}/out").collect()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out/*.warc.zst")
    assert sorted((r.path, r.bytes) for r in made) == sorted((f.path.rpartition("/")[2], f.length) for f in files.collect()) and made
    records = warc.read_archives(files.select("path", "content"))
    assert records.count() == len(PAGES) and warc.unresolved(records).collect() == []
    lost = records.where("not (record_type = 'response' and page_id = 17)")
    assert [r.page_id for r in warc.unresolved(lost).collect()] == [17]


def test_warc_with_a_dictionary():
    records = [warc.record(i, f"http://h/{i}", (f"<html><body>shared words of every page {i} " * 40).encode(), b"\0" * 20, None) for i in range(300)]
    packed = warc.archive(records)
    assert packed[:4] == bytes.fromhex("5d2a4d18") and list(warc.frames(packed)) == records
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(packed[:-3]))


@pytest.mark.parametrize("old,new", [(b"WARC/1.1", b"WARX/1.1"), (b"WARC-Date", b"WARC-Dote"), (b"payload", b"pay"), (b"payload", b"Payload"), (b"Content-Length: 7\r\n\r\np", b"Content-Length: 8\r\n\r\np"), (b"sha1:", b"md5:")])
def test_warc_is_validated(old, new):
    raw = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None)
    assert warc.parse(raw)["page_id"] == 1
    with pytest.raises(warc.ArchiveError):
        warc.parse(raw.replace(old, new))


SHELL = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>{}<footer>foot</footer></body></html>'


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four</p><script>x</script><p>five</article>", "A & B\none two three four\nfive"),
        ('<header><h2>site</h2></header><main><div class="cookie-notice">ok?</div><p>body</p><form>f</form><section id="comments"><p>nice</p></section></main>', "body"),
        ('<div class="ad">buy</div><article><p>x &lt;tag&gt; &#233;</p><aside>side</aside><ul><li>i1<li>i2</ul></article>', "x <tag> é\ni1\ni2"),
        ('<article><header><h1>Head</h1><p>by me</p></header><p>a</p><article class="comment"><p>c</p></article></article>', "Head\na"),
        ("<article></article>", ""),
        ('<div id="w"><div role="main"><p>a</p></div><p>b</p></div>', "a"),
    ],
)
def test_main_text(html, text):
    page = SHELL.format(html)
    assert wrappers.extract(page, wrappers.content_of(wrappers.wrapper_of(wrappers.read(page)))) == text


def test_wrappers_without_article_elements(spark):
    rows = [(i, f"http://h.example/{i}", SHELL.format(f'<div id="wrap"><div class="top"><p>brand {i}</p></div><div class="story"><h1>Title {i}</h1>' + f"<p>para {i} with a good deal of text in it, and more of it.</p>" * (1 + i % 3) + "</div></div>")) for i in range(6)]
    df = spark.createDataFrame([*rows, (50, None, None), (51, "http://[", ""), (52, "http://h.example/p", "plain text")], "page_id long, url string, html string")
    got = {r.page_id: r for r in wrappers.main_texts(df).collect()}
    para = "para 4 with a good deal of text in it, and more of it."
    assert got[4].text == f"Title 4\n{para}\n{para}" and got[4].n_chars == len(got[4].text)
    assert got[50].text == got[51].text == "" and got[52].text == "plain text"
    shape = {r.host: r.expression for r in wrappers.infer_wrappers(df).collect()}["h.example"]
    assert "(<p>#</>)+" in shape and "?" in shape


def test_text_beside_the_heaviest_element(spark):
    """Headings, leads and second containers stay; slogans and lists of links that all pages have go."""
    story = lambda i, n: f"<p>{' '.join(f'word{chr(97 + i)}{chr(97 + k % 26)}' for k in range(n))}</p>"
    single = f'<body><h1>T</h1><p>lead</p>loose<div class="story">{story(0, 65)}</div><div class="more">{story(1, 30)}</div></body>'
    got = wrappers.extract(single, wrappers.content_of(wrappers.wrapper_of(wrappers.read(single)))).split("\n")
    assert got[:3] == ["T", "lead", "loose"] and [len(x.split()) for x in got[3:]] == [65, 30]
    page = '<body><div class="slogan"><p>We know it all</p></div><div class="more-links"><a href="/1">Other</a> <a href="/2">Page</a></div><h1>Head {0}</h1><p>lead {0}</p><div class="story">{1}</div><div class="rest">{2}</div></body>'
    rows = [(i, f"http://h/{i}", page.format(chr(97 + i), story(i, 65), story(i + 7, 30))) for i in range(5)]
    rows.append((9, "http://h/9", f"<body><h1>Only</h1><div class='other'>{story(20, 40)}</div><div class='story'><p>short</p></div></body>"))
    texts = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        lines = texts[i].split("\n")
        assert lines[:2] == [f"Head {chr(97 + i)}", f"lead {chr(97 + i)}"] and [len(x.split()) for x in lines[2:]] == [65, 30]
    assert [len(x.split()) for x in texts[9].split("\n")] == [1, 40, 1]


def test_doubtful_hints_inside_articles(spark):
    """An article's own sections, references and formulas stay; what all pages of the host repeat goes."""
    word = lambda i: f"w{chr(97 + i)}"
    page = '<main><ul class="tabs"><li><a href="/a">Read</a></li><li><a href="/b">Edit</a></li></ul><h1>T {0}</h1><p class="legal">law {0}</p><section id="discussion"><h2 class="section-header">Seen {0}</h2><p>found {0}</p></section><h2 id="related-work">Others {0}</h2><p>let <math><mi>x{0}</mi></math> be</p><ol class="refs"><li><a href="/{0}">Paper {0}</a></li></ol><div class="notice"><p>All rights reserved</p></div><div class="related"><a href="/{0}">More {0}</a></div><div id="comments"><p>nice {0}</p></div></main>'
    rows = [(i, f"http://h/{i}", page.format(word(i))) for i in range(5)]
    for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        x = word(r.page_id)
        assert r.text.split("\n") == [f"T {x}", f"law {x}", f"Seen {x}", f"found {x}", f"Others {x}", f"let x{x} be", f"Paper {x}"]


def test_names_of_an_articles_own_parts(spark):
    """Hints beside other words need the wrapper's word inside articles; those of page furniture don't."""
    inner = '<section class="market-share"><p>Shares rose {0}.</p></section><div id="social-history"><p>A history {0}.</p></div><p class="hidden-gems">Gems {0}.</p><div class="share-buttons">Tell a friend {0}</div><ul class="comments-list"><li>Nice {0}</li></ul><div class="adSlot top">Buy {0}</div>'
    words = ["up", "down", "slowly", "fast", "again"]
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>Title {i}</h1>{inner.format(words[i])}</article></body>") for i in range(5)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nShares rose {w}.\nA history {w}.\nGems {w}." for i, w in enumerate(words)}


def test_constants_of_the_template(spark):
    """What an article's template says on every page goes, by the host's wrapper; what copies of one article say stays."""
    page = '<article><h1>Title {0}</h1><h2>Summary</h2><p>text {0} of {0}</p><div class="x9">Subscribe now for 5 dollars</div><p>more {0}</p><p>Ask us anything</p></article>'
    word = lambda i: chr(97 + i) * 9
    rows = [(i, f"http://h/{i}", page.format(word(i))) for i in range(6)] + [(10 + i, f"http://copies/{i}", page.format("x")) for i in range(6)] + [(20 + i, f"http://few/{i}", page.format(word(i))) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (0, wrappers.BROADCAST_BYTES):
        got = {r.page_id: r.text.split("\n") for r in wrappers.main_texts(df, broadcast_bytes=limit).collect()}
        for i in range(6):
            assert got[i] == [f"Title {word(i)}", "Summary", f"text {word(i)} of {word(i)}", f"more {word(i)}"]
        assert all(len(got[i]) == 6 for i in (10, 15, 20, 21))
    off = wrappers.extract(rows[0][2], {"main": True, "path": [], "beside": [], "refused": [], "constants": []})
    assert len(off.split("\n")) == 6
    shape = {r.host: r.expression for r in wrappers.infer_wrappers(df).collect()}
    assert '<div.x0>"Subscribe now for 5 dollars"</>' in shape["h"] and '"' not in shape["few"]


def test_main_texts_against_a_plain_version(spark):
    """Articles of many hosts, with references, unclosed paragraphs, scripts, lists, template texts and copies."""
    rng = random.Random(8)
    word = lambda: rng.choice(["river", "caf&eacute;", "a&amp;b", "&lt;b&gt;", "x&#233;y", "<b>bold</b>", "one\n two", "<a href='/x'>link</a>", "<br>", "end.", "&notin;", "&unknown;", "5 < 6"])
    rows = []
    for i in range(240):
        host = f"h{i % 12}.example"
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}<li>{}</ul>", "<div>{}</div>", "<script>{}</script>", "<blockquote><p>{}</p></blockquote>"]).replace("{}", " ".join([f"w{rng.randrange(10**6)}", *(word() for _ in range(rng.randint(0, 12)))])) for _ in range(rng.randint(0, 8)))
        template = '<div class="x9">Subscribe now</div>' * (i % 12 < 4) + "<h3>Share of voice</h3>" * (i % 12 == 5)
        rows.append((i, f"https://{host}/{i}", f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><article><h1>T {i}</h1>{body}{template}</article><footer>foot {i}</footer></body></html>"))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(2000, None, None), (2001, "http://h1.example/", "")]
    got = sorted((r.page_id, r.text) for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    want = sorted(brute.op2(rows, wrappers.host_of))
    assert got == want and not any("Subscribe" in t for i, t in want if i < 1000)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no fixture tables")
def test_main_texts_of_the_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    assert sorted((r.page_id, r.text) for r in wrappers.main_texts(df).collect()) == sorted(brute.op2(rows, wrappers.host_of))


def test_long_groups_and_bounds():
    page = lambda tags, n: wrappers.wrapper_of(wrappers.read("<body>" + "".join(f"<{t}>a</{t}>" for t in tags) * n + "</body>"))
    seven = ["h2", "p", "div", "h3", "ul", "pre", "table"]
    assert wrappers.expression(page(seven, 3)) == f"<#page><body>({' '.join(f'<{t}>#</>' for t in seven)})+</></>"
    w = page(["p"], 1)
    for k in range(30):
        w = wrappers.merged(w, wrappers.wrapper_of(wrappers.read("<body>" + "".join(f'<div class="c{chr(97 + (k * 7 + i) % 26)}{chr(97 + i % 25)}">x</div>' for i in range(40)) + "</body>")))
    assert sum(1 for _ in wrappers.slots(w)) <= wrappers.WIDTH + 1


@pytest.mark.parametrize("tag", ["div", "ul", "article", "p"])
def test_deep_nesting(tag):
    """Pages of 100,000 nested or unclosed tags are read; texts keep their order."""
    page = "".join(f"<{tag}>" + (f"<div>at {i}</div>" if i % 20_000 == 0 else "") for i in range(100_000)) + "end" + f"</{tag}>" * 60_000 + "<p>after" + "</div>" * 1000
    content = wrappers.content_of(wrappers.wrapper_of(wrappers.read(page)))
    assert wrappers.extract(page, content).split("\n") == [f"at {i}" for i in range(0, 100_000, 20_000)] + ["end", "after"]
    hidden = "<div>" * 500 + "<nav>" + "<div>" * 10 + "menu" + "</div>" * 10 + "</nav>text"
    assert wrappers.extract(hidden, content) == "text"


def test_union_free_groups():
    page = lambda n: wrappers.wrapper_of(wrappers.read("<body>" + "<h2>a</h2><p>b</p>" * n + "</body>"))
    assert wrappers.expression(wrappers.merged(page(3), page(2))) == "<#page><body>(<h2>#</> <p>#</>)+</></>"


@pytest.mark.parametrize("clusters", [0, 12])
def test_nearest(spark, clusters):
    rng = np.random.default_rng(clusters)
    n, d = 1500, 24
    v = rng.normal(size=(n, d)) + (rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] * 4 if clusters else 0)
    v[100:200] = v[50]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(2000, None), (2050, [0.0] * d), (2100, [1.0, None] * (d // 2)), (2150, [float("nan")] * d), (2200, [float("inf")] + [0.0] * (d - 1)), (2250, [1.0]), (None, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in postings.nearest(df, list_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, n, 50)) and all(len(x) == 5 for x in got.values())
    norm, hit = np.sqrt((v * v).sum(axis=1)), 0
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -2
        best = sorted(range(n), key=lambda i: (-s[i], i))[:5]
        hit += len({i for i, _ in found} & set(best))
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and all(abs(s[i] - x) < 1e-12 for i, x in found)
    assert hit / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[50]] == [100, 101, 102, 103, 104]


def test_nearest_visits_few_lists_of_clusters():
    """The ratio is fitted: near 1 where there are clusters, wide where there are none."""
    rng = np.random.default_rng(4)
    flat, centres = rng.normal(size=(3000, 16)), rng.normal(size=(40, 16))
    close = centres[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    share = []
    for x in (flat, close):
        x = postings.unit(x)
        graph = postings.CentroidGraph(postings.balanced_centroids(x, 55))
        ratio = postings.fitted_ratio(graph, x, 5, postings.BOUNDARY, postings.RECALL)
        row, at, place, count = graph.ranked(x[::50], ratio)
        assert (np.bincount(row) == count[place == 0]).all()
        share.append(len(row) / 60 / 55)
    assert share[1] < 0.3 < share[0]


def test_nearest_of_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 4))
    rows = [(i % 100, [float(x) for x in r], 1.0, 7, "c") for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int, list string")
    got = postings.nearest(df, ratio=100.0).orderBy("query_id", "rank").collect()
    u = postings.unit(v)
    for q in (0, 50):
        best = {}
        for i in range(120):
            for j in range(120):
                if i % 100 == q and j % 100 != q:
                    best[j % 100] = max(best.get(j % 100, -2), float(u[i] @ u[j]))
        want = sorted(best, key=lambda j: (-best[j], j))[:5]
        assert [r.vec_id for r in got if r.query_id == q] == want
    assert sorted(map(tuple, got)) == sorted(map(tuple, postings.nearest(df.select("vec_id", "embedding"), ratio=100.0).collect()))


def test_clashing_columns_and_a_long_page(spark):
    rows = [(i, f"http://h/{i}", f"<article><p>text {i}</p></article>") for i in range(5)] + [(9, "http://h/9", "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"), (10, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = df.select("*", *(F.lit("clash").alias(n) for n in "host content constants salt key page text n_chars wrapper payload digest record_type refers_to original part".split()))
    for f in (wrappers.main_texts, lambda d: warc.round_trip(d).drop("url")):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(more).collect()))
    assert {r.page_id: r.n_chars for r in wrappers.main_texts(df).collect()}[9] == 60_000 * 12 - 1


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in postings.nearest(df).orderBy("query_id").collect()] == [(0, 1, 50, 0.0), (50, 1, 0, 0.0)]
    assert postings.nearest(df.limit(0)).collect() == []
    assert postings.nearest(df.where(F.col("vec_id") > 0)).collect() == []


def test_empty_pages(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == [] and wrappers.main_texts(pages.limit(0)).collect() == []
