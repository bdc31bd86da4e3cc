"""Chunking, cleaning and context against plain versions written from the algorithms' descriptions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folium.config import EngineConfig
from folium.functions import fixed_values as V
from folium.operators import chunking, pages


def plain_units(text, config):
    """Walks character by character over the masked text."""
    masked = text
    for a in sorted(V.ABBREVIATIONS, key=len, reverse=True):
        masked = re.sub(rf"(?<!\w){re.escape(a)}", lambda m: m[0].replace(".", "\x01"), masked, flags=re.I)
    for p in V.DOTS_INSIDE:
        masked = re.sub(p, lambda m: m[0].replace(".", "\x01"), masked)
    bounds, i = [0], 0
    while i < len(text):
        if masked[i] in ".!?":
            j = i + 1
            while j < len(text) and masked[j] in "\"”’)]":
                j += 1
            if j < len(text) and masked[j].isspace():
                bounds.append(j)
        if masked.startswith("\n\n", i):
            bounds.append(i)
        i += 1
    bounds.append(len(text))
    out = []
    for a, b in zip(sorted(bounds)[:-1], sorted(bounds)[1:], strict=True):
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a < b:
            out += [(a, b, False)] if b - a <= config.max_unit_chars else plain_cut(text, a, b, config)
    return out


def plain_cut(text, a, b, config):
    out, most = [], config.max_unit_chars
    while a < b:
        if b - a <= most:
            end = b
        else:
            window, end = text[a : a + most], None
            for sep in ("; ", ": ", ", ", " "):
                at = window.rfind(sep)
                if at >= int(most * config.cut_ratio) and end is None:
                    end = a + at + (1 if sep != " " else 0)
            end = a + most if end is None else end
        x, y = a, end
        while y > x and text[y - 1].isspace():
            y -= 1
        while x < y and text[x].isspace():
            x += 1
        if x < y:
            out.append((x, y, True))
        a = end
        while a < b and text[a].isspace():
            a += 1
    return out


def plain_chunks(pages_, config):
    text, spans = "", []
    for number, t, bare in pages_:
        text += "" if bare or not spans else " "
        spans.append((number, len(text), len(text) + len(t)))
        text += t
    size = lambda us: sum(y - x for x, y, _ in us) + len(us) - 1
    done, now = [], []
    for u in plain_units(text, config):
        title = re.match(rf"(?:[-•]\s*)?{V.SECTION_START}", text[u[0] : u[1]], re.I)
        if now and title:
            done.append(now)
            now = []
        elif now and size(now + [u]) > config.max_chars:
            done.append(now)
            keep = []
            if not (now[-1][1] - now[-1][0] > config.overlap_chars and now[-1][1] - now[-1][0] > config.max_chars // 2):
                keep = [now[-1]]
                for v in reversed(now[:-1]):
                    if size([v] + keep) > config.overlap_chars:
                        break
                    keep = [v] + keep
            now = keep if not keep or size(keep + [u]) <= config.max_chars else []
        now = now + [u]
    done += [now] if now else []
    out = []
    for part in done:
        seen = [[n for n, s, e in spans if x < e and y > s] or [min(spans, key=lambda p: min(abs(x - p[1]), abs(x - p[2])))[0]] for x, y, _ in part]
        body = " ".join(text[x:y] for x, y, _ in part)
        out.append((body, min(seen[0]), min(map(min, seen)), max(map(max, seen)), len(body), any(f for _, _, f in part)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_document_chunks(seed):
    rng = random.Random(seed)
    config = EngineConfig() if seed % 2 else EngineConfig(max_chars=120, overlap_chars=rng.choice([0, 20, 70]), max_unit_chars=rng.choice([60, 180]), cut_ratio=0.55)
    bits = ["Dr. Silva viu", "p. 3", "3.5 mg", "et al. 2020", "A. B. Costa", "Conduta: repetir", "Diagnóstico:", "fim.", "então!", 'sim?"', "(ok.)", "a; b: c, d", "\n\n", "\n", "palavra", "x" * 40, "y" * 700, "eflúvio telógeno", "\n\n\n", "- Exames: três"]
    pages_ = []
    for i in range(rng.randint(1, 6)):
        t = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 90))).strip()
        if t:
            pages_.append((i * 2 + 1, t, rng.random() < 0.2))
    if pages_:
        got = [tuple(c[k] for k in ("text", "page", "page_start", "page_end", "char_count", "forced_split")) for c in chunking.document_chunks("d", pages_, config)]
        assert got == plain_chunks(pages_, config)


def test_segments_and_blocks_make_the_same_chunks(spark):
    """Documents in segments and blocks, and as one text each."""
    rng, rows = random.Random(3), []
    bits = ["uma frase curta.", "Dr. Silva", "\n\nConduta: repetir", "\n\n- Exames: três", "Diagnóstico: não", "\n\nTratamento:", "vitamina C.", "\n\nfim", "y" * 300, "EXAMES : x"]
    for d in range(12):
        for p in range(rng.randint(1, 6)):
            rows.append((f"d{d}", p, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 80))).strip(), rng.random() < 0.3))
    got = chunking.chunks(spark.createDataFrame(rows, "document string, page int, text string, no_space_before boolean").repartition(3))
    found = {(r.source, r.text): (r.page, r.page_start, r.page_end, r.forced_split, r.chunk_no) for r in got.collect()}
    want = {}
    for d in sorted({r[0] for r in rows}):
        for c in chunking.document_chunks(d, [r[1:] for r in rows if r[0] == d]):
            want.setdefault((d, " ".join(c["text"].lower().split())), ((d, c["text"]), (c["page"], c["page_start"], c["page_end"], c["forced_split"], c["chunk_no"])))
    assert found == dict(want.values()) and len(found) > 60


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_small_segments_and_blocks(spark, seed):
    """Borders everywhere: through sentences, long units, headings and overlaps, and pages longer than a segment."""
    rng = random.Random(seed)
    config = [EngineConfig(max_chars=60, overlap_chars=25, max_unit_chars=40), EngineConfig(max_chars=100, overlap_chars=70, max_unit_chars=60), EngineConfig(max_chars=90, overlap_chars=0, max_unit_chars=180)][seed]
    bits = ["Dr. Silva viu", "3.5 mg", "et al. 2020", "A. B. Costa", "Conduta: repetir", "fim.", 'sim?"', "a; b: c, d", "\n\n", "palavra", "x" * 40, "y" * 700, "eflúvio 😀", "Tratamento:", "a.", "b.", "c."]
    rows = []
    for d in range(4):
        for p in range(rng.choice([1, 40, 400])):
            rows.append((None if d == 3 else f"d{d}", 3 * p, " ".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 30, 200]))).strip(), rng.random() < 0.2 and p > 0))
    df = spark.createDataFrame(rows, "document string, page int, text string, no_space_before boolean").repartition(3)
    layout = chunking.Layout(segment=300, context=60, units=1)
    raw = chunking.raw_chunks(df, config, layout).collect()
    assert chunking.blocks(chunking.units(df, config, layout), config, layout).count() > 8
    for d in {r[0] for r in rows}:
        got = [(r.text, r.page, r.page_start, r.page_end, r.char_count, r.forced_split) for r in sorted((r for r in raw if r.document == d), key=lambda r: r.chunk_no)]
        want = [tuple(c[k] for k in ("text", "page", "page_start", "page_end", "char_count", "forced_split")) for c in chunking.document_chunks(d, [r[1:] for r in rows if r[0] == d], config)]
        assert got == want
        assert sorted(r.chunk_no for r in raw if r.document == d) == list(range(len(want)))


def test_one_long_section_is_many_tasks(spark):
    """20 MB without a heading: equal to the text in memory, in as many groups as it has segments and blocks."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randrange(3, 25))) for _ in range(120)) + "." for _ in range(2000)]
    df = spark.createDataFrame([("d", i, t, False) for i, t in enumerate(texts)], "document string, page int, text string, no_space_before boolean").repartition(16)
    found = chunking.raw_chunks(df).select("chunk_no", "text", "page_start").collect()
    got = [(r.text, r.page_start) for r in sorted(found, key=lambda r: r.chunk_no)]
    assert got == [(c["text"], c["page_start"]) for c in chunking.document_chunks("d", [(i, t, False) for i, t in enumerate(texts)])]
    spans = pages.offsets(df)
    assert chunking.segments(spans).select("segment").distinct().count() >= 16
    assert chunking.blocks(chunking.units(df)).count() >= 16


def test_texts_are_dealt_out_by_block_once(spark):
    """units are numbered by runs, so that the plan joins no blocks with their neighbours' texts."""
    df = spark.createDataFrame([("d", i, "Uma frase. Outra frase.", False) for i in range(30)], "document string, page int, text string, no_space_before boolean")
    plan = chunking.raw_chunks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 0 and plan.count("Window") == 0


def test_a_python_task_holds_one_block(spark):
    """blocks come to Python by group, not in batches of thousands of rows."""
    df = spark.createDataFrame([("d", i, "Uma frase. Outra frase.", False) for i in range(30)], "document string, page int, text string, no_space_before boolean")
    plan = chunking.raw_chunks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_boilerplate_is_guarded_and_replaced_alike(spark):
    """patterns that begin with alternatives are tried only where a text has one of them; each text is folded once."""
    known = [x for p in V.BOILERPLATE for x in pages.literals_of(p)]
    assert all(known) and "all rights reserved" in known and "todos os direitos reservados" in known
    rows = ["ALL RIGHTS RESERVED x without written permission y. z", "a Todos os DIREITOS reservados b sem autorização escrita c. d", "CONTEÚDO licenciado para 123.456.789-00 e", "plain İ", "No Part Of This Book f permission. g", None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    plain = F.col("x")
    for p in V.BOILERPLATE:
        plain = F.regexp_replace(plain, f"(?siuU){p}", " ")
    got = df.select(pages.without_boilerplate(F.col("x")).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in got.collect())
    assert got.select("a")._jdf.queryExecution().analyzed().toString().count("upper(") == 1


def test_lines_and_blanks_by_batch(spark):
    """lines_long() and strip() against the patterns that they stand for."""
    from folium.functions import text as T

    odd = [None, "", " \t", *(f"{c}a{c} b{c}{c}c {c}" for c in map(chr, (*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))), "a\r\n\r\nb\n\r c", "\n".join(map(str, range(20)))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    x = F.col("x")
    for r in df.select("x", T.lines(x).alias("a"), T.lines_long(x).alias("b"), T.lines_long(x, 4).alias("c"), T.strip(x).alias("d"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "").alias("e")).collect():
        assert r.a == r.b and r.d == r.e
        assert r.c is None or set(r.c) == {*r.a[:4], *r.a[-4:]}


def test_running_totals_places_and_neighbours(spark):
    from folium.operators import running

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in rng.sample(range(-500, 9000), 1500)] + [("c", None, 4)]
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(5)
    total = running.running_total(df, ["g"], "i", F.col("v"), "t", width=100)
    out = running.places(running.neighbours(total, ["g"], "i", F.struct("v"), "p", "n", width=7), ["g"], "i", "at", width=64)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1]))
        got = sorted((r for r in out.collect() if r.g == g), key=lambda r: r["at"])
        assert [(r.i, r.t, r.p and r.p.v, r.n and r.n.v) for r in got] == [(r[1], sum(x[2] for x in own[: k + 1]), own[k - 1][2] if k else None, own[k + 1][2] if k + 1 < len(own) else None) for k, r in enumerate(own)]


def test_chunks_of_the_reference_cases():
    text = "Primeira frase curta. Segunda frase curta. Terceira frase curta."
    assert [c["text"] for c in chunking.document_chunks("AAG-Caso3.pdf", [(1, text, False)])] == [text]
    assert chunking.document_chunks("d", [(1, " \n ", False)]) == []


def test_cleaning(spark):
    rows = ["Todos os direitos reservados. Nada sem autorização escrita do autor. Clínica.", "pala-\nvra\n12\n• item\nfim  dois", "texto Diagnóstico: a Conduta: b", "a | 12 | b |3 c", None, ""]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", pages.cleaned(F.col("x")).alias("t")).orderBy("i").collect()]
    assert got == ["Clínica.", "palavra \n\n- item fim dois", "texto\n\nDiagnóstico: a\n\nConduta: b", "a b c", None, ""] or got[0] == "Clínica." and got[2] == "texto\n\nDiagnóstico: a\n\nConduta: b"
    assert got[3].split() == ["a", "b", "c"] and got[4] is None and got[5] == ""


def test_overlapping_pages_falls_back_to_the_nearest(spark):
    spans = spark.createDataFrame([("d", 1, 10, 20), ("d", 2, 40, 50), ("d", 3, 50, 60), ("e", 7, 0, 5)], "document string, page int, start long, stop long")
    units = [("d", 0, 12, 45), ("d", 1, 0, 5), ("d", 2, 22, 25), ("d", 3, 36, 38), ("d", 4, 30, 31), ("d", 5, 90, 99), ("d", 6, 60, 61), ("e", 7, 9000, 9001), ("z", 8, 0, 3)]
    got = {r.unit: (r.page_start, r.page_end) for r in pages.overlapping_pages(spark.createDataFrame(units, "document string, unit long, start long, stop long"), spans).collect()}
    assert got == {0: (1, 2), 1: (1, 1), 2: (1, 1), 3: (2, 2), 4: (1, 1), 5: (3, 3), 6: (3, 3), 7: (7, 7)}


def test_nearest_of_many_borders(spark):
    """Over blocks as over all, and with no frame that ends at a partition's last row."""
    from folium.operators import running

    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-300, 3000), rng.choice([None, rng.randrange(9)])) for _ in range(600)] + [("c", 4, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, at long, page int, i int").repartition(5)
    got = {r.i: r for r in running.nearest(df, ["g"], "at", "page", "b", "a", width=64).collect()}
    assert len(got) == len(rows)
    for i, (g, at, page) in enumerate(rows):
        if page is not None:
            continue
        own = [(x[1], x[2]) for x in rows if x[0] == g and x[2] is not None]
        before, after = min(((-p, v) for p, v in own if p <= at), default=None), min((x for x in own if x[0] >= at), default=None)
        assert (got[i].b and (-got[i].b["at"], got[i].b["page"]), got[i].a and tuple(got[i].a)) == (before, after)
    spans = df.where("page is not null").select(F.col("g").alias("document"), "page", F.col("at").alias("start"), (F.col("at") + 3).alias("stop"))
    units = df.select(F.col("g").alias("document"), F.col("i").alias("unit"), F.col("at").alias("start"), (F.col("at") + 1).alias("stop"))
    plan = pages.overlapping_pages(units, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
