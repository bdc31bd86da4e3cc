"""Goldens of labels, scores, variants and chunking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.functions import answers as A
from folium.functions import rules as L
from folium.functions import text as T
from folium.operators import chunking, pages

Q = "Paciente feminina com queda na coroa, couro cabeludo oleoso e escamando. Toma anticoncepcional e antidepressivo."


@pytest.mark.parametrize(
    "source,text,similarity,score,rejected,kind,content",
    [
        ("Termo de consentimento.pdf", "Autorizo o procedimento.", 0.70, 0.60, True, "consent_form", "general"),
        ("AAG-Caso3.pdf", "Conduta: minoxidil para alopecia androgenetica.", 0.62, 0.31, True, "clinical_case", "treatment"),
        ("Protocolo mesoterapia.pdf", "Procedimentos: aplicacao de laser.", 0.58, 0.24, False, "procedure_protocol", "procedure"),
    ],
)
def test_scores(spark, source, text, similarity, score, rejected, kind, content):
    df = spark.createDataFrame([(Q, source, text, similarity)], "question string, source string, text string, similarity double")
    r = L.scored(df).first()
    assert (r.document_type, r.content_type, r.rejected) == (kind, content, rejected)
    assert r.adjusted_score == pytest.approx(score + min(0.12, r.lexical_coverage * 0.14), abs=1e-6)


def test_tokens_of_the_question(spark):
    r = spark.createDataFrame([(Q,)], "q string").select(T.tokens(T.normalize(F.col("q"))).alias("t")).first()
    assert set(r.t) == set("feminina queda coroa couro cabeludo oleoso escamando toma anticoncepcional antidepressivo com".split()) - {"com"}


def test_variants(spark):
    r = spark.createDataFrame([(Q,), ("  ",), ("Nódulo após mesoterapia",)], "q string").select(L.query_variants(F.col("q")).alias("v")).collect()
    assert len(r[0].v) == 3 and r[0].v[0] == Q and r[0].v[1].count("; ") == 2 and r[0].v[2].startswith(Q + " investigacao")
    assert [x.strip() for x in r[1].v][0].startswith("investigacao")
    assert len(r[2].v) == 4


def test_normalize_is_nfkd(spark):
    import unicodedata

    texts = ["Ação ﬁnal ½ ª º Ǆ ñÑ ß İ", "ÀÉÎõü é ｆｕｌｌ", "", None, "  x--y__z9 "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()
    for r in rows:
        if r.t is not None and "İ" not in r.t:
            d = "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)).lower()
            assert r.n == " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in d).split())


def test_chunks_split_at_headings(spark):
    text = "Homem com rarefação.\n\nExames: tricoscopia feita.\n\nConduta: minoxidil tópico."
    df = spark.createDataFrame([("AAG-Caso3.pdf", 1, text, False)], "document string, page int, text string, no_space_before boolean")
    rows = chunking.chunks(df).orderBy("chunk_no").collect()
    assert [r.content_type for r in rows] == ["general", "assessment", "treatment"]
    assert {r.document_id for r in rows} == {"aag_caso3"} and {r.document_type for r in rows} == {"clinical_case"}


def test_units_cover_the_text():
    config, text = chunking.EngineConfig(), "O Dr. Silva viu 3.5 mg. Fim da página um aqui. " + "palavra, " * 400 + "fim."
    whole = chunking.sentences(text)
    assert text[slice(*whole[0])] == "O Dr. Silva viu 3.5 mg."
    cut = [p for a, b in whole for p in ([(a, b)] if b - a <= 1800 else chunking.pieces(text, a, b, config))]
    assert all(b - a <= 1800 for a, b in cut) and len(cut) > len(whole)
    assert "".join("".join(text[a:b].split()) for a, b in cut) == "".join(text.split())
    length = np.array([b - a for a, b in cut])
    for i, j in chunking.packed(length, np.zeros(len(cut), bool), config):
        assert length[i:j].sum() + j - i - 1 <= 1200 or j == i + 1


def test_cleaning(spark):
    text = "Conteúdo licenciado para Fulano 123.456.789-00 A queda é comum.\n12\nfoli-\nculite Diagnóstico: x Conduta: y"
    r = spark.createDataFrame([(text,)], "t string").select(pages.cleaned(F.col("t")).alias("c")).first()
    assert "Fulano" not in r.c and "foliculite" in r.c and "\n\nDiagnóstico:" in r.c and "\n\nConduta:" in r.c


def test_merge_overlap(spark):
    a = "um dois tres quatro cinco seis sete"
    rows = spark.createDataFrame([(a, "tres quatro cinco seis sete oito"), (a, "sete oito"), ("", "x")], "a string, b string").select(T.merge_overlap(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in rows] == [a + " oito", a + " sete oito", "x"]


def test_problems(spark):
    rows = [("Texto sem nada", 1, "x"), ("Como prosseguir agora: observar [1] [4]", 2, "O que fazer?"), ("Inicie 5 mg [1] porque", 1, "x")]
    got = spark.createDataFrame(rows, "a string, n int, q string").select(A.problems(F.col("a"), F.col("n"), F.col("q")).alias("p")).collect()
    assert [r.p for r in got] == [["resposta sem citações"], ["citações inexistentes: [4]"], ["linguagem prescritiva ou dose", "resposta possivelmente interrompida"]]


def test_whole_texts_are_normalised_as_columns_are(spark):
    """The batch form and the expression agree, and labels of whole texts don't go through the patterns."""
    import re

    from pyspark.sql import functions as F

    from folium.functions import rules, text
    from folium.storage import attach

    attach(spark)
    odd = ["", None, " ", "Ação  ÇÉdilha-12", "ȩ́x", "İstanbul ſtraße K Å ﬁn ½ ² Ⅳ", "日本 x⃝ Ж ab c", "A\U0001f600b\U0001d165c", "\tÑ\n\r-\x0bz\x00y"]
    odd += [f"a{chr(i)}b {chr(i)}" for i in (*range(0x80, 0x600), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB10))]
    df = spark.createDataFrame([(i, "s", x) for i, x in enumerate(odd)], "i int, source string, text string")
    both = df.select("text", text.normalize(F.col("text")).alias("a"), text.normalize_long(F.col("text")).alias("b"))
    assert [(r.text, r.a, r.b) for r in both.collect() if r.a != r.b] == []
    plan = rules.with_texts(rules.labelled(df, keep=True))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_replace\((substring\()?text#\d+[^)]*\)?, \\p\{M\}", plan)


def test_streamed_lockouts_make_no_table_for_users_without_rows():
    import types

    import pandas as pd

    from folium.streaming import flows

    def state(seen):
        return types.SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: seen, update=lambda x: None, setTimeoutTimestamp=lambda x: None)

    rows = pd.DataFrame({"ts": pd.to_datetime([1, 2, 3], unit="s"), "event_id": [1, 2, 3], "success": [False] * 3})
    run = flows._count(3, 15)
    assert list(run((7,), iter([rows]), state(0))) == []
    (got,) = run((7,), iter([rows]), state(9000))
    assert got.failures.tolist() == [1, 2, 3] and got.locked_until.isna().tolist() == [True, True, False] and got.user_id.tolist() == [7] * 3
