"""Queries over the fixture tables for each operator, and DuckDB SQL with the same rows.

Every query runs over its whole tables. SQL pieces are made from the same fixed values as the Columns.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import EngineConfig
from .functions import answers as A
from .functions import fixed_values as V
from .functions import records
from .functions import rules as L
from .functions import text as T
from .functions.filters import where
from .operators import chunking, clustered, dedup, knn, pages, selection, store
from .operators.embedding import HashingEmbedder, embedded
from .plans import index, ingest, retrieve
from .sources.pdf import page_texts, pdf_of
from .sources.tables import backfilled, cases, checked, chunk_lines, extracted, files, html_pages, point, table
from .storage import kept, shared_dir
from .streaming import flows

CONFIG = EngineConfig()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUESTION = "Mulher com queda na coroa, couro cabeludo oleoso e escamando; toma anticoncepcional e antidepressivo. Ferritina baixa: o que fazer?"
QUESTIONS = [(1, QUESTION), (2, "Nodulo e prurido apos mesoterapia: qual a conduta?"), (3, "The tion of and ering thres")]


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- SQL pieces


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def answer_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '\\s+', ' ', 'g'))"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def any_sql(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(T.normalize_py(t))})" for t in terms) + ")"


def hits_sql(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {lit(T.normalize_py(t))})::INT" for t in terms) + ")"


def case_sql(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(v)}" for c, v in rules) + f" ELSE {default} END"


def lines_sql(c: str) -> str:
    return f"string_split({c}, chr(10))"


SECTION_SQL = [(f"regexp_matches(text, {lit('(?i)' + p)})", k) for p, k in V.SECTIONS]
LABELS_SQL = f"""
n AS (SELECT *, {norm_sql("source")} AS s, {norm_sql("substr(text, 1, 2500)")} AS t, {norm_sql("text")} AS f, {collapse_sql("text")} AS c FROM d),
h AS (SELECT *, {hits_sql("f", V.PROCEDURE)} AS h_procedure, {hits_sql("f", V.TREATMENT)} AS h_treatment, {hits_sql("f", V.ASSESSMENT)} AS h_assessment,
  {hits_sql("f", V.DIAGNOSIS)} AS h_diagnosis, {hits_sql("f", V.ADVERSE_EVENT)} AS h_adverse FROM n),
l AS (SELECT *,
  {case_sql([(any_sql("s || ' ' || t", V.ADMINISTRATIVE), "consent_form"), *((any_sql("s", x), k) for k, x in V.SOURCE_HINTS), (any_sql("t", V.ARTICLE_MARKS), "scientific_article"), ("regexp_matches(t, '\\bcaso\\s+\\d+\\b') OR contains(t, 'paciente do sexo')", "clinical_case")], "'educational_material'")} AS document_type,
  {case_sql([*SECTION_SQL, ("greatest(h_procedure, h_treatment, h_assessment, h_diagnosis, h_adverse) = 0", "general"), ("h_adverse >= 2", "adverse_event"), ("h_procedure >= 2 AND h_procedure >= h_treatment", "procedure"), *((f"{x} = greatest(h_procedure, h_treatment, h_assessment, h_diagnosis, h_adverse)", k) for x, k in (("h_procedure", "procedure"), ("h_treatment", "treatment"), ("h_assessment", "assessment"), ("h_diagnosis", "diagnosis"), ("h_adverse", "adverse_event")))], "'general'")} AS content_type,
  {case_sql([(any_sql("f", x), k) for k, x in V.TOPICS], "'general_trichology'")} AS topic,
  {case_sql([(f"regexp_matches(c, {lit('(?i)^.{0,179}?' + p)})", k) for p, k in V.SECTIONS], f"CASE WHEN regexp_extract(substr(c, 1, 160), '^([^.!?]{{3,80}}):', 1) <> '' THEN substr(replace({norm_sql("regexp_extract(substr(c, 1, 160), '^([^.!?]{3,80}):', 1)")}, ' ', '_'), 1, 60) ELSE 'general' END")} AS section
  FROM h),
q AS (SELECT *, {case_sql([(f"document_type IN ({', '.join(map(lit, V.HIGH_QUALITY))})", "high"), (f"document_type IN ({', '.join(map(lit, V.MEDIUM_QUALITY))})", "medium")], "'low'")} AS source_quality FROM l)"""
STOP_SQL = "(" + ", ".join(map(lit, V.STOP_WORDS)) + ")"


def tokens_sql(source: str, key: str, c: str) -> str:
    """key and w: the distinct tokens of c."""
    return f"SELECT DISTINCT {key}, w FROM (SELECT {key}, unnest(string_split({c}, ' ')) AS w FROM {source}) WHERE length(w) >= 3 AND w NOT IN {STOP_SQL} AND NOT regexp_matches(w, '^[0-9]+$')"


FLAGS_SQL = f"""
{any_sql("n", V.PROCEDURE)} AS asks_procedure, {any_sql("n", V.TREATMENT_QUESTION)} AS asks_treatment, {any_sql("n", V.CONSENT_QUESTION)} AS asks_consent,
{any_sql("n", V.DIAGNOSIS_QUESTION)} AS asks_diagnosis, {any_sql("n", V.SCALP)} AS has_scalp_inflammation, {any_sql("n", V.HAIR)} AS has_hair_pattern,
{any_sql("n", V.MEDICATION)} AS has_medication, {any_sql("n", V.LABS)} AS has_labs,
({any_sql("n", V.ADVERSE_EVENT)} OR ({any_sql("n", V.PROCEDURE)} AND {any_sql("n", V.PROCEDURE_SYMPTOMS)})) AS has_adverse_event"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", heavy=True)


# --- vector search

COSINE = "list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e)))"
HITS = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (
SELECT q.vec_id AS query_id, i.vec_id, {COSINE} AS sim FROM v q, v i WHERE q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s)"""


def hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("vec_id"), "embedding")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = knn.top_k(asked, e, k + 1).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


@query("knn_topk", HITS + " SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 32")
def _(spark, folder):
    return hits(spark, folder, CONFIG.candidates).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_floor_maxdedup", HITS + ", f AS (SELECT query_id // 200 AS question_id, vec_id, sim, query_id, rank, row_number() OVER (PARTITION BY query_id // 200, vec_id ORDER BY sim DESC, query_id, rank) AS n FROM r WHERE rank <= 32 AND sim >= 0.35) SELECT question_id, vec_id, query_id AS matched_query, round(sim, 6) AS similarity FROM f WHERE n = 1")
def _(spark, folder):
    h = hits(spark, folder, CONFIG.candidates).withColumns({"question_id": F.expr("query_id div 200"), "variant": F.col("query_id")})
    return knn.floor_and_merge(h, CONFIG.similarity_floor).select("question_id", "vec_id", F.col("variant").alias("matched_query"), F.round("similarity", 6).alias("similarity"))


@query("indexed_topk", f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id, {COSINE} AS sim FROM v q, v i WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def indexed_topk(spark, d):
    """Exact neighbours from a published index of clustered files."""
    e, path = table(spark, d, "embeddings"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    meta = index.publish(e, path, write=clustered.write)
    asked = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    found = clustered.searcher(spark, path, meta, key="vec_id", exact=True)(asked, 10)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("knn_null_vectors", f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 7 <> 0), s AS (SELECT q.vec_id AS query_id, i.vec_id, {COSINE} AS sim FROM v q, v i WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("embedding"))
    return knn.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


# --- text functions


@query("normalize_tokens", f"WITH n AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents), k AS ({tokens_sql('n', 'doc_id', 't')}), a AS (SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS tokens, count(*) AS n_tokens FROM k GROUP BY doc_id) SELECT n.doc_id, n.t AS normalized, coalesce(tokens, '') AS tokens, coalesce(n_tokens, 0) AS n_tokens FROM n LEFT JOIN a USING (doc_id)")
def _(spark, folder):
    d = documents(spark, folder).select("doc_id", T.normalize(F.col("text")).alias("normalized")).withColumn("k", F.array_sort(T.tokens(F.col("normalized"))))
    return d.select("doc_id", "normalized", F.array_join("k", " ").alias("tokens"), F.size("k").cast("long").alias("n_tokens"))


@query("content_hash_dedup", f"WITH h AS (SELECT doc_id, source, sha256(lower({collapse_sql('text')})) AS content_hash FROM documents) SELECT source, content_hash, min(doc_id) AS doc_id FROM h GROUP BY source, content_hash")
def _(spark, folder):
    d = documents(spark, folder).select("doc_id", "source", T.content_hash(F.col("text")).alias("content_hash"))
    return dedup.keep_first(d, ["source", "content_hash"], ["doc_id"])


SHINGLES = f"""WITH n AS (SELECT doc_id, {norm_sql("text")} AS t FROM documents), u AS (SELECT t, min(doc_id) AS id FROM n WHERE t <> '' GROUP BY t),
w AS (SELECT id, string_split(t, ' ') AS w FROM u), s AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN list_aggregate(w, 'string_agg', ' ') ELSE g END AS g FROM
(SELECT id, w, unnest(CASE WHEN len(w) < 5 THEN [''] ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] FOR i IN range(1, len(w) - 3)] END) AS g FROM w)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)"""


NEAR_CLASSES = SHINGLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT id_a, id_b FROM p JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE greatest(k / (a.n + b.n - k), k / least(a.n, b.n)) >= 0.86),
e AS (SELECT id_a AS a, id_b AS b FROM l UNION ALL SELECT id_b, id_a FROM l), r AS (SELECT DISTINCT a AS id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(low) AS class_id FROM r GROUP BY id), k AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id AS id, coalesce(u.id, doc_id) AS text_id, coalesce(class_id, u.id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM n LEFT JOIN u ON u.t = n.t LEFT JOIN m ON m.id = u.id LEFT JOIN k ON k.id = u.id"""


@query("near_dup_classes", NEAR_CLASSES)
def _(spark, folder):
    return dedup.near_duplicate_classes(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), threshold=CONFIG.max_content_similarity)


@query("near_dup_pairs", SHINGLES + " SELECT id_a, id_b, round(greatest(k / (a.n + b.n - k), k / least(a.n, b.n)), 6) AS similarity FROM p JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE greatest(k / (a.n + b.n - k), k / least(a.n, b.n)) >= 0.86")
def _(spark, folder):
    d = documents(spark, folder).select(F.col("doc_id").alias("id"), "text")
    return dedup.near_duplicates(d, threshold=CONFIG.max_content_similarity).withColumn("similarity", F.round("similarity", 6))


@query("slugs_and_ids", f"SELECT doc_id, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS document_id, printf('%s_%05d_%s', regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), doc_id, substr(sha256(lower({collapse_sql('text')})), 1, 10)) AS chunk_id FROM documents")
def _(spark, folder):
    d = documents(spark, folder).select("doc_id", T.slug(F.col("source")).alias("document_id"), T.content_hash(F.col("text")).alias("h"))
    return d.select("doc_id", "document_id", T.chunk_id(F.col("document_id"), F.col("doc_id"), F.col("h")).alias("chunk_id"))


@query("escaped_previews", "SELECT doc_id, replace(replace(replace(replace(replace(substr(text, 1, 600), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS preview, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS bounded FROM documents")
def _(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", T.escape(T.preview(t)).alias("preview"), T.bounded(t).alias("bounded"))


@query("overlap_merge", """WITH p AS (SELECT source, doc_id, text, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS following FROM documents),
t AS (SELECT doc_id, text || ' ' || array_to_string(list_reverse(string_split('x ' || following, ' '))[1:3], ' ') AS a, array_to_string(list_reverse(list_reverse(string_split(text, ' '))[1:7]), ' ') || ' ' || following AS b FROM p WHERE following IS NOT NULL),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '') AS y FROM t),
k AS (SELECT doc_id, max(i) AS k FROM (SELECT doc_id, x, y, unnest(range(5, least(120, len(x), len(y)) + 1)) AS i FROM w) WHERE x[len(x) - i + 1:] = y[1:i] GROUP BY doc_id)
SELECT w.doc_id, coalesce(k, 0) AS overlap, len(x) + len(y) - coalesce(k, 0) AS n_words FROM w LEFT JOIN k USING (doc_id)""")
def _(spark, folder):
    p = documents(spark, folder).withColumn("following", F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))).where("following is not null")
    a = F.concat_ws(" ", "text", F.array_join(F.slice(F.reverse(F.split(F.concat(F.lit("x "), "following"), " ")), 1, 3), " "))
    b = F.concat_ws(" ", F.array_join(F.reverse(F.slice(F.reverse(F.split("text", " ")), 1, 7)), " "), "following")
    count = lambda c: F.size(F.filter(F.split(c, T.SPACE), lambda w: w != ""))
    m = p.select("doc_id", a.alias("a"), b.alias("b")).withColumn("m", T.merge_overlap(F.col("a"), F.col("b")))
    return m.select("doc_id", (count("a") + count("b") - count("m")).cast("long").alias("overlap"), count("m").cast("long").alias("n_words"))


# --- labels, questions, scores


@query("classify_documents", f"WITH d AS (SELECT doc_id, source, text FROM documents), {LABELS_SQL} SELECT doc_id, document_type, content_type, topic, source_quality, section FROM q")
def _(spark, folder):
    return L.labelled(documents(spark, folder)).select("doc_id", "document_type", "content_type", "topic", "source_quality", "section")


@query("source_quality_profile", f"WITH d AS (SELECT doc_id, source, text FROM documents), {LABELS_SQL} SELECT document_type, content_type, source_quality, count(*) AS n FROM q GROUP BY 1, 2, 3")
def _(spark, folder):
    return L.labelled(documents(spark, folder)).groupBy("document_type", "content_type", "source_quality").agg(F.count("*").alias("n"))


@query("embedding_texts", f"WITH d AS (SELECT doc_id, source, text FROM documents), {LABELS_SQL} SELECT doc_id, 'tipo de documento: ' || document_type || '; tipo de conteudo: ' || content_type || '; tema: ' || topic || '; secao: ' || section || '.' || chr(10) || text AS embedding_text FROM q")
def _(spark, folder):
    return L.labelled(documents(spark, folder)).select("doc_id", T.embedding_text(*(F.col(c) for c in ("document_type", "content_type", "topic", "section", "text"))).alias("embedding_text"))


TURNS = f"WITH t AS (SELECT conv_id, turn, text, {norm_sql('text')} AS n FROM conversations WHERE role = 'user')"


@query("query_profile", TURNS + f" SELECT conv_id, turn, {FLAGS_SQL} FROM t")
def _(spark, folder):
    t = table(spark, folder, "conversations").where("role = 'user'")
    t = t.withColumn("n", T.normalize(F.col("text")))
    return t.select("conv_id", "turn", *(v.alias(k) for k, v in L.profile(F.col("n")).items()))


def variants_sql() -> str:
    focus = ", ".join(f"CASE WHEN {flag} THEN {lit(V.FOCUS[k])} END" for k, flag in (("scalp", "has_scalp_inflammation"), ("hair", "has_hair_pattern"), ("medication", "has_medication"), ("labs", "has_labs")))
    q = "trim(text)"
    return TURNS + f""", f AS (SELECT *, {FLAGS_SQL} FROM t), v AS (SELECT conv_id, turn, 1 AS o, {q} AS variant FROM f
UNION ALL SELECT conv_id, turn, 2, concat_ws('; ', {focus}) FROM f WHERE has_scalp_inflammation OR has_hair_pattern OR has_medication OR has_labs
UNION ALL SELECT conv_id, turn, 3, {q} || {lit(V.ADVERSE_VARIANT)} FROM f WHERE asks_procedure AND has_adverse_event
UNION ALL SELECT conv_id, turn, 4, {q} || {lit(V.INVESTIGATION_VARIANT)} FROM f
UNION ALL SELECT conv_id, turn, 5, {q} || {lit(V.CRITERIA_VARIANT)} FROM f WHERE asks_treatment OR asks_procedure),
k AS (SELECT *, {norm_sql("variant")} AS key FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, key ORDER BY o) AS seen FROM k WHERE key <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS place FROM g WHERE seen = 1) SELECT conv_id, turn, place, variant FROM r WHERE place <= 4"""


@query("query_variants", variants_sql())
def _(spark, folder):
    t = table(spark, folder, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", F.posexplode(L.query_variants(F.col("text"), CONFIG.max_query_variants)).alias("place", "variant")).withColumn("place", (F.col("place") + 1).cast("long"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document for every question, with the length-free similarity 1 / (1 + doc_id mod 7)."""
    d = documents(spark, folder).select("doc_id", "source", "text", (1 / (1 + F.pmod("doc_id", F.lit(7)))).alias("similarity"))
    asked = F.array(*(F.struct(F.lit(i).cast("long").alias("question_id"), F.lit(q).alias("question"), *(v.alias(k) for k, v in L.of_question(F.lit(q)).items())) for i, q in QUESTIONS))
    return L.scored(L.with_texts(L.labelled(d, keep=True)).select("*", F.inline(asked)), labels=True)


ASKED_SQL = " UNION ALL ".join(f"SELECT {i}::BIGINT AS question_id, {lit(q)} AS question" for i, q in QUESTIONS)


def scored_sql() -> str:
    step = lambda c, d: f"+ CASE WHEN {c} THEN {d} ELSE 0 END"
    covered = f"(content_type = 'adverse_event' OR {any_sql('f', V.ADVERSE_EVENT)})"
    rules = [
        ("high", "source_quality = 'high'", "0.06::DOUBLE"), ("low", "source_quality = 'low'", "-0.10::DOUBLE"),
        ("assessment", "content_type = 'assessment'", "CASE WHEN asks_treatment THEN 0.03::DOUBLE ELSE 0.07::DOUBLE END"), ("diagnosis", "content_type = 'diagnosis'", "0.05::DOUBLE"),
        ("treatment", "content_type = 'treatment' AND NOT asks_treatment", "-0.13::DOUBLE"), ("procedure", "content_type = 'procedure' AND NOT asks_procedure", "-0.22::DOUBLE"),
        ("adverse_event", "content_type = 'adverse_event' AND NOT asks_procedure", "-0.18::DOUBLE"), ("case_general", "document_type = 'clinical_case' AND content_type = 'general'", "-0.05::DOUBLE"),
        ("protocol", "document_type = 'procedure_protocol' AND NOT asks_procedure", "-0.12::DOUBLE"), ("case_plan", "document_type = 'clinical_case' AND content_type IN ('treatment', 'procedure')", "-0.18::DOUBLE"),
        ("case_rejected", "document_type = 'clinical_case' AND content_type IN ('treatment', 'procedure') AND NOT asks_treatment AND NOT asks_procedure", None),
        ("scalp", f"has_scalp_inflammation AND {any_sql('f', V.SCALP)}", "0.08::DOUBLE"), ("hair", f"has_hair_pattern AND {any_sql('f', V.HAIR)}", "0.06::DOUBLE"),
        ("medication", f"has_medication AND {any_sql('f', V.MEDICATION)}", "0.05::DOUBLE"), ("labs", f"has_labs AND {any_sql('f', V.LABS)}", "0.04::DOUBLE"),
        ("procedure_asked", "asks_procedure AND content_type IN ('procedure', 'adverse_event')", "0.10::DOUBLE"), ("adverse_covered", f"asks_procedure AND has_adverse_event AND {covered}", "0.16::DOUBLE"),
        ("adverse_missed", f"asks_procedure AND has_adverse_event AND NOT {covered} AND content_type = 'procedure'", "-0.04::DOUBLE"), ("adverse_source", f"asks_procedure AND has_adverse_event AND {any_sql('s', V.PENALISED_SOURCES)}", "-0.08::DOUBLE"),
    ]
    why = ", ".join(f"CASE WHEN {c} THEN {lit(V.REASONS[k])} END" for k, c, _ in [("coverage", "cov >= 0.45", None), ("consent", "document_type = 'consent_form' AND NOT asks_consent", None), *rules])
    return f"""WITH d AS (SELECT doc_id, source, text, (1 / (1 + doc_id % 7))::DOUBLE AS sim FROM documents), {LABELS_SQL}, a AS ({ASKED_SQL}),
b AS (SELECT *, {FLAGS_SQL} FROM (SELECT *, {norm_sql("question")} AS n FROM a)), asked AS ({tokens_sql("b", "question_id", "n")}), an AS (SELECT question_id, count(*) AS total FROM asked GROUP BY 1),
dt AS ({tokens_sql("q", "doc_id", norm_sql("source || ' ' || text"))}), m AS (SELECT question_id, doc_id, count(*) AS k FROM asked JOIN dt USING (w) GROUP BY 1, 2),
x AS (SELECT q.*, b.* EXCLUDE (n, question), coalesce(m.k, 0) / an.total AS cov FROM q CROSS JOIN b JOIN an USING (question_id) LEFT JOIN m USING (question_id, doc_id)),
z AS (SELECT question_id, doc_id, source, sim, round(sim + least(0.12::DOUBLE, cov * 0.14::DOUBLE) {" ".join(step(c, d) for _, c, d in rules if d)}, 6) AS adjusted_score, round(cov, 6) AS lexical_coverage,
((document_type = 'consent_form' AND NOT asks_consent) OR (document_type = 'clinical_case' AND content_type IN ('treatment', 'procedure') AND NOT asks_treatment AND NOT asks_procedure)) AS rejected,
concat_ws('; ', {why}) AS reasons FROM x)"""


@query("score_candidates", scored_sql() + " SELECT question_id, doc_id, adjusted_score, lexical_coverage, rejected, reasons FROM z")
def _(spark, folder):
    return candidates(spark, folder).select("question_id", "doc_id", "adjusted_score", "lexical_coverage", "rejected", F.array_join("reasons", "; ").alias("reasons"))


def ranked(spark: SparkSession, folder: str) -> DataFrame:
    found = candidates(spark, folder)
    best = Window.partitionBy("question_id").orderBy(F.desc("adjusted_score"), F.desc("similarity"), "doc_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= CONFIG.candidates * CONFIG.max_query_variants)


@query("source_cap_topk", scored_sql() + ", c AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY adjusted_score DESC, sim DESC, doc_id) AS n FROM z WHERE NOT rejected AND adjusted_score >= 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY adjusted_score DESC, sim DESC, doc_id) AS place FROM c WHERE n <= 1) SELECT question_id, place::INT AS place, doc_id, source, adjusted_score FROM r WHERE place <= 4")
def _(spark, folder):
    # Rows that fail come last within their source instead of going first: a filter would be pushed below the scores and compute them twice.
    fails = F.col("rejected") | (F.col("adjusted_score") < CONFIG.min_rerank_score)
    order = (F.desc("adjusted_score"), F.desc("similarity"), "doc_id")
    rows = candidates(spark, folder).withColumn("fails", fails)
    capped = rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "source").orderBy("fails", *order)))
    capped = capped.where(~F.col("fails") & (F.col("n") <= CONFIG.max_results_per_source))
    return capped.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("place") <= CONFIG.top_k).select("question_id", "place", "doc_id", "source", "adjusted_score")


ORDERED = "row_number() OVER (PARTITION BY question_id ORDER BY adjusted_score DESC, sim DESC, doc_id)"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


GREEDY_SQL = f""", r AS (SELECT *, {ORDERED} AS place FROM z), t AS (SELECT DISTINCT doc_id FROM r WHERE place <= 128),
ws AS (SELECT doc_id, string_split(f, ' ') AS w FROM q JOIN t USING (doc_id) WHERE f <> ''),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM ws)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), pm AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
tw AS (SELECT a, list(b) AS twins FROM pm JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE greatest(pm.n / (ka.n + kb.n - pm.n), pm.n / least(ka.n, kb.n)) >= 0.86 GROUP BY a),
e AS (SELECT r.*, coalesce(twins, []) AS twins FROM r LEFT JOIN tw ON a = doc_id WHERE place <= 128),
v AS (SELECT DISTINCT question_id, 0::BIGINT AS place, []::BIGINT[] AS chosen, []::VARCHAR[] AS used, NULL::VARCHAR AS why, NULL::BIGINT AS twin FROM e
UNION ALL SELECT question_id, place, CASE WHEN why IS NULL THEN list_append(chosen, doc_id) ELSE chosen END, CASE WHEN why IS NULL THEN list_append(used, source) ELSE used END, why, CASE WHEN why = 'near_duplicate' THEN near[1] END FROM
(SELECT *, CASE WHEN rejected THEN 'policy' WHEN adjusted_score < 0.5 THEN 'score' WHEN list_contains(used, source) THEN 'source_cap' WHEN len(near) > 0 THEN 'near_duplicate' END AS why FROM
(SELECT e.question_id, e.place, v.chosen, v.used, e.doc_id, e.source, e.rejected, e.adjusted_score, list_filter(v.chosen, lambda x: list_contains(e.twins, x)) AS near FROM v JOIN e ON e.question_id = v.question_id AND e.place = v.place + 1 WHERE len(v.chosen) < 4)))"""


@query("greedy_select", recursive(scored_sql()) + GREEDY_SQL + """ SELECT question_id, doc_id::VARCHAR AS chunk_id, source, place::INT AS place, why IS NULL AS selected, why AS discard_reason, adjusted_score, twin::VARCHAR AS duplicate_of FROM v JOIN e USING (question_id, place)""")
def _(spark, folder):
    own = F.col("doc_id").cast("string")
    found = ranked(spark, folder).withColumns({"chunk_id": own, "window_ids": F.array(own), "window_text": F.col("text"), "window_score": F.col("adjusted_score"), "window_rejected": F.col("rejected")})
    return selection.select(found, CONFIG)


def escape_sql(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


@query("context_budget", recursive(scored_sql()) + f""", r AS (SELECT question_id, doc_id, {ORDERED} AS place FROM z),
bl AS (SELECT question_id, place, length('<trecho id="' || place || '" fonte="' || {escape_sql("source")} || '" paginas="' || doc_id || '" tipo_documento="' || document_type || '" tipo_conteudo="' || content_type || '" tema="' || topic || '" qualidade_fonte="' || source_quality || '">' || chr(10) || text || chr(10) || '</trecho>') AS n FROM r JOIN q USING (doc_id) WHERE place <= 128),
v AS (SELECT DISTINCT question_id, 0::BIGINT AS place, 0::BIGINT AS total, []::BIGINT[] AS kept FROM bl
UNION ALL SELECT question_id, place, CASE WHEN fits THEN total + n ELSE total END, CASE WHEN fits THEN list_append(kept, place) ELSE kept END FROM (SELECT *, len(kept) = 0 OR total + n <= 10000 AS fits FROM
(SELECT v.question_id, bl.place, total, kept, CASE WHEN len(kept) = 0 AND n > 10000 THEN 10000 - 120 + {len(V.TRUNCATED)} ELSE n END AS n FROM v JOIN bl ON bl.question_id = v.question_id AND bl.place = v.place + 1)))
SELECT question_id, (total + 2 * (len(kept) - 1))::INT AS n_chars, array_to_string(kept, ',') AS places FROM v QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY place DESC) = 1""")
def _(spark, folder):
    span = F.col("doc_id").cast("string")
    rows = ranked(spark, folder)
    block = selection.block(F.col("place"), F.col("source"), span, *(F.col(c) for c in ("document_type", "content_type", "topic", "source_quality", "text")))
    return selection.contexts(rows.select("question_id", "place", block.alias("block")), CONFIG).select("question_id", F.length("context").alias("n_chars"), F.array_join("places", ",").alias("places"))


def eval_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(i), ["erin", "xyz"], ["src7"], ["procedure"]) for i, _ in QUESTIONS], "name string, expected_any_terms array<string>, forbidden_source_terms array<string>, forbidden_content_types array<string>")


@query("eval_cases", scored_sql() + f""", r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY adjusted_score DESC, sim DESC, doc_id) AS place FROM z), t AS (SELECT r.question_id, q.source, content_type, {norm_sql("q.source || ' ' || q.text")} AS body FROM r JOIN q USING (doc_id) WHERE place <= 4)
SELECT *, has_expected AND NOT has_forbidden_source AND forbidden_types_found = '' AS passed FROM (SELECT question_id, CASE WHEN bool_or(content_type = 'procedure') THEN 'procedure' ELSE '' END AS forbidden_types_found, count(*) AS n, bool_or(contains(body, 'erin') OR contains(body, 'xyz')) AS has_expected, bool_or(contains({norm_sql("source")}, 'src7')) AS has_forbidden_source FROM t GROUP BY question_id)""")
def _(spark, folder):
    rows = ranked(spark, folder).where(F.col("place") <= CONFIG.top_k).withColumn("name", F.col("question_id").cast("string"))
    return retrieve.evaluated(eval_cases(spark), rows).select(F.col("name").cast("long").alias("question_id"), "n", "has_expected", "has_forbidden_source", "forbidden_types_found", "passed")


# --- retrieval end to end: passages of `benchmark` ask an index of documents, by vectors of hashed words

VECTOR = 64


def crc32_sql(c: str) -> str:
    """CRC-32 of ASCII text, with the table crc."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({c}) + 1), lambda i: ascii({c}[i])::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"


def hits_of_questions(phrases: str, floor: float) -> str:
    """hits: of each question the best documents over its phrases (question_id, variant, phrase), with their scores z."""
    vectors = f"""bits AS (SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256))::BIGINT AS i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8), phrases AS ({phrases}),
said AS (SELECT 'd' AS kind, doc_id AS id, 0::BIGINT AS variant, unnest(string_split(f, ' ')) AS w FROM q UNION ALL SELECT 'q', question_id, variant, unnest(string_split({norm_sql("phrase")}, ' ')) FROM phrases),
known AS (SELECT w, {crc32_sql("w")} AS h FROM (SELECT DISTINCT w FROM said WHERE w <> ''), crc),
part AS (SELECT kind, id, variant, h % {VECTOR} AS b, sum(CASE WHEN h >> 31 = 1 THEN 1 ELSE -1 END) AS v FROM said JOIN known USING (w) GROUP BY ALL),
size AS (SELECT kind, id, variant, sqrt(sum(v * v)) AS size FROM part GROUP BY ALL),
sims AS (SELECT a.id AS question_id, a.variant, b.id AS doc_id, round(sum(a.v * b.v) / (any_value(na.size) * any_value(nb.size)), 12)::DOUBLE AS sim FROM part a JOIN part b ON a.b = b.b AND a.kind = 'q' AND b.kind = 'd' JOIN size na ON na.kind = 'q' AND na.id = a.id AND na.variant = a.variant JOIN size nb ON nb.kind = 'd' AND nb.id = b.id WHERE na.size > 0 AND nb.size > 0 GROUP BY 1, 2, 3),
near AS (SELECT *, row_number() OVER (PARTITION BY question_id, variant ORDER BY sim DESC, doc_id::VARCHAR) AS rank FROM sims),
hits AS (SELECT * FROM near WHERE rank <= {CONFIG.candidates} AND sim >= {floor} QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY sim DESC, variant, rank) = 1)"""
    sql = scored_sql().replace(", (1 / (1 + doc_id % 7))::DOUBLE AS sim", "").replace(ASKED_SQL, "SELECT item_id AS question_id, text AS question FROM benchmark")
    sql = sql.replace("x AS (SELECT q.*, b.* EXCLUDE (n, question),", f"{vectors}, x AS (SELECT q.*, b.* EXCLUDE (n, question), sim, variant, rank,")
    sql = sql.replace("FROM q CROSS JOIN b JOIN an USING (question_id)", "FROM hits JOIN q USING (doc_id) JOIN b USING (question_id) JOIN an USING (question_id)")
    return recursive(sql.replace("z AS (SELECT question_id, doc_id, source, sim,", "z AS (SELECT question_id, doc_id, source, sim, variant, rank,"))


PHRASES = variants_sql().replace(TURNS, f"WITH t AS (SELECT item_id AS question_id, text, {norm_sql('text')} AS n FROM benchmark)").replace("conv_id, turn, place, variant FROM r", "question_id, place - 1 AS variant, variant AS phrase FROM r").replace("conv_id, turn", "question_id")
BEST_FIRST = "row_number() OVER (PARTITION BY question_id ORDER BY adjusted_score DESC, sim DESC, variant, rank, doc_id::VARCHAR)"


def asked_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, HashingEmbedder, Callable]:
    """Questions, the published index of documents, its model and its search."""
    model, path = HashingEmbedder(VECTOR), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    d = L.labelled(documents(spark, folder)).withColumns({"chunk_id": F.col("doc_id").cast("string"), "document_id": F.col("source"), "doc_pos": F.col("doc_id"), "page_start": F.col("doc_id"), "page_end": F.col("doc_id")})
    meta = index.publish(embedded(d.drop("lang", "n_chars", "doc_id"), model), path, write=clustered.write, embedding_model=model.name)
    built = index.load(spark, path, model=model.name).drop("list", "_cosine")
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return asked, built, model, clustered.searcher(spark, path, meta, key="chunk_id", exact=True)


@query("retrieve_plain", hits_of_questions("SELECT item_id AS question_id, 0::BIGINT AS variant, trim(text) AS phrase FROM benchmark", -1.0) + f", r AS (SELECT *, {BEST_FIRST} AS place FROM z WHERE NOT rejected) SELECT question_id, doc_id::VARCHAR AS chunk_id, place::INT AS place, rank::INT AS rank, round(sim, 6) AS similarity, adjusted_score FROM r WHERE place <= {CONFIG.top_k}")
def _(spark, folder):
    asked, built, model, search = asked_index(spark, folder)
    found = retrieve.retrieve_plain(asked, built, model, CONFIG, search=search)
    return found.select("question_id", "chunk_id", "place", "rank", F.round("similarity", 6).alias("similarity"), "adjusted_score")


@query("retrieve_candidates", hits_of_questions(PHRASES, CONFIG.similarity_floor) + f" SELECT question_id, doc_id::VARCHAR AS chunk_id, {BEST_FIRST}::INT AS place, variant::INT AS variant, rank::INT AS rank, round(sim, 6) AS similarity, adjusted_score, lexical_coverage, rejected FROM z")
def _(spark, folder):
    asked, built, model, search = asked_index(spark, folder)
    found = retrieve.candidates(asked, built, model, CONFIG, search=search)
    return found.select("question_id", "chunk_id", "place", "variant", "rank", F.round("similarity", 6).alias("similarity"), "adjusted_score", "lexical_coverage", "rejected")


@query("retrieve_passages", hits_of_questions(PHRASES, CONFIG.similarity_floor) + GREEDY_SQL.replace(ORDERED, BEST_FIRST) + " SELECT question_id, doc_id::VARCHAR AS chunk_id, source, place::INT AS place, round(sim, 3) AS similarity, round(adjusted_score, 3) AS score FROM v JOIN e USING (question_id, place) WHERE why IS NULL")
def _(spark, folder):
    asked, built, model, search = asked_index(spark, folder)
    return retrieve.retrieve(asked, built, model, CONFIG, search=search).select("question_id", "chunk_id", "source", "place", "similarity", "score")


@query("unused_windows", """WITH RECURSIVE c AS (SELECT doc_id // 100 AS question_id, doc_id, n_chars % 5 = 0 AS rejected, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
v AS (SELECT DISTINCT question_id, 0::BIGINT AS rank, []::BIGINT[] AS used, NULL::BIGINT AS kept FROM c UNION ALL SELECT question_id, rank, CASE WHEN ok THEN list_concat(used, w) ELSE used END, CASE WHEN ok THEN doc_id END FROM
(SELECT c.*, used, [doc_id - 4, doc_id, doc_id + 4] AS w, NOT rejected AND NOT list_has_any(used, [doc_id - 4, doc_id, doc_id + 4]) AS ok FROM v JOIN c ON c.question_id = v.question_id AND c.rank = v.rank + 1))
SELECT question_id, kept::VARCHAR AS chunk_id FROM v WHERE kept IS NOT NULL""")
def _(spark, folder):
    d, i = table(spark, folder, "documents"), F.col("doc_id")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n_chars"), "doc_id"))
    window = F.array((i - 4).cast("string"), i.cast("string"), (i + 4).cast("string"))
    # a question has a hundred candidates, about as many as retrieval gives it
    rows = d.select(F.floor(i / 100).alias("question_id"), "doc_id", "n_chars").withColumn("rank", rank)
    return selection.unused_windows(rows.select("question_id", i.cast("string").alias("chunk_id"), "rank", window.alias("window_ids"), (F.col("n_chars") % 5 == 0).alias("window_rejected")))


# --- paged documents


def paged(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")


SIGNATURE = f"regexp_replace(lower({collapse_sql('line')}), '\\b\\d{{1,4}}\\b', '<n>', 'g')"
REPEATED = f"""WITH x AS (SELECT source AS document, doc_id AS page, unnest({lines_sql("text")}) AS raw, unnest(range(1, len({lines_sql("text")}) + 1)) AS pos FROM documents),
y AS (SELECT document, page, trim(raw, ' ' || chr(9) || chr(13)) AS line, pos FROM x), l AS (SELECT *, row_number() OVER (PARTITION BY document, page ORDER BY pos) AS a, row_number() OVER (PARTITION BY document, page ORDER BY pos DESC) AS z FROM y WHERE line <> ''),
b AS (SELECT DISTINCT document, page, line FROM l WHERE (a <= 4 OR z <= 4) AND length(line) BETWEEN 15 AND 220),
g AS (SELECT document, {SIGNATURE} AS signature, count(*) AS pages FROM b GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("repeated_lines", REPEATED + " SELECT document, signature, pages FROM g")
def _(spark, folder):
    return pages.repeated_lines(paged(spark, folder), CONFIG)


@query("line_cleanup", REPEATED + f", m AS (SELECT l.document, l.page, l.line, l.pos, g.signature IS NOT NULL AS gone FROM l LEFT JOIN g ON g.document = l.document AND length(line) BETWEEN 15 AND 220 AND g.signature = {SIGNATURE}) SELECT d.source AS document, d.doc_id AS page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed FROM documents d LEFT JOIN m ON m.document = d.source AND m.page = d.doc_id GROUP BY 1, 2")
def _(spark, folder):
    p = paged(spark, folder)
    return pages.without_repeated_lines(p, pages.repeated_lines(p, CONFIG), CONFIG)


def re2(pattern: str) -> str:
    """A cleaning pattern for DuckDB: white space and digits spelled out, what only looks ahead as a last group."""
    flags = re.match(r"\(\?(\w+)\)", pattern)
    if flags:
        kept = "".join(x for x in flags[1] if x in "ims")
        pattern = (f"(?{kept})" if kept else "") + pattern[flags.end() :]
    pattern = re.sub(r"\(\?=(.*)\)$", r"(\1)", pattern, flags=re.S)
    return pattern.replace("\\s", r"[\t-\r\x{85}\pZ]").replace("\\d", r"\p{Nd}")


def cleaned_sql(c: str) -> str:
    for p in V.BOILERPLATE:
        c = f"regexp_replace({c}, {lit(re2('(?is)' + p))}, ' ', 'g')"
    for p, to in V.CLEANING:
        to = to.replace("$", "\\") + ("\\1" if "(?=" in p else "")
        c = f"regexp_replace({c}, {lit(re2(p))}, {lit(to)}, 'g')"
    return f"regexp_replace({c}, {lit(re2(r'^\s+|\s+$'))}, '', 'g')"


@query("clean_pages", f"SELECT doc_id, {cleaned_sql('text')} AS text FROM documents")
def _(spark, folder):
    return documents(spark, folder).select("doc_id", pages.cleaned(F.col("text")).alias("text"))


@query("hyphen_lookahead", "WITH h AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'x-' ELSE lower(text) END AS t FROM documents), n AS (SELECT *, lead(t) OVER w AS following, lag(t) OVER w AS previous FROM h WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT doc_id AS page, length(t) - CASE WHEN regexp_matches(t, '[A-Za-zÀ-ÖØ-öø-ÿ]-$') AND regexp_matches(following, '^[a-zà-öø-ÿ]') THEN 1 ELSE 0 END AS n_chars, coalesce(regexp_matches(previous, '[A-Za-zÀ-ÖØ-öø-ÿ]-$') AND regexp_matches(t, '^[a-zà-öø-ÿ]'), false) AS no_space_before FROM n")
def _(spark, folder):
    p = paged(spark, folder).withColumn("text", F.when(F.col("page") % 3 == 0, F.concat("text", F.lit("x-"))).otherwise(F.lower("text")))
    return pages.joined_hyphens(p).select("page", F.length("text").cast("long").alias("n_chars"), "no_space_before")


OFFSETS = "WITH o AS (SELECT source AS document, doc_id AS page, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id) - 1 AS stop FROM documents), s AS (SELECT document, page, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM o)"


def spans(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")  # only lengths leave the scan
    return pages.offsets(p.withColumn("no_space_before", F.lit(False)))


@query("running_offsets", OFFSETS + " SELECT document, page, start, stop FROM s")
def _(spark, folder):
    return spans(spark, folder).select("document", "page", "start", "stop")


@query("interval_overlap", OFFSETS + ", e AS (SELECT document, max(stop) AS total FROM s GROUP BY 1), u AS (SELECT document, unnest(range(0, total + 2100, 700)) AS start FROM e), m AS (SELECT u.document, (u.start // 700)::BIGINT AS unit, min(page) AS page_start, max(page) AS page_end FROM u JOIN s ON s.document = u.document AND u.start < s.stop AND u.start + 650 > s.start GROUP BY 1, 2) SELECT u.document, (u.start // 700)::BIGINT AS unit, coalesce(m.page_start, l.page) AS page_start, coalesce(m.page_end, l.page) AS page_end FROM u LEFT JOIN m ON m.document = u.document AND m.unit = u.start // 700 JOIN (SELECT document, arg_max(page, stop) AS page FROM s GROUP BY 1) l ON l.document = u.document")
def _(spark, folder):
    s = kept(spans(spark, folder).select("document", "page", "start", "stop"))  # four steps read them
    u = s.groupBy("document").agg(F.max("stop").alias("total")).select("document", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") + 2099, F.lit(700).cast("long"))).alias("start"))
    return pages.overlapping_pages(u.select("document", F.expr("start div 700").alias("unit"), "start", (F.col("start") + 650).alias("stop")), s)


@query("page_ranges", "WITH r AS (SELECT source, doc_id AS page_start, doc_id + n_chars // 2000 AS page_end FROM documents), m AS (SELECT *, max(page_end) OVER (PARTITION BY source ORDER BY page_start, page_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r), i AS (SELECT *, sum(CASE WHEN before IS NULL OR page_start > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page_start, page_end ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT source, island, min(page_start) AS a, max(page_end) AS b FROM i GROUP BY 1, 2) SELECT source, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS pages, count(*) AS n_ranges FROM g GROUP BY source")
def _(spark, folder):
    r = documents(spark, folder).select("source", F.col("doc_id").alias("page_start"), (F.col("doc_id") + F.expr("n_chars div 2000")).alias("page_end"))
    return pages.page_ranges(r, "source")


@query("chunk_positions", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_pos FROM documents")
def _(spark, folder):
    return pages.positions(documents(spark, folder), document="source", order="doc_id").select("doc_id", F.col("doc_pos").cast("long").alias("doc_pos"))


@query("neighbor_window", "WITH p AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents) SELECT c.doc_id AS centre_id, count(*) AS n, string_agg(d.doc_id::VARCHAR, ',' ORDER BY d.pos) AS ids FROM p c JOIN p d ON c.source = d.source AND d.pos BETWEEN c.pos - 2 AND c.pos + 2 AND (c.doc_id = d.doc_id OR c.lang = d.lang) GROUP BY c.doc_id")
def _(spark, folder):
    p = pages.positions(documents(spark, folder), document="source", order="doc_id")
    p = p.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "doc_pos", F.col("lang").alias("section"), F.lit("general").alias("content_type"))
    near = pages.neighbours(p, p, 2)
    return near.groupBy("centre_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_pos", "chunk_id"))), lambda x: x.chunk_id.cast("string")), ",").alias("ids"))


@query("skip_and_empty_pages", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'madri2020.pdf' ELSE source END AS document, count(*) AS pages, count(*) FILTER (WHERE trim(text) = '') AS empty FROM documents WHERE doc_id > CASE WHEN doc_id % 5 = 0 THEN 15 ELSE 0 END GROUP BY 1")
def _(spark, folder):
    p = documents(spark, folder).withColumn("document", F.when(F.col("doc_id") % 5 == 0, "madri2020.pdf").otherwise(F.col("source")))
    return p.where(F.col("doc_id") > pages.skipped_pages(F.col("document"))).groupBy("document").agg(F.count("*").alias("pages"), F.count_if(F.trim("text") == "").alias("empty"))


@query("length_audit", "SELECT count(*) AS n_chunks, min(n_chars) AS shortest, max(n_chars) AS longest, count(*) FILTER (WHERE n_chars > 1200) AS over_limit, count(*) FILTER (WHERE n_chars < 250) AS short, (SELECT n_chars FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS r FROM documents) WHERE r = (SELECT count(*) // 2 + 1 FROM documents)) AS median FROM documents")
def _(spark, folder):
    return chunking.audit(documents(spark, folder), CONFIG, length="n_chars")


# --- chunks. SQL walks a document's units one after the other; MASK stands for a dot that ends no sentence, CUT for an end.

MASK, CUT, WORD_START = "chr(57345)", "chr(1)", r"(^|[^\pL\pN_])"


def masked_sql(c: str) -> str:
    """Dots of abbreviations, numbers and initials masked. What looks around matches too, so rules that may meet are used twice."""
    dot = lambda c, p, to: f"regexp_replace({c}, {lit(p)}, {to}, 'g')"
    for a in sorted(V.ABBREVIATIONS, key=len, reverse=True):
        c = dot(c, f"(?i){WORD_START}({re.escape(a[:-1])})\\.", f"'\\1\\2' || {MASK}")
    for _ in range(2):
        c = dot(c, r"(\p{Nd})\.(\p{Nd})", f"'\\1' || {MASK} || '\\2'")
    c = dot(c, r"(?i)\b(et al)\.(\s*[,;(]|\s*\d{4})", f"'\\1' || {MASK} || '\\2'")
    for _ in range(2):
        c = dot(c, WORD_START + r"([A-Z])\.(\s*[A-ZÀ-ÖØ-Þ])", f"'\\1\\2' || {MASK} || '\\3'")
    return c


def cut_sql(rest: str) -> str:
    """Where a long unit is cut: behind the last of the best separator in its first max_unit_chars that leaves enough."""
    most, window = CONFIG.max_unit_chars, f"left({rest}, {CONFIG.max_unit_chars})"
    at = lambda x: f"({most} - strpos(reverse({window}), {lit(x[::-1])}) + 1 - {len(x)})"
    cuts = [f"WHEN strpos(reverse({window}), {lit(x[::-1])}) > 0 AND {at(x)} >= {int(most * CONFIG.cut_ratio)} THEN {at(x)} + {len(x.rstrip())}" for x in V.CUT_AT]
    return f"CASE WHEN length({rest}) <= {most} THEN length({rest}) {' '.join(cuts)} ELSE {most} END"


BLANKS = "' ' || chr(10) || chr(9) || chr(13)"
UNITS_SQL = rf"""whole AS (SELECT document, string_agg(gap || text, '' ORDER BY page) AS text FROM gaps GROUP BY document),
spans AS (SELECT document, page, (sum(length(gap || text)) OVER (PARTITION BY document ORDER BY page) - length(text))::BIGINT AS start, (sum(length(gap || text)) OVER (PARTITION BY document ORDER BY page))::BIGINT AS stop FROM gaps),
marked AS (SELECT document, regexp_replace(regexp_replace({masked_sql("text")}, '([.!?]["”’)\]]*)(\s)', '\1' || {CUT} || '\2', 'g'), '\n\n', {CUT} || chr(10) || chr(10), 'g') AS text FROM whole),
parts AS (SELECT document, unnest(string_split(text, {CUT})) AS t, unnest(range(len(string_split(text, {CUT})))) AS k FROM marked),
placed AS (SELECT document, replace(t, {MASK}, '.') AS t, (coalesce(sum(length(t)) OVER (PARTITION BY document ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(t) - length(ltrim(t, {BLANKS})))::BIGINT AS start FROM parts),
sentence AS (SELECT document, start, trim(t, {BLANKS}) AS t FROM placed WHERE trim(t, {BLANKS}) <> ''),
piece AS (SELECT document, start, t AS rest, NULL::VARCHAR AS text, 0::BIGINT AS own FROM sentence WHERE length(t) > {CONFIG.max_unit_chars}
UNION ALL SELECT document, start + cut + length(substr(rest, cut + 1)) - length(ltrim(substr(rest, cut + 1), {BLANKS})), ltrim(substr(rest, cut + 1), {BLANKS}), rtrim(left(rest, cut), {BLANKS}), start FROM (SELECT *, ({cut_sql("rest")})::BIGINT AS cut FROM piece WHERE rest <> '')),
unit AS (SELECT document, start, t AS text, false AS forced FROM sentence WHERE length(t) <= {CONFIG.max_unit_chars} UNION ALL SELECT document, own, text, true FROM piece WHERE text IS NOT NULL),
paged_unit AS (SELECT unit.document, unit.start, any_value(unit.text) AS text, any_value(forced) AS forced, min(page) AS low, max(page) AS high FROM unit JOIN spans ON spans.document = unit.document AND spans.start < unit.start + length(unit.text) AND spans.stop > unit.start GROUP BY 1, 2),
u AS MATERIALIZED (SELECT document, row_number() OVER w - 1 AS i, start, text, forced, low, high, length(text) AS len, sum(length(text) + 1) OVER w - length(text) - 1 AS upto, regexp_matches(text, {lit("^(?:[-•]\\s*)?" + V.SECTION_START.replace("\\s", "\\s"))}, 'i') AS heading FROM paged_unit WINDOW w AS (PARTITION BY document ORDER BY start))"""
MOST, OVERLAP = CONFIG.max_chars, CONFIG.overlap_chars
PACKED_SQL = f"""n AS MATERIALIZED (SELECT document, count(*) AS n FROM u GROUP BY document),
pack AS (SELECT document, -1::BIGINT AS c, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS first, 0::BIGINT AS fresh FROM n
UNION ALL SELECT t.document, t.c + 1, t.first, t.stop, CASE WHEN t.tail < t.stop AND after.upto + after.len - tailed.upto > {MOST} THEN t.stop ELSE t.tail END, t.stop FROM (
SELECT z.document, z.c, z.n, z.first, z.stop, CASE WHEN z.stop < z.n AND NOT any_value(here.heading) AND any_value(last.len) <= {max(OVERLAP, MOST // 2)} THEN least(greatest(z.stop - count(*) FILTER (back.upto >= here.upto - 1 - {OVERLAP}), z.first), z.stop - 1) ELSE z.stop END AS tail FROM (
SELECT p.document, p.c, p.first, n.n, least(greatest(p.first + count(*) FILTER (u.upto + u.len + 1 <= f.upto + {MOST} + 1), p.fresh + 1), coalesce(min(u.i) FILTER (u.heading AND u.i > p.fresh), n.n)) AS stop
FROM pack p JOIN n ON n.document = p.document JOIN u f ON f.document = p.document AND f.i = p.first JOIN u ON u.document = p.document AND u.i >= p.first AND u.i < p.first + {MOST} WHERE p.fresh < n.n GROUP BY p.document, p.c, p.first, p.fresh, n.n) z
LEFT JOIN u here ON here.document = z.document AND here.i = z.stop JOIN u last ON last.document = z.document AND last.i = z.stop - 1 JOIN u back ON back.document = z.document AND back.i < z.stop AND back.i >= z.stop - {MOST} GROUP BY z.document, z.c, z.n, z.first, z.stop) t
LEFT JOIN u after ON after.document = t.document AND after.i = t.stop LEFT JOIN u tailed ON tailed.document = t.document AND tailed.i = t.tail),
cut AS (SELECT pack.document, c AS chunk_no, string_agg(u.text, ' ' ORDER BY i) AS text, arg_min(low, i) AS page, min(low)::INT AS page_start, max(high)::INT AS page_end, bool_or(forced) AS forced_split FROM pack JOIN u ON u.document = pack.document AND i >= a AND i < b WHERE c >= 0 GROUP BY pack.document, c)"""
PAGES_SQL = REPEATED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", m AS (SELECT l.document, l.page, l.line, l.pos, g.signature IS NOT NULL AS gone FROM l LEFT JOIN g ON g.document = l.document AND length(line) BETWEEN 15 AND 220 AND g.signature = {SIGNATURE}),
kept AS (SELECT document, page, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text FROM m GROUP BY 1, 2),
clean AS (SELECT document, page, {cleaned_sql("text")} AS text FROM kept WHERE page > 0),
full_pages AS (SELECT * FROM clean WHERE text <> ''),
near AS (SELECT *, lead(text) OVER w AS following, lag(text) OVER w AS previous FROM full_pages WINDOW w AS (PARTITION BY document ORDER BY page)),
gaps AS (SELECT document, page, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ÿ]-$') AND regexp_matches(following, '^[a-zà-öø-ÿ]') THEN left(text, -1) ELSE text END AS text,
CASE WHEN previous IS NULL OR (regexp_matches(previous, '[A-Za-zÀ-ÖØ-öø-ÿ]-$') AND regexp_matches(text, '^[a-zà-öø-ÿ]')) THEN '' ELSE ' ' END AS gap FROM near)"""
RAW_PAGES_SQL = "WITH RECURSIVE gaps AS (SELECT source AS document, doc_id AS page, text, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 THEN '' ELSE ' ' END AS gap FROM documents)"
CHUNKED_SQL = f"""WITH d AS ({PAGES_SQL}, {UNITS_SQL}, {PACKED_SQL}, hashed AS (SELECT *, document AS source, regexp_replace(regexp_replace(lower(document), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS document_id, sha256(lower({collapse_sql("text")})) AS content_hash FROM cut)
SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY document_id, content_hash ORDER BY chunk_no) = 1),{LABELS_SQL}
SELECT document_id || '_' || printf('%05d', chunk_no) || '_' || left(content_hash, 10) AS chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_no) - 1 AS doc_pos, page_start, page_end, length(text)::INT AS char_count, content_hash, forced_split, document_type, content_type, section FROM q"""


@query("sentence_units", f"{RAW_PAGES_SQL}, {UNITS_SQL} SELECT document, start, len, low::INT AS page_low, high::INT AS page_high, heading, forced FROM u")
def _(spark, folder):
    """Units of raw texts, which have longer sentences and other white space than cleaned ones."""
    u = chunking.units(paged(spark, folder).withColumn("no_space_before", F.lit(False)), CONFIG)
    return u.select("document", "start", F.length("text").cast("long").alias("len"), "page_low", "page_high", "heading", "forced")


@query("packed_chunks", f"{RAW_PAGES_SQL}, {UNITS_SQL}, {PACKED_SQL} SELECT document, chunk_no, md5(text) AS text_md5, length(text)::INT AS char_count, page::INT AS page, page_start, page_end, forced_split FROM cut")
def _(spark, folder):
    raw = chunking.raw_chunks(paged(spark, folder).withColumn("no_space_before", F.lit(False)), CONFIG)
    return raw.select("document", "chunk_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), "char_count", "page", "page_start", "page_end", "forced_split")


@query("chunk_documents", CHUNKED_SQL)
def _(spark, folder):
    return ingest.chunked(paged(spark, folder), CONFIG).select("chunk_id", "document_id", "doc_pos", "page_start", "page_end", "char_count", "content_hash", "forced_split", "document_type", "content_type", "section")


@query("chunk_web_pages")
def _(spark, folder):
    return ingest.chunked(html_pages(table(spark, folder, "pages")), CONFIG).select("chunk_id", "source", "doc_pos", "page_start", "page_end", "char_count")


# --- answers and records


@query("citations", "WITH a AS (SELECT conv_id, turn, text || ' [' || turn || '] [3][' || conv_id % 4 || ']' AS t FROM conversations WHERE role = 'assistant'), c AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(t, '\\[(\\d+)\\]', 1))::INT AS n FROM a) SELECT conv_id, turn, string_agg(n::VARCHAR, ',' ORDER BY n) AS cited FROM c GROUP BY 1, 2")
def _(spark, folder):
    t = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] [3]["), (F.col("conv_id") % 4).cast("string"), F.lit("]"))
    return table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.array_join(A.citations(t), ",").alias("cited"))


ANSWER = "CASE conv_id % 5 WHEN 0 THEN text || ' [1]' WHEN 1 THEN text || ' [1][7] inicie 20 mg' WHEN 2 THEN 'Como prosseguir agora: observar. [2] ' || text WHEN 3 THEN text || ' portanto' ELSE text END"
ASKED = "CASE turn % 3 WHEN 0 THEN 'O que fazer?' WHEN 1 THEN 'Prurido após aplicação' ELSE text END"


def problems_sql() -> str:
    any_ = lambda c, terms: "(" + " OR ".join(f"contains({c}, {lit(t)})" for t in terms) + ")"
    unsafe = " OR ".join(f"regexp_matches(a, {lit('(?i)' + p)})" for p in V.UNSAFE)
    cut = " OR ".join(f"ends_with(n, {lit(e)})" for e in V.CUT_OFF_ENDS)
    return f"""WITH t AS (SELECT conv_id, turn, {ANSWER} AS a, {ASKED} AS q, (turn % 4)::INT AS k FROM conversations WHERE role = 'assistant'), u AS (SELECT *, {answer_sql("a")} AS n, {answer_sql("q")} AS m FROM t),
c AS (SELECT conv_id, turn, string_agg(x::VARCHAR, ', ' ORDER BY x) FILTER (WHERE x < 1 OR x > k) AS bad, count(*) AS cited FROM (SELECT DISTINCT conv_id, turn, k, unnest(regexp_extract_all(a, '\\[(\\d+)\\]', 1))::INT AS x FROM t) GROUP BY 1, 2),
v AS (SELECT u.*, bad, coalesce(cited, 0) AS cited, {any_("m", V.NEXT_STEP_QUESTION)} OR ({any_("m", V.CASE_PROCEDURES)} AND {any_("m", V.CASE_SYMPTOMS)}) AS plan FROM u LEFT JOIN c USING (conv_id, turn))
SELECT conv_id, turn, concat_ws('; ', CASE WHEN k > 0 AND cited = 0 THEN {lit(V.NO_CITATIONS)} END, CASE WHEN bad IS NOT NULL THEN {lit(V.BAD_CITATIONS)} || '[' || bad || ']' END, CASE WHEN {unsafe} THEN {lit(V.PRESCRIPTIVE)} END,
CASE WHEN plan AND NOT contains(n, {lit(V.PLAN_HEADING)}) THEN {lit(V.NO_PLAN)} END, CASE WHEN plan AND NOT {any_("n", V.ACTIONS)} THEN {lit(V.NO_ACTION)} END, CASE WHEN {cut} THEN {lit(V.CUT_OFF)} END) AS problems FROM v"""


@query("answer_problems", problems_sql())
def _(spark, folder):
    t = table(spark, folder, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr(ANSWER).alias("a"), F.expr(ASKED).alias("q"))
    return t.select("conv_id", "turn", F.array_join(A.problems(F.col("a"), (F.col("turn") % 4).cast("int"), F.col("q")), "; ").alias("problems"))


@query("answer_statuses", f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'vazio' WHEN conv_id % 7 = 0 THEN 'erro_indice' WHEN turn % 4 = 0 THEN 'sem_material' WHEN conv_id % 11 = 0 OR conv_id % 6 = 0 OR trim(text) = '' THEN 'erro_modelo' WHEN problems <> '' THEN 'resposta_bloqueada' ELSE 'ok' END AS status
FROM ({problems_sql()}) p JOIN conversations USING (conv_id, turn) WHERE role = 'assistant'""")
def _(spark, folder):
    t = table(spark, folder, "conversations").where("role = 'assistant'").withColumns({"a": F.expr(ANSWER), "q": F.expr(ASKED)})
    conv, turn = F.col("conv_id"), F.col("turn")
    t = t.withColumns({"sources": (turn % 4).cast("int"), "answer": F.when(conv % 6 != 0, F.col("a"))})
    t = t.withColumn("found", A.problems(F.coalesce("answer", F.lit("")), F.col("sources"), F.col("q")))
    return t.select("conv_id", "turn", A.status(F.when(turn % 5 == 0, " ").otherwise(F.col("q")), conv % 7 != 0, F.col("sources"), F.col("answer"), conv % 11 == 0, F.col("found")).alias("status"))


@query("answer_lines", "WITH x AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS raw, unnest(range(0, len(string_split(t, chr(10))))) AS line_no FROM (SELECT conv_id, turn, '### A' || chr(10) || '- ' || text || chr(10) || chr(10) || '### B' || chr(10) || text AS t FROM conversations WHERE role = 'assistant')), l AS (SELECT conv_id, turn, line_no, trim(raw) AS line FROM x WHERE trim(raw) <> '') SELECT conv_id, turn, line_no, sum(CASE WHEN starts_with(line, '### ') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY line_no)::BIGINT AS section, CASE WHEN starts_with(line, '### ') THEN 'section' WHEN starts_with(line, '- ') THEN 'bullet' ELSE 'text' END AS kind, regexp_replace(line, '^(### |- )', '') AS line FROM l")
def _(spark, folder):
    a = table(spark, folder, "conversations").where("role = 'assistant'").withColumn("text", F.concat(F.lit("### A\n- "), "text", F.lit("\n\n### B\n"), "text"))
    return store.answer_lines(a, ["conv_id", "turn"]).withColumns({"line_no": F.col("line_no").cast("long"), "section": F.col("section").cast("long")})


@query("redact_metadata", """SELECT event_id, '{"event": "' || event_type || '", "k": ' || (props->>'$.k') || ', "nested": {"Senha ": "[removido]", "n": 1}, "token": "[removido]"}' AS metadata FROM events""")
def _(spark, folder):
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{"token": "t", "nested": {"Senha ": "x", "n": 1}, "k": '), k, F.lit(', "event": "'), "event_type", F.lit('"}'))
    return table(spark, folder, "events").select("event_id", records.redacted(raw).alias("metadata"))


@query("audit_append", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"kept": "' || event_type || '"}' ELSE '{"event": "' || event_type || '", "k": ' || (props->>'$.k') || ', "password": "[removido]"}' END AS metadata_json FROM events""")
def _(spark, folder):
    e, odd = table(spark, folder, "events"), F.col("event_id") % 2 == 1
    log = e.where(~odd).select("event_id", F.concat(F.lit('{"kept": "'), "event_type", F.lit('"}')).alias("metadata_json"))
    return store.audited(log, e.where(odd).select("event_id", F.concat(F.lit('{"password": [1], "k": '), F.get_json_object("props", "$.k"), F.lit(', "event": "'), "event_type", F.lit('"}')).alias("metadata_json")))


LINES = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'dup' ELSE 'k' || doc_id END AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'same text' WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS text,
CASE WHEN doc_id % 10 = 0 THEN 'dup.pdf' ELSE source || '.pdf' END AS source, CASE WHEN doc_id % 10 <> 0 AND doc_id % 3 = 0 THEN CAST(doc_id AS INT) END AS page FROM documents"""


@query("jsonl_backfill", f"""WITH r AS ({LINES}), e AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'broken JSON' WHEN trim(text) = '' THEN 'no text or source' END AS error FROM r),
f AS (SELECT *, CASE WHEN error IS NULL AND chunk_id = 'dup' AND row_number() OVER (PARTITION BY chunk_id, error ORDER BY doc_id) > 1 THEN 'repeated chunk_id' ELSE error END AS why FROM e)
SELECT coalesce(why, 'none') AS error, CASE WHEN why IS NULL THEN lower(replace(source, '.pdf', '')) END AS document_id, count(*) AS n, sum(CASE WHEN why IS NULL THEN length(text) END)::BIGINT AS n_chars, sum(CASE WHEN why IS NULL THEN coalesce(page, 1) END)::BIGINT AS pages FROM f GROUP BY 1, 2""")
def _(spark, folder):
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    table(spark, folder, "documents").createOrReplaceTempView("documents")
    line = F.when(F.col("doc_id") % 13 == 0, "{broken").otherwise(F.to_json(F.struct("chunk_id", "text", "source", "page")))
    spark.sql(LINES).select(line.alias("value")).write.text(path)
    good, bad = checked(chunk_lines(spark, path))
    rows = backfilled(good).select(F.lit("none").alias("error"), "document_id", F.col("char_count").alias("n_chars"), F.col("page_start").alias("pages"))
    none = F.lit(None)
    rows = rows.unionByName(bad.select("error", none.cast("string").alias("document_id"), none.cast("int").alias("n_chars"), none.cast("int").alias("pages")))
    return rows.groupBy("error", "document_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum("pages").alias("pages"))


@query("publish_and_load", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, (SELECT count(*) FROM documents) AS published FROM documents GROUP BY source")
def _(spark, folder):
    path, d = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    first = index.publish(d, path, expected=d.count(), embedding_model="m")
    index.publish(d.where("doc_id % 2 = 0"), path, embedding_model="m")
    index.roll_back(spark, path)
    return index.load(spark, path, model="m").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars")).withColumn("published", F.lit(first["rows"]).cast("long"))


@query("index_health", "SELECT count(*) > 0 AS ready, count(*) AS rows, 'm' AS embedding_model FROM documents")
def _(spark, folder):
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.publish(table(spark, folder, "documents").select("doc_id", "source"), path, embedding_model="m")
    return index.health(spark, path).select("ready", "rows", "embedding_model")


@query("jsonl_written", f"SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, md5(text) AS text_md5, doc_id::INT AS page, doc_id % 2 = 0 AS forced_split FROM documents WHERE {collapse_sql('text')} <> ''")
def _(spark, folder):
    """Chunk records written as JSON lines and read back."""
    path, i = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}", F.col("doc_id")
    rows = table(spark, folder, "documents").select(i.cast("string").alias("chunk_id"), F.col("source").alias("document_id"), "text", "source", i.cast("int").alias("page"), (i % 2 == 0).alias("forced_split"))
    ingest.write_jsonl(rows, path)
    good, _ = checked(chunk_lines(spark, path))
    return good.select("chunk_id", "document_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "page", "forced_split")


PDF_PAGES = 200


@query("pdf_pages", f"SELECT row_number() OVER (PARTITION BY doc_id // {PDF_PAGES} ORDER BY doc_id)::INT AS page, md5(text) AS text_md5 FROM documents")
def _(spark, folder):
    """Documents as pages of PDF files, written to the shared folder and read by the PDF source."""
    path = f"{shared_dir(spark)}/pdf-{uuid.uuid4().hex}"

    def make(table: pa.Table) -> pa.Table:
        return pa.table({"value": [pdf_of([t or "" for t in table.sort_by("doc_id").column("text").to_pylist()])]})

    made = documents(spark, folder).select("doc_id", "text", F.floor(F.col("doc_id") / PDF_PAGES).alias("file")).groupBy("file").applyInArrow(make, "value string")
    made.write.option("maxRecordsPerFile", 1).text(path)
    good, _ = extracted(files(spark, path, "part-*"), page_texts)
    return good.select("page", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("case_file", "SELECT item_id::VARCHAR AS name, text AS question, array_to_string(string_split(text, ' ')[1:2], '|') AS terms, 'src7' AS sources, 0 AS n_types FROM benchmark")
def _(spark, folder):
    """A file of cases, a JSON list, written from `benchmark` and read as a source."""
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    case = F.struct(F.col("item_id").cast("string").alias("name"), F.col("text").alias("question"), F.slice(F.split("text", " "), 1, 2).alias("expected_any_terms"), F.array(F.lit("src7")).alias("forbidden_source_terms"), F.array().cast("array<string>").alias("forbidden_content_types"))
    table(spark, folder, "benchmark").groupBy(F.floor(F.col("item_id") / 50)).agg(F.to_json(F.collect_list(case)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = cases(spark, path)
    return got.select("name", "question", F.array_join("expected_any_terms", "|").alias("terms"), F.array_join("forbidden_source_terms", "|").alias("sources"), F.size("forbidden_content_types").alias("n_types"))


class Rehearsed:
    """A model whose answers depend on the question's length: it fails, cites, or cites only when asked again."""

    name = "rehearsed"

    def answer(self, system: str, prompt: str) -> str:
        n = len(prompt.split("<caso>\n", 1)[1].split("\n</caso>", 1)[0])
        if n % 5 == 0:
            raise RuntimeError("no answer")
        if "<resposta_provisoria>" in prompt:
            return "again [1]" if n % 3 else "again"
        return "first [1]" if n % 2 else "first"


@query("answered_turns", """WITH t AS (SELECT conv_id, turn, length(text) AS n, trim(text) = '' AS blank FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN blank THEN 'vazio' WHEN turn % 4 = 2 THEN 'sem_material' WHEN n % 5 = 0 THEN 'erro_modelo' WHEN n % 2 = 1 OR n % 3 <> 0 THEN 'ok' ELSE 'resposta_bloqueada' END AS status,
CASE WHEN blank OR turn % 4 = 2 OR n % 5 = 0 THEN NULL WHEN n % 2 = 1 THEN 'first [1]' WHEN n % 3 <> 0 THEN 'again [1]' ELSE 'again' END AS answer FROM t""")
def _(spark, folder):
    """Each user turn answered from one passage; answers with problems are asked for once more."""
    t = table(spark, folder, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"), "turn")
    contexts = t.where("turn % 4 <> 2").select("question_id", F.col("question").alias("context"), F.array(F.lit(1)).alias("places"))
    out = retrieve.answered(t.drop("turn"), contexts, Rehearsed())
    return out.select(F.floor(F.col("question_id") / 1000).alias("conv_id"), (F.col("question_id") % 1000).cast("int").alias("turn"), "status", "answer")


@query("normalize_sources", """WITH e AS (SELECT event_id, event_type, value, event_id % 5 AS m FROM events) SELECT event_id, CASE WHEN m = 1 THEN 7 ELSE (event_id % 9)::INT END AS source_number, CASE WHEN m = 0 THEN event_type WHEN m = 3 THEN 'Fonte não identificada' ELSE event_type END AS source_name, CASE m WHEN 1 THEN '1, 2' WHEN 2 THEN '5' END AS pages, CASE WHEN m = 1 THEN 0.5::DOUBLE END AS similarity, CASE m WHEN 1 THEN 'a,b' WHEN 2 THEN 'c' END AS chunk_ids FROM e""")
def _(spark, folder):
    e = table(spark, folder, "events")
    m, name = F.col("event_id") % 5, F.col("event_type")
    raw = (
        F.when(m == 0, name)
        .when(m == 1, F.concat(F.lit('{"n": 7, "fontes": 1, "arquivo": "'), name, F.lit('", "paginas": [1, 2], "sim": "0.5", "chunks": ["a", "b"]}')))
        .when(m == 2, F.concat(F.lit('{"source_number": 0, "source": " '), name, F.lit(' ", "page": 5, "score": "x", "chunk_ids": "c"}')))
        .when(m == 3, F.lit('{"source_name": " "}'))
        .otherwise(F.concat(F.lit('{"file": "'), name, F.lit('"}')))
    )
    s = e.select("event_id", records.normalized_source(raw, F.col("event_id") % 9).alias("s"))
    return s.select("event_id", "s.source_number", "s.source_name", "s.pages", "s.similarity", F.array_join("s.chunk_ids", ",").alias("chunk_ids"))


@query("normalize_results", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'sem_material' WHEN 2 THEN 'erro_modelo' ELSE 'ok' END AS status, CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN event_type ELSE '' END AS answer, CASE event_id % 4 WHEN 0 THEN 0.0::DOUBLE END AS best_similarity, CASE event_id % 4 WHEN 0 THEN 42 ELSE 9 END AS generation_time_ms FROM events""")
def _(spark, folder):
    m, name = F.col("event_id") % 4, F.col("event_type")
    raw = (
        F.when(m == 0, F.concat(F.lit('{"resposta": "'), name, F.lit('", "best_sim": 0, "tempo_geracao_ms": "42"}')))
        .when(m == 1, F.lit('{"answer": "", "generation_time_ms": 0}'))
        .when(m == 2, F.lit('{"status": "erro_modelo", "melhor_similaridade": "x"}'))
        .otherwise(F.concat(F.lit('{"status": "", "mensagem": "'), name, F.lit('", "modelo": " "}')))
    )
    e = table(spark, folder, "events")
    return e.select("event_id", *(v.alias(k) for k, v in records.normalized_answer(raw, F.lit(9)).items())).select("event_id", "status", "answer", "best_similarity", "generation_time_ms")


# --- application store


@query("chat_history", "SELECT conv_id, count(*) AS n, string_agg(turn || ':' || role || ':' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def _(spark, folder):
    c = table(spark, folder, "conversations")
    messages = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("chat_id"), F.col("turn").alias("created_at"), "role", "text")
    h = store.history(c.select(F.col("conv_id").alias("id")).distinct(), messages)
    shown = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m.created_at.cast("string"), m.role, m.text)), "|")
    return h.select(F.col("id").alias("conv_id"), F.size("messages").cast("long").alias("n"), shown.alias("messages"))


@query("chat_titles", f"WITH t AS (SELECT conv_id, turn, {collapse_sql('text')} AS c FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN length(c) <= 60 THEN c ELSE rtrim(substr(c, 1, 57)) || '...' END AS title, coalesce(nullif(substr(c, 1, 160), ''), 'Nova conversa') AS given_title FROM t")
def _(spark, folder):
    return store.titled(table(spark, folder, "conversations").where("role = 'user'")).select("conv_id", "turn", "title", "given_title")


@query("owner_scoped_list", "SELECT conv_id % 10 AS user_id, conv_id, max(turn) AS updated_at FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1, 2 HAVING conv_id % 10 = 3")
def _(spark, folder):
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    chats = c.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 10).alias("user_id"), "updated_at", F.when(F.col("conv_id") % 7 == 0, F.col("updated_at")).alias("deleted_at"))
    return store.owned(chats, F.lit(3)).select("user_id", F.col("id").alias("conv_id"), "updated_at")


@query("lockout_runs", "WITH a AS (SELECT event_id, user_id, ts, event_type = 'signup' AS ok FROM events WHERE event_type IN ('error', 'signup')), r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS run FROM a), c AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r) SELECT event_id, user_id, failures::BIGINT AS failures, failures >= 5 AS locked FROM c WHERE NOT ok")
def _(spark, folder):
    e = table(spark, folder, "events").where("event_type in ('error', 'signup')").withColumn("success", F.col("event_type") == "signup")
    return store.lockouts(e.select("event_id", "user_id", "ts", "success"), CONFIG).select("event_id", "user_id", "failures", F.col("locked_until").isNotNull().alias("locked"))


LATE_HOURS = 3


@query("streamed_lockouts", f"WITH a AS (SELECT event_id, user_id, ts, event_type = 'signup' AS ok FROM events WHERE event_type IN ('error', 'signup')), r AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS run FROM a), c AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r) SELECT event_id, user_id, failures::INT AS failures, failures >= {CONFIG.lock_after} AS locked FROM c WHERE NOT ok AND epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM a) - {LATE_HOURS * 3_600_000}")
def _(spark, folder):
    """Attempts that arrive in files of some days each, up to two hours late and shuffled; as far as the watermark gets."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, folder, "events").where("event_type in ('error', 'signup')").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(7200))
    e = e.select("event_id", "user_id", "ts", (F.col("event_type") == "signup").alias("success"), F.floor(arrival / (6 * 86_400)).alias("part"))
    parts = sorted(r.part for r in e.select("part").distinct().collect())  # one every six days
    for part in parts:
        e.where(F.col("part") == part).drop("part").orderBy(F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp, success boolean").parquet(f"{path}/in")
        counted = flows.lockouts(stream, CONFIG, late=f"{LATE_HOURS} hours")
        counted.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    out = spark.read.schema(flows.LOCKS).parquet(f"{path}/out")
    return out.select("event_id", "user_id", "failures", F.col("locked_until").isNotNull().alias("locked"))


EXPIRY = "SELECT event_id AS id, user_id, ts + INTERVAL 8 HOURS AS expires_at, CASE WHEN event_type = 'error' THEN ts END AS revoked_at FROM events"


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", (F.col("ts") + F.expr(f"interval {CONFIG.session_hours} hours")).alias("expires_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))


AS_OF = "2024-01-15 00:00:00"


@query("session_validity", f"SELECT id, expires_at <= TIMESTAMP '{AS_OF}' AS is_expired, revoked_at IS NOT NULL AS is_revoked, expires_at > TIMESTAMP '{AS_OF}' AND revoked_at IS NULL AS is_valid FROM ({EXPIRY})")
def _(spark, folder):
    return store.sessions_state(sessions(spark, folder), F.expr(f"timestamp_ntz '{AS_OF}'")).select("id", "is_expired", "is_revoked", "is_valid")


@query("bulk_revoke", f"SELECT id, user_id, (revoked_at IS NOT NULL OR user_id % 3 = 0) AS is_revoked, coalesce(revoked_at, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' END) AS revoked_at FROM ({EXPIRY})")
def _(spark, folder):
    s = store.revoked(sessions(spark, folder), F.col("user_id") % 3 == 0, F.expr(f"timestamp_ntz '{AS_OF}'"))
    return s.select("id", "user_id", F.col("revoked_at").isNotNull().alias("is_revoked"), "revoked_at")


@query("token_authentication", f"SELECT s.id AS session_id, c_custkey AS user_id FROM ({EXPIRY}) s JOIN customer c ON c.c_custkey = s.user_id AND c_acctbal > 0 WHERE expires_at > TIMESTAMP '{AS_OF}' AND revoked_at IS NULL")
def _(spark, folder):
    s = sessions(spark, folder).withColumn("token_hash", F.sha2(F.col("id").cast("string"), 256))
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"), F.lit("user").alias("role"), F.lit(False).alias("must_change_password"))
    tokens = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("token"))
    return store.authenticated(tokens, s, users, F.expr(f"timestamp_ntz '{AS_OF}'")).select("session_id", "user_id")


@query("access_guards", f"""WITH s AS ({EXPIRY}), q AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_id END AS token, CASE event_id % 3 WHEN 0 THEN 'login' WHEN 1 THEN 'user' ELSE 'admin' END AS area FROM events),
v AS (SELECT s.id AS token, c_custkey AS user_id, c_nationkey % 2 = 0 AS admin, c_custkey % 5 = 0 AS must FROM s JOIN customer ON c_custkey = s.user_id AND c_acctbal > 0 WHERE expires_at > TIMESTAMP '{AS_OF}' AND revoked_at IS NULL)
SELECT event_id, user_id, CASE WHEN token IS NULL THEN 'not_authenticated' WHEN user_id IS NULL THEN 'invalid_session' WHEN area <> 'login' AND must THEN 'password_change_required' WHEN area = 'admin' AND NOT admin THEN 'not_admin' END AS refused FROM q LEFT JOIN v USING (token)""")
def _(spark, folder):
    s = sessions(spark, folder).withColumn("token_hash", F.sha2(F.col("id").cast("string"), 256))
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("is_active"), F.when(F.col("c_nationkey") % 2 == 0, "admin").otherwise("user").alias("role"), (F.col("c_custkey") % 5 == 0).alias("must_change_password"))
    i = F.col("event_id")
    asked = table(spark, folder, "events").select("event_id", F.when(i % 11 != 0, i.cast("string")).alias("token"), F.when(i % 3 == 0, "login").when(i % 3 == 1, "user").otherwise("admin").alias("area"))
    return store.guarded(asked, s, users, F.expr(f"timestamp_ntz '{AS_OF}'")).select("event_id", "user_id", "refused")


MACHINE = EngineConfig(lock_after=3, lock_minutes=3000)


@query("login_machine", """WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT event_id, user_id, ts, user_id % 13 <> 0 AS known, user_id % 7 <> 0 AS is_active, event_type IN ('signup', 'view') AS ok FROM events)),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, ''::VARCHAR AS outcome, 0 AS n, NULL::TIMESTAMP AS until FROM a
UNION ALL SELECT user_id, i, event_id, CASE w WHEN 'wrong_password' THEN 'invalid_credentials' ELSE w END, CASE w WHEN 'wrong_password' THEN n + 1 WHEN 'login_success' THEN 0 ELSE n END, CASE WHEN w = 'wrong_password' AND n + 1 >= 3 THEN ts + INTERVAL 3000 MINUTES WHEN w = 'login_success' THEN NULL ELSE until END FROM
(SELECT a.*, r.n, r.until, CASE WHEN NOT known THEN 'invalid_credentials' WHEN NOT is_active THEN 'inactive_user' WHEN r.until > a.ts THEN 'temporary_lock' WHEN NOT ok THEN 'wrong_password' ELSE 'login_success' END AS w FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1))
SELECT event_id, user_id, outcome, n AS failures, until IS NOT NULL AS locked FROM r WHERE i > 0""")
def _(spark, folder):
    u = F.col("user_id")
    tries = table(spark, folder, "events").select("event_id", "user_id", "ts", (u % 13 != 0).alias("known"), (u % 7 != 0).alias("is_active"), F.col("event_type").isin("signup", "view").alias("password_ok"))
    return store.logins(tries, MACHINE).select("event_id", "user_id", "outcome", "failures", F.col("locked_until").isNotNull().alias("locked"))


PATCHES = """SELECT CASE WHEN c_custkey % 8 = 0 THEN c_custkey ELSE 1 END AS admin_id, c_custkey + CASE WHEN c_custkey % 12 = 0 THEN 1000000000 ELSE 0 END AS id, CASE WHEN c_custkey % 5 = 0 THEN ' New ' || c_custkey || ' ' END AS name,
CASE WHEN c_custkey % 28 = 0 THEN 'C1@x' WHEN c_custkey % 20 = 0 THEN 'same@x' WHEN c_custkey % 44 = 0 THEN 'own' || c_custkey || '@x' END AS email, CASE WHEN c_custkey % 16 = 0 THEN 'user' WHEN c_custkey % 52 = 0 THEN 'admin' END AS role, CASE WHEN c_custkey % 40 = 8 THEN false WHEN c_custkey % 36 = 0 THEN true END AS is_active FROM customer WHERE c_custkey % 4 = 0"""
USERS = "SELECT c_custkey AS id, c_name AS name, 'c' || c_custkey || '@x' AS email, 'admin' AS role, c_acctbal > 0 AS is_active, 'old' AS updated_at FROM customer"


@query("admin_patches", f"""WITH u AS ({USERS}), p AS ({PATCHES}), e AS (SELECT * REPLACE (lower(trim(email)) AS email) FROM p),
j AS (SELECT e.*, CASE WHEN NOT EXISTS (FROM u WHERE u.id = e.id) THEN 'unknown_user' WHEN EXISTS (FROM u WHERE u.email = e.email AND u.id <> e.id) OR (e.email IS NOT NULL AND (SELECT count(*) FROM e o WHERE o.email = e.email) > 1) THEN 'email_taken' WHEN e.id = admin_id AND role <> 'admin' THEN 'own_role' WHEN e.id = admin_id AND NOT is_active THEN 'own_account' END AS refused FROM e)
SELECT u.id, coalesce(trim(j.name), u.name) AS name, coalesce(j.email, u.email) AS email, coalesce(j.role, u.role) AS role, coalesce(j.is_active, u.is_active) AS is_active, CASE WHEN j.id IS NOT NULL THEN 'now' ELSE 'old' END AS updated_at, 'none' AS refused FROM u LEFT JOIN j ON j.id = u.id AND j.refused IS NULL
UNION ALL SELECT id, name, email, role, is_active, 'patch', refused FROM j WHERE refused IS NOT NULL""")
def _(spark, folder):
    table(spark, folder, "customer").createOrReplaceTempView("customer")
    users, refused = store.patched(spark.sql(USERS), spark.sql(PATCHES), F.lit("now"))
    columns = ["id", "name", "email", "role", "is_active"]
    return users.withColumn("refused", F.lit("none")).unionByName(refused.where("refused is not null").select(*columns, F.lit("patch").alias("updated_at"), "refused"))


@query("eval_totals", scored_sql() + f""", r AS (SELECT *, {ORDERED} AS place FROM z), t AS (SELECT r.question_id, content_type, {norm_sql("q.source || ' ' || q.text")} AS body, {norm_sql("q.source")} AS s FROM r JOIN q USING (doc_id) WHERE place <= 4),
c AS (SELECT question_id, (bool_or(contains(body, 'erin') OR contains(body, 'xyz')) AND NOT bool_or(contains(s, 'src7')) AND NOT bool_or(content_type = 'procedure')) AS passed FROM t GROUP BY question_id)
SELECT count(*) AS cases, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM c""")
def _(spark, folder):
    rows = ranked(spark, folder).where(F.col("place") <= CONFIG.top_k).withColumn("name", F.col("question_id").cast("string"))
    return retrieve.totals(retrieve.evaluated(eval_cases(spark), rows))


@query("soft_delete_and_patch", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'gone' END AS deleted_at, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey <> 3 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def _(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("deleted_at"), F.lit(None).cast("string").alias("updated_at"), F.col("c_name").alias("name"), "c_mktsegment", "c_nationkey")
    c = store.soft_deleted(c, F.col("id") % 4 == 0, F.lit("gone"))
    return store.changed(c, (F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") != 3), name=F.upper("name")).select("id", "deleted_at", "name")


@query("unique_insert", "SELECT c_name AS name, min(c_custkey) AS id FROM (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, c_custkey + 1000000 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0) GROUP BY c_name")
def _(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    there = c.where("id % 2 = 0")
    return store.appended(there, c.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000), unique="name")[0].select("name", "id")


@query("foreign_keys", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS user_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def _(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id")).where("id % 3 <> 0")
    return store.cascade(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), users, "user_id", set_null=True)


@query("cascade_delete", "SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def _(spark, folder):
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id")).where("id % 3 <> 0")
    return store.cascade(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), users, "user_id").select("id", "user_id")


@query("latest_versions", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, folder):
    return store.latest(table(spark, folder, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 17")
def _(spark, folder):
    return point(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", 17)


@query("users_by_name", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_name, c_custkey) AS place FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, folder):
    c = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select("c_custkey", "c_name", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_name", "c_custkey")).cast("long").alias("place"))


@query("safe_casts", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE event_id::VARCHAR END AS INT) AS as_int, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN '' ELSE value::VARCHAR END AS DOUBLE) AS as_float, nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE ' ' || event_type || ' ' END), '') AS as_text FROM events")
def _(spark, folder):
    i = F.col("event_id")
    return table(spark, folder, "events").select("event_id", records.optional_int(F.when(i % 3 == 0, "x").otherwise(i.cast("string"))).alias("as_int"), records.optional_float(F.when(i % 4 == 0, "").otherwise(F.col("value").cast("string"))).alias("as_float"), records.optional_text(F.when(i % 2 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))).alias("as_text"))


@query("shown_dates", "SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-15' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%d/%m/%y') END AS shown FROM events")
def _(spark, folder):
    return table(spark, folder, "events").select("event_id", F.when(F.to_date("ts") == F.lit("2024-01-15").cast("date"), F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "dd/MM/yy")).alias("shown"))


@query("metadata_filter", "SELECT doc_id, source FROM documents WHERE source = 'src3' AND doc_id BETWEEN 20 AND 400")
def _(spark, folder):
    return table(spark, folder, "documents").where(where({"$and": [{"source": "src3"}, {"doc_id": {"$gte": 20}}, {"doc_id": {"$lte": 400}}]})).select("doc_id", "source")


@query("corpus_counters", "SELECT source, count(*) AS pages, count(*) FILTER (WHERE trim(text) = '') AS textless, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def _(spark, folder):
    return documents(spark, folder).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.trim("text") == "").alias("textless"), F.sum("n_chars").alias("n_chars"))
