"""The queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, bwt, debruijn, fertility, merge, mixing, postings, prefixtree, rff, urls, warc, wrappers
from .runtime import attach


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents"), tuple(map(tokenizer, fertility.VOCABULARIES)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rff.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest(table(spark, sf_dir, "embeddings"))


def op3_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digest_repeats(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digest_repeats(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.jaccard_components(table(spark, sf_dir, "documents"))


def op11_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merged_branches(table(spark, sf_dir, "documents"))
    return merged.select("doc_id", *merge.COLUMNS, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), *merge.COUNTS)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules, urls.labelled_urls(spark)).withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_wrappers": op2_wrappers,
    "op3_debruijn_dedup": op3_debruijn_dedup,
    "op4_fertility": op4_fertility,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_bwt_dedup": op6_bwt_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_nearest": op10_nearest,
    "op11_branch_merge": op11_branch_merge,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}



def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """WITH d AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN original <> page_id THEN original END AS refers_to, url FROM d LEFT JOIN f USING (payload_digest)""",
    "op3_debruijn_dedup": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM t)),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, p + o AS i FROM (SELECT g.doc_id, p FROM g JOIN m USING (h) WHERE low < g.doc_id), (SELECT unnest(range(13)) AS o)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN c ON c.doc_id = e.doc_id AND c.i = e.i GROUP BY e.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text FROM t LEFT JOIN k USING (doc_id)""",
    "op7_jaccard_join": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') || CASE WHEN len(w) < 4 THEN ' ' || chr(10) ELSE '' END AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS low FROM u UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(low) AS low FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_branch_merge": r"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS v FROM (SELECT unnest(range(256))::BIGINT AS i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
names AS (SELECT doc_id, unnest(['row', 'lang', 'source']) AS name FROM d UNION ALL SELECT doc_id, k::VARCHAR FROM lines),
keys AS (SELECT doc_id, name, b, b || ':' || doc_id || ':' || name AS s FROM names, (VALUES ('L'), ('R')) v (b)),
codes AS (SELECT doc_id, name, b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 11 AS c FROM keys, crc),
c AS (SELECT doc_id, name, max(c) FILTER (b = 'L') AS l, max(c) FILTER (b = 'R') AS r FROM codes GROUP BY doc_id, name),
col AS (SELECT doc_id, name, v, CASE l WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS x, CASE r WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS y
FROM c JOIN (SELECT doc_id, 'lang' AS name, lang AS v FROM d UNION ALL SELECT doc_id, 'source', source FROM d) USING (doc_id, name)),
cols AS (SELECT doc_id, max(CASE WHEN x = y OR y = v THEN x WHEN x = v THEN y ELSE v END) FILTER (name = 'lang') AS lang, max(CASE WHEN x = y OR y = v THEN x WHEN x = v THEN y ELSE v END) FILTER (name = 'source') AS source,
count(*) FILTER (x <> v OR y <> v) - count(*) FILTER (x <> v AND y <> v AND x <> y) AS clean, count(*) FILTER (x <> v AND y <> v AND x <> y) AS ee, count(*) FILTER (x <> v) AS nl, count(*) FILTER (y <> v) AS nr FROM col GROUP BY doc_id),
ln AS (SELECT lines.doc_id, k, line, CASE WHEN l < 3 THEN l END AS x, CASE WHEN r < 3 THEN r END AS y, CASE WHEN l IN (3, 4) THEN l END AS p, CASE WHEN r IN (3, 4) THEN r END AS q FROM lines JOIN c ON c.doc_id = lines.doc_id AND c.name = k::VARCHAR),
lm AS (SELECT *, CASE WHEN x <> y THEN NULL ELSE coalesce(x, y) END AS e, CASE WHEN p <> q THEN NULL ELSE coalesce(p, q) END AS g FROM ln),
out AS (SELECT doc_id, 2 * k AS k, CASE e WHEN 1 THEN line || '!' WHEN 2 THEN line || '?' ELSE line END AS line FROM lm WHERE e IS DISTINCT FROM 0 UNION ALL SELECT doc_id, 2 * k + 1, CASE g WHEN 3 THEN '!' ELSE '?' END FROM lm WHERE g IS NOT NULL),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM out GROUP BY doc_id),
lc AS (SELECT doc_id, count(e) + count(g) AS clean, count(*) FILTER (x <> y AND x > 0 AND y > 0) AS ee, count(*) FILTER (x <> y AND (x = 0 OR y = 0)) AS ed, count(*) FILTER (p <> q) AS ii, count(x) + count(p) AS nl, count(y) + count(q) AS nr FROM lm GROUP BY doc_id),
b AS (SELECT d.doc_id, d.lang AS lang0, d.source AS source0, d.text AS text0, cols.lang, cols.source, coalesce(texts.text, '') AS text, rows.l = 0 AS dl, rows.r = 0 AS dr, cols.nl + lc.nl > 0 AS cl, cols.nr + lc.nr > 0 AS cr, cols.clean + lc.clean AS clean, cols.ee + lc.ee AS ee, lc.ed, lc.ii
FROM d JOIN (SELECT * FROM c WHERE name = 'row') rows USING (doc_id) JOIN cols USING (doc_id) JOIN lc USING (doc_id) LEFT JOIN texts USING (doc_id)),
s AS (SELECT *, dl OR dr AS dropped, (dl AND NOT dr AND cr) OR (dr AND NOT dl AND cl) AS fight FROM b),
merged AS (SELECT doc_id, CASE WHEN fight THEN lang0 WHEN NOT dropped THEN lang END AS lang, CASE WHEN fight THEN source0 WHEN NOT dropped THEN source END AS source, CASE WHEN fight THEN text0 WHEN NOT dropped THEN text END AS text,
CASE WHEN fight THEN 0 WHEN dropped THEN 1 ELSE clean END AS n_clean, CASE WHEN dropped THEN 0 ELSE ee END AS n_edit_edit, CASE WHEN fight THEN 1 WHEN dropped THEN 0 ELSE ed END AS n_edit_delete, CASE WHEN dropped THEN 0 ELSE ii END AS n_insert_insert FROM s),
added AS (SELECT -1 - doc_id AS doc_id, lang, source, CASE l WHEN 3 THEN '!' ELSE '?' END AS text FROM d JOIN c USING (doc_id) WHERE name = 'row' AND l IN (3, 4) UNION ALL SELECT -2 - doc_id, lang, source, CASE r WHEN 3 THEN '!' ELSE '?' END FROM d JOIN c USING (doc_id) WHERE name = 'row' AND r IN (3, 4)),
fresh AS (SELECT doc_id, count(DISTINCT (lang, source, text)) AS n, min(lang) AS lang, min(source) AS source, min(text) AS text FROM added GROUP BY doc_id)
SELECT doc_id, lang, source, sha256(text) AS text_sha256, n_clean::BIGINT AS n_clean, n_edit_edit::BIGINT AS n_edit_edit, n_edit_delete::BIGINT AS n_edit_delete, n_insert_insert::BIGINT AS n_insert_insert FROM merged
UNION ALL SELECT doc_id, CASE WHEN n = 1 THEN lang END, CASE WHEN n = 1 THEN source END, CASE WHEN n = 1 THEN sha256(text) END, (n = 1)::BIGINT, 0, 0, (n > 1)::BIGINT FROM fresh""",
    "op12_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM t),
m AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS failed FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY part, failed),
f (f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS (SELECT filter_order, step, filter_order[step] AS f, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
p AS (SELECT part, filter_order, step, f, n, g, x, failed = f AS alone, contains(failed, f) AS fails, translate(failed, earlier, '') <> failed AS gone FROM c, s),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(g) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(x) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM p GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
(sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op13_url_filters": f"""WITH RECURSIVE words AS (SELECT 1 AS label, {_list(urls.BLOCKED)} AS ws UNION ALL SELECT 0, {_list(urls.ALLOWED)}),
good AS (SELECT {_list(urls.ALLOWED)} AS ws, {_list(urls.PREFIXES)} AS pre, {_list(urls.ENDINGS)} AS fin, {_list(urls.PATHS)} AS paths),
n AS (SELECT label, ws, unnest(range(len(ws))) AS i FROM words),
m AS (SELECT label, ws, i, unnest(range(4)) AS k FROM n),
o AS (SELECT label, i, k, m.ws[i + 1] AS w, m.ws[(i * 7 + k * 13 + 5) % len(m.ws) + 1] AS other, good.ws[(i * 3 + k) % len(good.ws) + 1] AS mild,
pre[(i + k) % len(pre) + 1] AS p, fin[(i + k * 2) % len(fin) + 1] AS e, paths[(i * 5 + k) % len(paths) + 1] AS path FROM m, good),
u AS (SELECT label * 1000000 + i * 4 + k AS id, label, 'https://' || p || CASE k WHEN 0 THEN w WHEN 1 THEN w || '-' || other WHEN 2 THEN other || w ELSE w || '-' || mild END || '.' || e || path AS url FROM o),
every AS (SELECT 'l' AS kind, id, url FROM u UNION ALL SELECT 'p', page_id, url FROM pages),
rest AS (SELECT kind, id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM every),
parts AS (SELECT kind, id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
texts AS (SELECT DISTINCT host, path, unnest(['h', 'p']) AS k, unnest([CASE WHEN host = '' THEN '' ELSE '^' || host || '$' END, regexp_replace(path, '[0-9]+', '0', 'g')]) AS t FROM parts),
sized AS (SELECT *, unnest([3, 4, 5]) AS size FROM texts),
placed AS (SELECT *, unnest(range(1, greatest(length(t) - size + 2, 1))) AS pos FROM sized),
f AS (SELECT DISTINCT host, path, ('0x' || substr(md5(k || substr(t, pos, size)), 1, 6))::INT % {urls.DIM} AS f FROM placed),
c AS (SELECT host, path, count(*) AS n FROM f GROUP BY host, path),
x AS (SELECT id, f, 1 / sqrt(n) AS s FROM parts JOIN c USING (host, path) JOIN f USING (host, path) WHERE kind = 'l' UNION ALL SELECT id, {urls.DIM}, 1.0 FROM u),
w AS (SELECT 0 AS step, f, 0.0::DOUBLE AS v, 0.0::DOUBLE AS q FROM (SELECT DISTINCT f FROM x)
UNION ALL SELECT step + 1, f, v + {urls.RATE} * g / sqrt(q + g * g + 1e-12), q + g * g FROM (SELECT w.step, w.f, w.v, w.q, t.g / (SELECT count(*) FROM u) - {urls.DECAY} * w.v AS g FROM w JOIN (
SELECT x.f, sum(e.e * x.s) AS g FROM x JOIN (SELECT id, label - 1 / (1 + exp(-m)) AS e FROM (SELECT x.id, sum(w.v * x.s) AS m FROM x JOIN w USING (f) GROUP BY x.id) JOIN u USING (id)) e USING (id) GROUP BY x.f) t USING (f)) WHERE step < {urls.STEPS}),
model AS (SELECT f, v FROM w WHERE step = {urls.STEPS}),
bias AS (SELECT v AS b FROM model WHERE f = {urls.DIM}),
sums AS (SELECT host, path, sum(v) / sqrt(any_value(n)) AS m FROM f JOIN c USING (host, path) LEFT JOIN model USING (f) GROUP BY host, path),
rules (h, p, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)}),
ruled AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM (SELECT DISTINCT host, path FROM parts WHERE kind = 'p') JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
s AS (SELECT id, host, path, rule, verdict, CASE WHEN rule IS NULL THEN 1 / (1 + exp(-(coalesce(m, 0) + b))) END AS score FROM parts LEFT JOIN ruled USING (host, path) LEFT JOIN sums USING (host, path), bias WHERE kind = 'p')
SELECT id AS page_id, host, path, rule, coalesce(verdict, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score FROM s""",
}
